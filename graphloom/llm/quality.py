"""Quality classifier by hierarchical empirical Bayes.

Three levels of evidence: the document (a classifier over dense text features),
its path (host and section) and its host.  Sites are judged by the evidence
of *all* their documents: grouped sums of document probabilities give each host a
posterior that shrinks towards the global rate, and each path one that shrinks
towards its host.  How hard they shrink is itself estimated (method of moments
over all hosts, and over all paths within hosts), so a site of few documents stays near its prior.
A document leaves its own probability out of its sites' sums.  How much a site's
posterior counts beside the document's own evidence is fitted on the labelled sample.
Documents here have no address: a host is a source, a path a source in one language.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.boosting import Calibrated
from graphloom.llm.common import map_texts, materialise, scratch, small, table
from graphloom.llm.labelled import held_out, sample

#: The document classifier learns from at most so many labelled documents.
SAMPLE_ROWS = 12_000
#: Sites (host, path) are broadcast up to so many rows.
SITES = 200_000
KEEP = 0.5
EDGE = 0.01

SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~=+@_]")
SENTENCE_END = (".", "!", "?", ":", ";", '"')

FEATURES = (
    "words", "word_length", "longest", "symbols", "capitals", "digits", "exclaimed", "bars", "unique_words", "unique_lines",
    "lines", "sentence_lines", "short_words", "plain_words", "repeats_next", "letters",
)


def features(text: str) -> list[float]:
    """Dense, language-free statistics of the whole text (all 0 for an empty one)."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    dense = "".join(words)
    chars = len(dense)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, dense))
    return [
        float(min(n, 2000)), chars / n, max(map(len, words)), len(SYMBOLS.findall(text)) / chars, upper / chars, sum(map(str.isdigit, dense)) / chars,
        text.count("!") / n, text.count("|") / n, len(set(words)) / n, len(set(lines)) / len(lines),
        len(lines) / n, sum(x.rstrip().endswith(SENTENCE_END) for x in lines) / len(lines), sum(len(w) < 4 for w in words) / n,
        sum(map(str.isalpha, words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(map(str.isalpha, dense)) / size,
    ]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Calibrated, dict[int, tuple[float, float]]]:
    """The classifier, learned from at most ``rows`` labelled documents outside the held-out fifth (none: a constant 0.5).

    Beside it each of these documents with its probability, as unseen, and its label.
    """
    import numpy as np

    drawn = sample(docs, labels, "quality", rows)
    got = map_texts(drawn, ["doc_id", "y"], lambda texts: [[features(t) for t in texts]], "x array<double>").collect()
    data = sorted((r["doc_id"], r["y"], r["x"]) for r in got)
    x = np.array([r[2] for r in data], float).reshape(-1, len(FEATURES))
    y = np.array([float(r[1] > 0) for r in data])
    model = Calibrated(x, y)
    return model, {r[0]: (float(p), float(t)) for r, p, t in zip(data, model.unseen, y, strict=True)}


def evidence(df: DataFrame, model: Calibrated, carry: list[str]) -> DataFrame:
    """Columns ``carry`` and p_doc, the classifier's probability of each row's whole text."""

    def run(texts: list[str]) -> list:
        import numpy as np

        x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return [model.probability(x)]

    return map_texts(df, carry, run, "p_doc double")


def logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(inside / (1 - inside))


def _strength(prior: Column) -> Column:
    """Prior rows of a beta prior from moments: m(1-m) / between-site variance - 1, between 1 and 10000.

    An aggregate over sites (mean ``m``, rows ``n``, the mean's prior); the
    sampling variance m(1-m)/n is taken off the observed spread.
    """
    weight = F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col("m") - prior, 2)) / weight
    noise = F.sum(prior * (1 - prior)) / weight
    pooled = F.sum(F.col("n") * prior * (1 - prior)) / weight
    between = F.greatest(spread - noise, F.lit(1e-6))
    return F.coalesce(F.least(F.greatest(pooled / between - 1, F.lit(1.0)), F.lit(10_000.0)), F.lit(1.0))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """One row a (host, path): sums, posteriors' parts and shrinkage of both levels, and the global rate.

    ``scored`` has host, path and p_doc.  Sums are pre-aggregated before the
    shuffle, so a host with most rows costs no more than another.
    """
    paths = materialise(scored.groupBy("host", "path").agg(F.sum("p_doc").alias("path_sum"), F.count(F.lit(1)).alias("path_n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    rate = hosts.agg(F.sum("host_sum") / F.sum("host_n")).first()[0]
    overall = F.lit(rate).cast("double")
    by_host = hosts.select((F.col("host_sum") / F.col("host_n")).alias("m"), F.col("host_n").alias("n"))
    host_strength = by_host.agg(_strength(overall)).first()[0]
    joined = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "host_sum", "host_n")
    inside = joined.select((F.col("path_sum") / F.col("path_n")).alias("m"), F.col("path_n").alias("n"), (F.col("host_sum") / F.col("host_n")).alias("prior"))
    path_strength = inside.agg(_strength(F.col("prior"))).first()[0]
    return joined.withColumns({"global": overall, "host_strength": F.lit(host_strength), "path_strength": F.lit(path_strength)})


def posteriors(scored: DataFrame, sites: DataFrame) -> DataFrame:
    """Add p_host, p_path and shift: the path's log-odds over the global ones, the document's own evidence left out."""
    s = small(sites, SITES).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "path_sum", "path_n", "host_sum", "host_n", "global", "host_strength", "path_strength")
    both = scored.join(s, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    host = (F.col("host_strength") * F.col("global") + F.col("host_sum") - F.col("p_doc")) / (F.col("host_strength") + F.col("host_n") - 1)
    path = (F.col("path_strength") * F.col("p_host") + F.col("path_sum") - F.col("p_doc")) / (F.col("path_strength") + F.col("path_n") - 1)
    return both.withColumn("p_host", host).withColumn("p_path", path).withColumn("shift", logit(F.col("p_path")) - logit(F.col("global"))).drop(*s.columns)


def site_weight(p, shift, y) -> float:
    """Weight of the shift beside the document's log-odds that makes the labels likeliest, from 0 (sites tell nothing) to 1 (all that Bayes' rule gives them)."""
    import numpy as np

    inside = np.clip(p, EDGE, 1 - EDGE)
    base, at = np.log(inside / (1 - inside)), 0.5
    for _ in range(50):
        q = 1 / (1 + np.exp(-(base + at * shift)))
        bend = float((q * (1 - q) * shift**2).sum()) + 1e-9
        at = min(1.0, max(0.0, at + float(((y - q) * shift).sum()) / bend))
    return at


def combine(scored: DataFrame, sites: DataFrame, weight: float = 1.0) -> DataFrame:
    """Add p_host, p_path, score and kept: the document's log-odds with ``weight`` times its path's shift."""
    out = posteriors(scored, sites)
    total = logit(F.col("p_doc")) + F.lit(weight) * F.col("shift")
    return out.withColumn("score", 1 / (1 + F.exp(-total))).withColumn("kept", F.col("score") >= KEEP).drop("shift")


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, carry: list[str]) -> DataFrame:
    """Columns ``carry`` with host, path, p_doc, p_host, p_path, score and kept of every row of ``docs``.

    Null host or path is a site of its own; null text is judged as an empty
    one; a very long text is read whole; repeated rows are judged each and count
    each for their site; an empty table gives no rows.  Texts are read once: the
    evidence is written with ``carry``, which should be narrow, has doc_id, and
    has no name of the result's; other columns are not read.
    """
    import numpy as np

    spark = docs.sparkSession
    model, learned = train(docs, labels)
    read = docs.select(*carry, host.alias("host"), path.alias("path"), "text")
    scored = materialise(evidence(read, model, [*carry, "host", "path"]), "quality-evidence")
    with scratch(spark) as held:
        sites = held.keep(materialise(site_posteriors(scored), "quality-sites"))
    weight = 1.0
    if learned:
        ids = spark.createDataFrame([(i,) for i in learned], "doc_id bigint")  # at most SAMPLE_ROWS
        shifts = posteriors(scored.join(F.broadcast(ids), "doc_id", "left_semi"), sites).groupBy("doc_id").agg(F.avg("shift").alias("shift"))
        rows = [(*learned[r["doc_id"]], r["shift"]) for r in shifts.collect()]
        p, y, shift = (np.array(c) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0),) * 3
        weight = site_weight(p, shift, y)
    return combine(scored, sites, weight)


def judge(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """``classify`` with the source as host and the source in one language as path."""
    return classify(docs, labels, F.col("source"), F.concat_ws("/", "source", F.coalesce("lang", F.lit("-"))), carry)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged (doc_id, held_out, p_doc, p_host, p_path, score, kept); edge cases as in ``classify``."""
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p_doc", "p_host", "p_path", "score", "kept")
