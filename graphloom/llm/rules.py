"""Quality rules with risk-controlled thresholds (DataFrame functions only).

A rule rejects a text whose statistic exceeds a cutoff.  Cutoffs are not hand
set: for each stratum and rule a grid of candidates is tried on labelled
holdouts.  A candidate is admissible if the exact binomial (Clopper-Pearson)
test shows that it rejects at most ``RISK`` of good texts.  Multiple testing:
the level is divided by the number of (stratum, rule) families (Bonferroni);
within a family the candidates are tried in a sequence fixed beforehand, from
the highest cutoff down, until the first fails, which needs no correction, since
each rejects all that the one before does.  Of the admissible candidates the
rule takes that which gains most, and none if no candidate gains anything.
Where the holdout is too small to prove even the highest cutoff, the rule is
reported as unproved.  With 4 strata, 4 rules and these settings that takes 285 good texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.arrays import AT_BITS, hashed, low, packed, windows
from graphloom.llm.common import materialise, release, small, spaced, table, words

SYMBOLS = "#*$%&|<>"

#: Most of the good texts that one rule may reject in one stratum, and the chance that any rule breaks that promise.
RISK = 0.02
LEVEL = 0.05
#: One good text lost outweighs this many bad ones caught.
LOSS = 20.0
#: Candidate cutoffs of each rule; statistics are shares, so a fixed grid covers them.
GRID = [round(x / 50, 2) for x in range(1, 50)]
#: Cutoffs, a row a stratum, are broadcast up to so many strata.
STRATA = 100_000
RULES = ("symbol_share", "repeat_share", "dup_line_share", "caps_share")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(spaced(line)) != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def _repeated_at(pack: Column) -> Column:
    """Positions of a packed array whose hash bits equal a neighbour's."""

    def twin(x: Column, t: Column) -> Column:
        left = (t > 0) & (F.shiftright(pack[F.greatest(t - 1, F.lit(0))], AT_BITS) == F.shiftright(x, AT_BITS))
        right = (t < F.size(pack) - 1) & (F.shiftright(pack[F.least(t + 1, F.size(pack) - 1)], AT_BITS) == F.shiftright(x, AT_BITS))
        return left | right

    return F.transform(F.filter(pack, twin), low)


def _covered(places: Column, k: int) -> Column:
    """How many positions the windows of length ``k`` that start at sorted ``places`` cover."""
    reach = F.transform(
        places, lambda p, t: F.when(t < F.size(places) - 1, F.least(places[F.least(t + 1, F.size(places) - 1)] - p, F.lit(k))).otherwise(F.lit(k))
    )
    return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)


def measure(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' shares.

    All from the whole text; null text counts as empty (all zero).  A word is
    repeated if it lies in a 3-word window whose 64-bit hash occurs twice or
    more in the text; both halves of the hash are compared, each sorted beside
    its positions.  Row-local, in memory in proportion to the row's own text;
    other columns are not read.  Names of ``keep`` must be neither those of the
    measures nor begin with an underscore.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    dense = F.replace(spaced(F.col("text")), F.lit(" "))
    capitals = F.length(F.regexp_replace(dense, r"\P{Lu}+", ""))
    basic = df.select(
        *keep,
        words(F.col("text")).alias("_words"),
        F.length(dense).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        capitals.cast("long").alias("_capitals"),
        _dup_lines(text).cast("long").alias("n_dup_lines"),
        F.size(F.filter(F.split(text, "\n", -1), lambda line: F.trim(spaced(line)) != "")).cast("long").alias("_lines"),
    )
    hashes = basic.select("*", F.size("_words").cast("long").alias("n_words"), hashed(F.col("_words")).alias("_h")).drop("_words")
    grams = hashes.select("*", windows("_h", 3).alias("_g")).drop("_h")
    twins = grams.select("*", (F.size(F.array_distinct("_g")) < F.size("_g")).alias("_any"))
    sorts = twins.select(
        "*",
        F.when(F.col("_any"), packed(F.col("_g"))).alias("_hi"),
        F.when(F.col("_any"), packed(F.col("_g"), AT_BITS)).alias("_lo"),
    ).drop("_g")
    both = F.array_sort(F.array_intersect(_repeated_at(F.col("_hi")), _repeated_at(F.col("_lo"))))
    found = sorts.select("*", F.when(F.col("_any"), both).alias("_at")).drop("_hi", "_lo")
    counted = found.select("*", F.when(F.col("_any"), _covered(F.col("_at"), 3)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return counted.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "_lines").alias("dup_line_share"),
        share("_capitals", "word_chars").alias("caps_share"),
    )


def base_failed() -> Column:
    """The fixed base rule: fewer than 50 words, or over half of them repeated."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def allowed_rejections(n: Column, risk: float, level: Column) -> Column:
    """Largest k for which a binomial(n, risk) count is at most k with probability <= ``level`` (-1: none).

    Rejecting k of n good texts then proves, at that level, a true rate of at
    most ``risk``: the Clopper-Pearson upper bound of k/n is <= risk.  Summed in
    logarithms, so no term underflows.
    """
    odds = F.lit(risk / (1 - risk))
    start = F.struct(
        (n * F.log1p(F.lit(-risk))).alias("term"), (n * F.log1p(F.lit(-risk))).alias("total"), F.lit(-1).cast("long").alias("k"), F.lit(False).alias("over")
    )

    def step(s: Column, i: Column) -> Column:
        over = s["over"] | (s["total"] > F.log(level))
        term = s["term"] + F.log((n - i).cast("double") / (i + 1) * odds)
        most = F.greatest(s["total"], term)
        total = most + F.log(F.exp(s["total"] - most) + F.exp(term - most))
        return F.when(over, F.struct(s["term"], s["total"], s["k"], F.lit(True).alias("over"))).otherwise(
            F.struct(term.alias("term"), total.alias("total"), i.cast("long").alias("k"), F.lit(False).alias("over"))
        )

    upto = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n * F.lit(risk)).cast("long"), F.lit(0).cast("long")))
    tried = F.filter(upto, lambda i: i < n)
    return F.when(n > 0, F.aggregate(tried, start, step)["k"]).otherwise(F.lit(-1).cast("long"))


def fit(measured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row a (stratum, rule) with labels: whether any cutoff is ``proved``, the ``cutoff`` (null: none gains), and the holdout's counts behind it.

    ``labels`` has doc_id and quality (1 good, 0 bad); rows without a quality
    are ignored, a document labelled twice counts twice.  All labelled rows
    count, in one grouped count.  The result has at most strata x rules rows.
    """
    held = measured.filter(~base_failed()).join(labels.filter("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    tried = held.select(
        F.col(stratum).alias("stratum"),
        "quality",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])).alias("t"),
    )
    # one row a (stratum, rule, grid cell), then running sums over the 50 cells
    cells = F.least(F.floor(F.ceil(F.col("t.value") * 50 - 1e-9)), F.lit(len(GRID) + 1)).cast("int")
    binned = tried.groupBy("stratum", F.col("t.rule").alias("rule"), F.greatest(cells, F.lit(0)).alias("cell")).agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")
    )
    binned = materialise(binned, "rule-cells")  # small: at most 51 rows a family
    strata = binned.select("stratum", "rule").distinct()
    families = max(1, strata.count())
    grid = strata.select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) + 1))).alias("cell"))
    full = grid.alias("g").join(
        binned.alias("b"),
        F.col("g.stratum").eqNullSafe(F.col("b.stratum")) & (F.col("g.rule") == F.col("b.rule")) & (F.col("g.cell") == F.col("b.cell")),
        "left",
    ).select("g.stratum", "g.rule", "g.cell", F.coalesce("b.good", F.lit(0)).alias("good"), F.coalesce("b.bad", F.lit(0)).alias("bad"))
    each = Window.partitionBy("stratum", "rule")
    above = each.orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    tests = full.select(
        "*",
        F.coalesce(F.sum("good").over(above), F.lit(0)).alias("good_out"),
        F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("bad_out"),
        F.sum("good").over(each).alias("n_good"),
        F.sum("bad").over(each).alias("n_bad"),
    ).filter(F.col("cell").between(1, len(GRID)))
    bound = tests.select("stratum", "rule", "n_good").distinct()
    bound = bound.select("stratum", "rule", allowed_rejections(F.col("n_good"), risk, F.lit(level / families)).alias("allowed"))
    passed = tests.alias("t").join(
        bound.alias("b"), F.col("t.stratum").eqNullSafe(F.col("b.stratum")) & (F.col("t.rule") == F.col("b.rule"))
    ).filter("t.good_out <= b.allowed")
    gain = F.col("bad_out") / F.greatest(F.col("n_bad"), F.lit(1)) - F.lit(LOSS) * F.col("good_out") / F.greatest(F.col("n_good"), F.lit(1))
    # equal gains form a plateau between the classes; take its middle
    plateau = passed.select("t.*", gain.alias("_gain"))
    top = plateau.withColumn("_top", F.max("_gain").over(each)).filter("_gain = _top")
    best = F.col("_gain") > 0
    found = top.groupBy("stratum", "rule").agg(
        F.when(F.max(best), F.round(F.avg("cell")) / 50).alias("cutoff"), F.max("good_out").alias("good_rejected"), F.max("bad_out").alias("bad_rejected")
    )
    every = tests.select("stratum", "rule", "n_good").distinct().alias("e")
    met = every.join(found.alias("f"), F.col("e.stratum").eqNullSafe(F.col("f.stratum")) & (F.col("e.rule") == F.col("f.rule")), "left")
    return met.select("e.stratum", "e.rule", F.col("f.good_rejected").isNotNull().alias("proved"), "cutoff", "good_rejected", "bad_rejected", "n_good")


def decide(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Add base_failed, rejected_by (rules whose cutoff the text exceeds), unproved (rules without a proved cutoff in its stratum) and kept.

    ``cutoffs`` is pivoted to one row a stratum, so each text meets one row; a
    stratum without a proved cutoff (also a null one) keeps all that the base
    rule keeps.  A statistic that equals its cutoff passes.
    """
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff").alias("c"), F.first("proved").alias("p"))
    wide = wide.select(F.col("stratum").alias("_stratum"), *[F.col(f"{r}_{x}").alias(f"_{x}_{r}") for r in RULES for x in "cp"])
    joined = measured.join(small(materialise(wide, "rule-strata"), STRATA), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    named = lambda flag: F.filter(F.array(*[F.when(flag(r), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("rejected_by", named(lambda r: F.col(r) > F.col(f"_c_{r}")))
        .withColumn("unproved", named(lambda r: ~F.coalesce(F.col(f"_p_{r}"), F.lit(False))))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("_stratum", *[f"_{x}_{r}" for r in RULES for x in "cp"])
    )


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Measure, fit and decide.  Texts are read once: the measures are written, not recomputed.

    Strata are values of a small dimension such as language; null is one of them.
    Rows of one doc_id are measured each, and each counts with the document's
    labels; rows without doc_id have none.
    """
    measured = materialise(measure(docs, keep or ["doc_id", stratum]), "rule-measures")
    cutoffs = materialise(fit(measured, labels, stratum), "rule-cutoffs")
    out = decide(measured, cutoffs, stratum)
    release(cutoffs)
    return out


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document.

    Null, empty and blank texts have no words and fail the base rule; a very
    long text is measured whole; repeated rows are judged each; an empty table
    gives no rows; other columns are not read, whatever their names.
    """
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "unproved"
    )
