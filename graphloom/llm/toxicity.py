"""Toxicity: gradient-boosted trees over dense features, isotonically calibrated.

The lexicon is learned from labelled texts: a word or a stem (word beginning)
belongs if it stands in many *different* contexts of toxic texts and in
next to none of others.  Counting contexts (the word with its predecessor) and not
occurrences keeps out the vocabulary of a toxic text that was copied often.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.boosting import FOLDS, Calibrated
from graphloom.llm.common import map_texts, materialise, scratch, table
from graphloom.llm.labelled import held_out, sample

#: The classifier learns from at most so many labelled documents.
SAMPLE_ROWS = 12_000
#: Most words, and most stems, of a lexicon for each drawn document; contexts that an entry needs; least log-odds.
ENTRIES = 4
CONTEXTS = 4
LOG_ODDS = 2.5
STEMS = (4, 5, 6)
STEM_FORMS = 3

#: Fixed word list: second-person pronouns of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti tus usted vosotros".split()
)
#: Fixed table: characters written in place of letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
NEAR = 4

WORDS = re.compile(r"[^\W_]+")
DISGUISED = re.compile(r"[^\W\d_]+[0-9@$!|*#]+(?=[^\W\d_])[\w@$!|*#]*")
SPELLED = re.compile(r"\b[^\W\d_](?:[ .\-_*][^\W\d_]){3,}\b")

FEATURES = (
    "word_hits", "word_density", "word_weight", "stem_hits", "stem_density", "stem_weight", "near_you", "near_you_share",
    "you_density", "capitals", "shouted", "exclamations", "questions", "punctuation", "disguised", "disguised_hits",
)


class Parsed:
    """What a text's features need of it, whatever the lexicon."""

    def __init__(self, text: str) -> None:
        low = text.lower()
        self.words = words = WORDS.findall(low)
        self.beginnings = [(size, [w[:size] if len(w) >= size else "" for w in words]) for size in STEMS]
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        self.close = {i + d for i in you for d in range(-NEAR, NEAR + 1)}
        self.disguised = [w.strip("*#").translate(LEET) for w in DISGUISED.findall(low)]
        self.spelled = [re.sub(r"[ .\-_*]", "", w) for w in SPELLED.findall(low)]
        n, upper = len(words) or 1, sum(map(str.isupper, text))
        shouted = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b", text)) if upper else 0
        points = sum(map(text.count, ".,;:!?"))
        self.own = [
            len(you) / n, upper / (len(text) or 1), shouted / n, text.count("!") / n, text.count("?") / n, points / n, len(self.disguised) / n,
        ]


class Lexicon:
    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems

    def features(self, text: str) -> list[float]:
        return self.of(Parsed(text))

    def of(self, text: Parsed) -> list[float]:
        lex, stems = self.words, self.stems
        n = len(text.words) or 1
        hits = [i for i, w in enumerate(text.words) if w in lex]
        weight = sum(lex[text.words[i]] for i in hits)
        begun = [(i, w) for _, beginnings in text.beginnings for i, w in enumerate(beginnings) if w in stems] if stems else []
        stem_weight = sum(stems[w] for _, w in begun)
        marked = {*hits, *[i for i, _ in begun]}
        near = len(marked & text.close)
        hidden = sum(w in lex for w in text.disguised) + sum(w in lex for w in text.spelled)
        return [
            len(hits), len(hits) / n, weight / n, len(begun), len(begun) / n, stem_weight / n, near, near / (len(marked) or 1), *text.own, hidden,
        ]


def learn_lexicons(drawn: DataFrame, most: int) -> list[Lexicon]:
    """Lexicons of labelled texts (text, y, fold): one without each fold, then one of all; at most ``most`` words and stems of each reach the driver.

    A context counts for a lexicon if it stands in any fold but the one left
    out, so all are summed in one pass over the distinct contexts.
    """
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pairs = drawn.select("y", "fold", tokens.alias("w")).select(
        "y", "fold",
        F.explode(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.when(i > 0, F.col("w")[F.greatest(i - 1, F.lit(0))]).alias("before")))),
    )
    contexts = pairs.groupBy("y", "col.word", "col.before").agg(F.bit_or(F.expr("shiftleft(1, fold)")).alias("folds"))
    sides = [(f"{side}{k}", (F.col("y") > 0) == (side == "t"), k) for k in range(FOLDS + 1) for side in "tc"]
    inside = lambda k: F.col("folds").bitwiseAND(F.lit(((1 << FOLDS) - 1) & ~(1 << k))) != 0
    counts = contexts.groupBy("word").agg(*[F.count_if(wanted & inside(k)).alias(n) for n, wanted, k in sides])
    counts = materialise(counts, "toxic-words")
    names = [n for n, _, _ in sides]
    total = counts.agg(*[F.sum(n).alias(n) for n in names]).first()
    beginnings = counts.filter(F.length("word") >= min(STEMS)).select(
        *names, F.explode(F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEMS])).alias("stem")
    )
    forms = [F.count_if(F.col(f"t{k}") > 0).alias(f"forms{k}") for k in range(FOLDS + 1)]
    stems = materialise(beginnings.filter("stem IS NOT NULL").groupBy("stem").agg(*[F.sum(n).alias(n) for n in names], *forms), "toxic-stems")

    def best(entries: DataFrame, key: str, k: int) -> dict[str, float]:
        t, c = F.col(f"t{k}"), F.col(f"c{k}")
        odds = F.log((t + 0.5) / F.lit((total[f"t{k}"] or 0) + 1.0)) - F.log((c + 0.5) / F.lit((total[f"c{k}"] or 0) + 1.0))
        strong = entries.filter(t >= CONTEXTS).select(key, t.alias("t"), odds.alias("odds")).filter(F.col("odds") >= LOG_ODDS)
        return {r[key]: r["odds"] for r in strong.orderBy(F.desc("t"), key).limit(most).select(key, "odds").collect()}

    return [Lexicon(best(counts, "word", k), best(stems.filter(F.col(f"forms{k}") >= STEM_FORMS), "stem", k)) for k in range(FOLDS + 1)]


class Model:
    def __init__(self, lexicon: Lexicon, trees: Calibrated) -> None:
        self.lexicon, self.trees = lexicon, trees


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents that are not held out; no labels: a constant score.

    Folds go by a hash of the text, so equal texts stand in one.  Calibration
    sees predictions for which neither the lexicon nor the trees have seen the row's fold.
    """
    import numpy as np

    with scratch(docs.sparkSession):
        fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
        drawn = materialise(sample(docs, labels, "toxic", rows).select("*", fold), "toxic-sample")
        lexicons = learn_lexicons(drawn, ENTRIES * rows)
        views = lambda texts: [[[x for lexicon in lexicons for x in lexicon.of(t)] for t in map(Parsed, texts)]]
        viewed = map_texts(drawn, ["doc_id", "y", "fold"], views, "x array<double>")
        got = sorted((r["doc_id"], r["y"], r["fold"], r["x"]) for r in viewed.collect())
    x = np.array([r[3] for r in got], float).reshape(-1, FOLDS + 1, len(FEATURES))
    y, fold = np.array([float(r[1] > 0) for r in got]), np.array([r[2] for r in got], int)
    return Model(lexicons[-1], Calibrated(x[:, FOLDS], y, fold, [x[:, k] for k in range(FOLDS)]))


def score(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row's whole text; null counts as empty.  Row-local: no shuffle."""

    def run(texts: list[str]) -> list:
        import numpy as np

        x = np.array([model.lexicon.features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return [model.trees.probability(x)]

    return map_texts(df, ["doc_id"], run, "score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document.

    Null and empty texts are scored as texts without words; a very long text is
    read whole; repeated rows are scored each and equal texts alike; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
