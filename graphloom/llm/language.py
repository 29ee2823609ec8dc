"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own texts; a text
belongs to the language whose dictionary compresses it best.  The margin to the
second best tells how sure that is.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import map_texts, materialise, release, small, table
from graphloom.llm.labelled import held_out

#: A dictionary is learned from about so many parts of texts, of so many characters at most, and holds at most so many bytes.
#: Parts are drawn from everywhere in whole texts.  Beyond LANGUAGES languages fewer are drawn and kept of each, so that
#: all dictionaries together stay as large as LANGUAGES full ones.
DICTIONARY_BYTES = 256 << 10
SAMPLE_PARTS = 250
SAMPLE_CHARS = 2_000
LANGUAGES = 64
#: Counts, a row a language, are broadcast up to so many rows.
LANGUAGE_ROWS = 200_000
LEVEL = 9
#: Below this relative margin a prediction counts as rejected.
MARGIN = 0.01
UNKNOWN = "und"

GAPS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    """Lower-case letters, everything else one space: case, digits and marks say little about the language."""
    return GAPS.sub(" ", text.lower()).strip()


def train(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary of each language, from documents that are not held out (columns doc_id, text, lang).

    Every language is learned.  Whole texts are cut into parts of SAMPLE_CHARS;
    a language's parts are drawn by a hash of (doc_id, part) below a share of
    their number, so the draw is one filter, stable between runs and no larger
    for a language that holds most rows.  Of repeated rows of a doc_id in a
    language the least text of a part counts.
    """
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    place = lambda part: F.pmod(F.xxhash64("doc_id", part), F.lit(1 << 32))
    parts = F.sequence(F.lit(0), F.expr(f"int(greatest(length(text) - 1, 0) div {SAMPLE_CHARS})"))
    each = able.select("lang", "doc_id", F.explode(parts).alias("part")).distinct()
    # a small share can draw nothing by chance: the first part of least hash of each language is always in it
    counts = materialise(each.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(place(F.col("part"))).alias("first")), "languages")
    full = max(1.0, counts.count() / LANGUAGES)
    wanted, size = max(1, int(SAMPLE_PARTS / full)), max(1, int(DICTIONARY_BYTES / full))
    drawn = lambda i: (place(i).cast("double") * F.col("count") < F.lit(float(wanted << 32))) | (place(i) == F.col("first"))
    taken = (
        able.select("doc_id", "lang", "text")
        .join(small(counts, LANGUAGE_ROWS), "lang")
        .select("doc_id", "lang", "text", F.explode(F.filter(parts, drawn)).alias("part"))
        .select("doc_id", "lang", "part", F.substring("text", F.col("part") * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)).alias("text"))
        .groupBy("lang", "doc_id", "part")
        .agg(F.min("text").alias("text"))
        .orderBy(F.xxhash64("doc_id", "part"), "doc_id", "part")
    )
    found: dict[str, list[bytes]] = {}
    for row in taken.collect():
        found.setdefault(row["lang"], []).append(normalised(row["text"]).encode())
    release(counts)
    return {lang: b" ".join(texts)[:size] for lang, texts in sorted(found.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as zs

        self.languages = list(dictionaries)
        self.compressors = []
        for raw in dictionaries.values():
            entry = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
            entry.precompute_compress(level=LEVEL)
            self.compressors.append(zs.ZstdCompressor(level=LEVEL, dict_data=entry, write_content_size=False))

    def predict(self, text: str) -> tuple[str, float, float]:
        """(language, score, margin).  Null, empty or letterless text: ('und', 0, 0); ties go to the first language."""
        clean = normalised(text)
        if not self.languages or not any(map(str.isalpha, clean)):
            return UNKNOWN, 0.0, 0.0
        data = clean.encode()
        sizes = [len(c.compress(data)) for c in self.compressors]
        best = min(sizes)
        at = sizes.index(best)
        second = min(sizes[:at] + sizes[at + 1 :], default=2 * best)
        margin = 1 - best / second
        # even odds without a margin, near 1 from a margin of a tenth on
        return self.languages[at], 1 - 0.5 * 2 ** (-margin / 0.02), margin


_classifiers: dict[str, Classifier] = {}


def identify(df: DataFrame, dictionaries: dict[str, bytes], carry: list[str]) -> DataFrame:
    """Columns ``carry`` with lang_pred, score, margin and rejected (margin below MARGIN) of the whole text.

    Row-local.  The dictionaries (about LANGUAGES x DICTIONARY_BYTES at most) travel
    as a broadcast variable and are indexed once a worker process.
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)
    model = uuid.uuid4().hex

    def run(texts: list[str]) -> list[list]:
        if model not in _classifiers:
            _classifiers.clear()
            _classifiers[model] = Classifier(shared.value)
        found = [_classifiers[model].predict(t) for t in texts]
        return [[f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [f[2] < MARGIN for f in found]]

    return map_texts(df, carry, run, "lang_pred string, score double, margin double, rejected boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language.

    Null, empty and letterless texts are 'und' with score 0; a very long text is
    compressed whole; ties go to the first language by name; repeated rows are
    predicted each; an empty table gives no rows; other columns are not read,
    whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
