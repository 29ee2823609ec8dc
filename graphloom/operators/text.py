"""Concepts in documents: tokens, co-occurrence, credibility, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import together
from graphloom.operators.ordering import ranked, shuffle_width, small
from graphloom.sources.shared import materialise, release
from graphloom.sources.tables import table


def keywords(docs: DataFrame, k: int = 32, least: int = 4) -> DataFrame:
    """(doc_id, token): the ``k`` most telling words of each document, by count in it x ln(documents / documents with the word).

    Ties by token.  Counts and frequencies cover all words of all texts.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{%d,}" % least), F.lit(0))
    terms = materialise(docs.select("doc_id", F.explode(words).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf")), "terms")
    often = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    telling = F.round(F.col("tf") * F.log(F.lit(float(max(1, docs.count()))) / F.col("df")), 6)
    best = Window.partitionBy("doc_id").orderBy(telling.desc(), "token")
    return terms.join(often, "token").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("doc_id", "token")


def cooccurrence(docs: DataFrame, k: int = 32, least: int = 3) -> DataFrame:
    """(a, b, n): keywords that ``least`` documents or more have in common.

    A document's ``k`` keywords are its concepts, so it makes at most k (k - 1) / 2
    pairs whatever its length; ``all_cooccurrence`` counts the pairs of all words.
    """
    listed = keywords(docs, k).groupBy("doc_id").agg(F.array_sort(F.collect_list("token")).alias("ts"))
    later = lambda x, i: F.transform(F.slice("ts", i + 2, F.size("ts")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = listed.select(F.explode(F.flatten(F.transform("ts", later))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


#: Tokens of one range at most: two arrays of counts of that length fit a core's cache.
BLOCK = 1 << 18
#: Ranges of tokens at least, and (document, token) rows of one range at most, but for one bucket: a cell of two ranges is one task.
RANGES = 7
HELD = 10_000_000
#: Buckets of tokens whose sizes the driver reads to cut the ranges.
BUCKETS = 4_096
#: Token names are broadcast up to so many (about 60 bytes each); a range's names go to its cells.
NAMES = 500_000
TOKENS = 1_000_000


def _bounds(named: DataFrame, block: int) -> list[int]:
    """Where ranges of token numbers start, and the end of the last: near equal in rows, each of about ``block`` numbers at most."""
    tokens = named.count()
    step = max(1, min(block, -(-tokens // BUCKETS)))
    sizes = named.groupBy(F.floor(F.col("id") / step).alias("at")).agg(F.sum("df").alias("n")).sort("at").collect()
    total = sum(r["n"] for r in sizes)
    k, before, bounds, last = max(RANGES, -(-total // HELD)), 0, [], None
    for at, n in sizes:
        key = (before * k // total, at * step // block)
        if key != last:
            bounds.append(at * step)
        before, last = before + n, key
    return [*bounds, tokens]


def all_cooccurrence(docs: DataFrame, least: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b, n): all pairs a < b of tokens that stand together in ``least`` documents or more, without a bound on tokens.

    A token of fewer than ``least`` documents is in no such pair, so leaving it
    out loses nothing.  Tokens are numbered in their order and cut into ranges;
    every two ranges are a cell, one task, that counts its pairs in arrays
    (``together``).  A document's numbers travel once for each range that it
    meets, pairs only when they are counted.  Rows of one doc_id are one
    document, rows without are none.
    """
    spark = docs.sparkSession
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    listed = materialise(docs.filter("doc_id IS NOT NULL").select("doc_id", words.alias("ts")), "words")
    tokens = listed.select("doc_id", F.explode("ts").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    named = materialise(ranked(often, [], ["token"], "id"), "token-ids")
    bounds = _bounds(named, block)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    numbers = tokens.join(small(named.select("token", "id"), TOKENS), "token").select("doc_id", F.col("id").cast("int").alias("id"))
    sets = materialise(numbers.mapInArrow(together.gathered, f"{kind}, ids binary"), "sets")
    release(listed)
    cells, layout = together.cells(len(bounds) - 1), "cell int, side int, x binary, y binary"
    parts = sets.repartition(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id").mapInArrow(together.dealt(bounds), layout)
    ranges = F.broadcast(spark.createDataFrame([(r, *bounds[r : r + 2]) for r in range(len(bounds) - 1)], "r int, lo long, hi long"))
    wanted = F.broadcast(spark.createDataFrame([(c, side + 1, r) for c, cell in enumerate(cells) for side, r in enumerate(cell)], "cell int, side int, r int"))
    inside = named.join(ranges, (F.col("id") >= F.col("lo")) & (F.col("id") < F.col("hi"))).groupBy("r").agg(F.array_sort(F.collect_list(F.struct("id", "token"))).alias("ts"))
    names = inside.join(wanted, "r").select("cell", "side", F.array_join("ts.token", "\n").cast("binary").alias("x"), F.lit("").cast("binary").alias("y"))
    dealt = parts.unionByName(names).repartitionById(max(1, len(cells)), "cell")
    return dealt.mapInArrow(together.counted(bounds, least), "a string, b string, n long")


def consolidate(spark: SparkSession, d: str) -> DataFrame:
    """(source, n_docs, mass, mean_chars): credibility-weighted mean length a source.

    Credibility is the share of good labels of a source (1 without labels); mass its sum over documents.
    """
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    known = docs.join(labels, "doc_id").groupBy("source").agg(F.avg(F.col("quality").cast("double")).alias("cred"))
    weighted = docs.select("source", "n_chars").join(small(materialise(known, "known"), NAMES), "source", "left").withColumn("w", F.coalesce("cred", F.lit(1.0)))
    return weighted.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("w"), 4).alias("mass"), F.round(F.try_divide(F.sum(F.col("w") * F.col("n_chars")), F.sum("w")), 4).alias("mean_chars")
    )


def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, canonical_id): 12 bytes as hex - one of source, one of language, ten of the text's md5; layout is our own."""
    one = lambda c: F.substring(F.md5(F.coalesce(F.col(c), F.lit("")).cast("binary")), 1, 2)
    return table(spark, d, "documents").select(
        "doc_id", F.concat(one("source"), one("lang"), F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 20)).alias("canonical_id")
    )


def orphan_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(label, n_vectors, n_good, orphan): clusters of vectors none of whose documents is labelled good."""
    good = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("g")).distinct()
    met = table(spark, d, "embeddings").select("vec_id", "label").join(good, "vec_id", "left")
    by = met.groupBy("label").agg(F.count(F.lit(1)).alias("n_vectors"), F.count("g").alias("n_good"))
    return by.withColumn("orphan", F.col("n_good") == 0)


def iceberg(spark: SparkSession, d: str) -> DataFrame:
    """(source, n_informal, n_formal, ratio): unlabelled against labelled documents of a source."""
    marked = table(spark, d, "labels").select("doc_id", F.lit(1).alias("l")).distinct()
    by = table(spark, d, "documents").join(marked, "doc_id", "left").groupBy("source").agg(
        F.count_if(F.col("l").isNull()).alias("n_informal"), F.count("l").alias("n_formal")
    )
    return by.withColumn("ratio", F.round(F.try_divide("n_informal", "n_formal"), 6))
