"""Sharding by weighted rendezvous hashing of stable record keys (DataFrame functions only).

Every (key, shard) pair has a hash drawn to a uniform number u; the shard with
the least ``-ln(u) / weight`` owns the key.  Adding shard n can only replace
the minimum by n itself, so growth moves about 1/(n+1) of the rows, all into
the new shard, and no row between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ranked, table

SALT = "rendezvous"
SHARDS = 16


def cost(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Exponential variate of rate ``weight`` that key and shard number alone decide."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SALT), key.cast("string"), F.lit(shard)), 11)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def owner(key: Column, weights: Sequence[float]) -> Column:
    """0-based shard of ``key``; a null key is a key like any other, ties go to the lower shard."""
    costs = F.array(*[cost(key, j, w) for j, w in enumerate(weights)])
    return (F.array_position(costs, F.array_min(costs)) - 1).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Add ``shard`` (and ``grown_shard`` under the longer list ``grown``) to every row.

    No shuffle.  Repeated rows get the same shard; a null key hashes like a
    value; columns of ``df`` with these names are replaced.
    """
    out = df.withColumn("shard", owner(F.col(key), weights))
    return out.withColumn("grown_shard", owner(F.col(key), grown) if grown is not None else F.lit(None).cast("int"))


def write(df: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """One folder a shard; a large shard is several files, each task writes what it holds."""
    df.write.option("maxRecordsPerFile", max_records).partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards by ``doc_id`` (law ``key``), with a gapless slot in each.

    Null text counts as empty: size 1, CRC 0.  An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(docs["text"], F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(narrow, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return ranked(placed, ["shard"], ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
