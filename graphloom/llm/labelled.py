"""Labelled samples: the learning side of the contracts (documents whose hash is not held out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0 (a null id is never held out and never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` learnable documents (doc_id, text, y), those of least hash of doc_id; stable between runs.

    The draw is made on the labels alone, so only the drawn ids - at most
    ``rows`` of them, hence broadcast - meet the texts.  A document with
    contradicting or repeated labels counts once, with the larger label.
    """
    drawn = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
