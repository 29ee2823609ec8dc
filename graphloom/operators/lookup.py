"""Text to node resolution and edge checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def resolve(node: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, node_id, text, tier) of the first exact match in node order, else the first node containing the needle.

    ``needles`` is a stated, small query set; each node meets it in the map
    stage and only the best match of a task and needle is shuffled.  Both tiers
    ignore case; the empty needle matches the first node; a needle without
    match gives no row.
    """
    low, want = F.lower("text"), F.lower("needle")
    met = node.join(F.broadcast(needles), F.contains(low, want))
    tier = F.when(low == want, 0).otherwise(1)
    best = met.groupBy("needle").agg(F.min(F.struct(tier.alias("tier"), "seq", "node_id", "text")).alias("b"))
    return best.select("needle", "b.node_id", "b.text", "b.tier")


def existing(edge: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the stored edge between them: forward preferred, else reverse, else nulls."""
    fwd = edge.select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.col("total_weight").alias("forward_weight"))
    back = edge.select(F.col("tgt").alias("a"), F.col("src").alias("b"), F.col("total_weight").alias("reverse_weight"))
    both = pairs.join(fwd, ["a", "b"], "left").join(back, ["a", "b"], "left")
    direction = F.when(F.col("forward_weight").isNotNull(), "forward").when(F.col("reverse_weight").isNotNull(), "reverse").otherwise("none")
    return both.select("a", "b", direction.alias("direction"), F.coalesce("forward_weight", "reverse_weight").alias("total_weight"))


def matched_edges(node: DataFrame, edge: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts`` (src, tgt) with the first two nodes whose text contains either of them, in node order, and the stored edge between these, if any.

    Case is ignored; fewer than two such nodes give no row.  ``texts`` is a
    stated, small query set; a task keeps two nodes of a pair before anything is shuffled.
    """
    low = F.lower("text")
    met = node.join(F.broadcast(texts), F.contains(low, F.lower("src")) | F.contains(low, F.lower("tgt")))
    order = Window.partitionBy("src", "tgt").orderBy("seq")
    two = met.withColumn("r", F.row_number().over(order)).filter("r <= 2")
    ends = two.groupBy("src", "tgt").agg(F.max(F.when(F.col("r") == 1, F.col("node_id"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("node_id"))).alias("b"))
    ends = ends.filter("b IS NOT NULL")
    return ends.join(existing(edge, ends.select("a", "b").distinct()), ["a", "b"]).select("src", "tgt", "a", "b", "direction", "total_weight")


def literal(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)
