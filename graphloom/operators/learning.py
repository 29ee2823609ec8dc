"""Tensor-shaped steps as relations: feature projection, message passing, link and node scores, training telemetry.

There is no trained network here; formulas are our own definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import graph
from graphloom.functions import scalars


def or_zero(vector: Column, dimension: int) -> Column:
    """The vector if it has the wanted length, else zeros."""
    zeros = F.array_repeat(F.lit(0.0), dimension)
    return F.when(F.coalesce(F.size(vector) == dimension, F.lit(False)), vector).otherwise(zeros)


def node_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, x array<double>): year of a century, acceleration, zone; zeros for a node without a time."""
    n = graph.nodes(spark, d)
    year = (scalars.approx_year(F.col("ts_sec")) - 1900) / F.lit(100.0)
    known = F.when(F.col("ts_sec") != 0, F.array(year, F.col("acceleration_multiplier"), F.col("zone_multiplier")))
    return n.select("node_id", or_zero(known, 3).alias("x"))


def edge_vectors(edge: DataFrame, build: Callable[[DataFrame], Column] | None = None, dimension: int = 3) -> DataFrame:
    """Regular edges with x array<double>: what ``build`` makes of an edge, zeros where it gives null or another length.

    ``edge`` has the ends attached (``source_zone``).  By default: deliveries in
    tens, logarithm of the weight (none for a weight that is not positive), the source's zone.
    """
    def usual(e: DataFrame) -> Column:
        return F.when(e["total_weight"] > 0, F.array(e["n_obs"] / F.lit(10.0), F.log1p(e["total_weight"]), e["source_zone"]))

    regular = edge.filter(~F.col("is_containment"))
    return regular.select("src", "tgt", or_zero((build or usual)(regular), dimension).alias("x"))


def predicted(vectors: DataFrame, weights: tuple[float, ...] = (1.0, 0.5, 0.25), bias: float = -1.5) -> DataFrame:
    """(node_id, score): logistic score of a node's vector; the weights are ours, a trained model's may stand in their place."""
    total = F.aggregate(F.zip_with("x", F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(float(bias)), lambda s, v: s + v)
    return vectors.select("node_id", (1 / (1 + F.exp(-total))).alias("score"))


def message_passing(spark: SparkSession, d: str, rounds: int = 2) -> DataFrame:
    """(node_id, a, b, c): ``rounds`` times the mean of a node's own values and the mean of its strong neighbours' values.

    A round is one join and one grouped mean; the plan grows with the stated number of rounds.
    Means are rounded after a ten-billionth is added: values in the middle of two
    steps then round alike, in whatever order they were summed.
    """
    e = graph.strong(spark, d).select(graph.named("S", F.col("s")).alias("src"), graph.named("P", F.col("p")).alias("tgt"))
    both = e.unionByName(e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))
    now = node_vectors(spark, d).select("node_id", *[F.col("x")[i].alias(c) for i, c in enumerate("abc")])
    for _ in range(rounds):
        near = both.join(now, both["src"] == now["node_id"]).groupBy("tgt").agg(*[F.avg(c).alias(f"n_{c}") for c in "abc"])
        met = now.join(near, now["node_id"] == near["tgt"], "left")
        now = met.select("node_id", *[((F.col(c) + F.coalesce(f"n_{c}", c)) / 2).alias(c) for c in "abc"])
    return now.select("node_id", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in "abc"])


def topology(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, degree, strength, mean_weight) of every node, nulls where it has no supply edge."""
    s = graph.supply(spark, d)
    sides = [graph.named("S", F.col("suppkey")), graph.named("P", F.col("partkey"))]
    parts = [s.groupBy(k.alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("n_obs").alias("strength"), F.round(F.avg("total_weight"), 4).alias("mean_weight")) for k in sides]
    return graph.nodes(spark, d).select("node_id").join(parts[0].unionByName(parts[1]), "node_id", "left")


def epoch_progress(series: DataFrame, accumulate: int = 2, size: int = 16) -> DataFrame:
    """(epoch, i, progress, scaled, norm, closes): share done, loss over the accumulation count, running L2 norm, step ends.

    The loss is divided by ``accumulate`` also in a short last group.
    """
    by = Window.partitionBy("epoch").orderBy("i")
    each = Window.partitionBy("epoch")
    done = (F.col("i") + 1) / F.count(F.lit(1)).over(each)
    last = F.lead("i").over(by).isNull()
    return series.select(
        "epoch", "i", F.round(done, 6).alias("progress"), F.round(F.col("loss") / accumulate, 6).alias("scaled"),
        F.round(F.sqrt(F.sum(F.col("loss") * F.col("loss")).over(by.rowsBetween(Window.unboundedPreceding, 0))), 6).alias("norm"),
        (((F.col("i") + 1) % accumulate == 0) | last).alias("closes"),
    )


def eta(elapsed: Column, progress: Column) -> Column:
    """Time left: elapsed / progress x (1 - progress); null at the start."""
    return F.try_divide(elapsed, progress) * (1 - progress)


def weighted_loss(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of the parts by their weights (missing: 1)."""
    total = F.lit(0.0)
    for name, part in parts.items():
        total = total + part * weights.get(name, 1.0)
    return total


def matched(shadow: DataFrame, live: DataFrame, decay: float) -> DataFrame:
    """Shadow values moved towards live ones, by name; names on one side only drop out."""
    both = shadow.alias("s").join(live.alias("l"), "name")
    return both.select("name", (decay * F.col("s.value") + (1 - decay) * F.col("l.value")).alias("value"))
