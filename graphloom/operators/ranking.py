"""Scores, thresholds and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percent_scores(df: DataFrame, kind: str = "kind", weight: str = "weight") -> DataFrame:
    """score = 100 x share of the kind's other nodes with a lower weight (0 for a single node).

    Equal to percent_rank, but from one grouped count a weight: the running
    window sees distinct weights, not rows, so a kind of any size is spread.
    """
    counts = df.groupBy(kind, weight).agg(F.count(F.lit(1)).alias("_k"))
    below = Window.partitionBy(kind).orderBy(weight).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(kind)
    share = F.coalesce(F.sum("_k").over(below), F.lit(0)) / F.nullif(F.sum("_k").over(every) - 1, F.lit(0))
    scored = counts.select(kind, weight, (100 * F.coalesce(share, F.lit(0.0))).alias("score"))
    return df.join(scored, [kind, weight])


def top(df: DataFrame, k: int, score: str = "score", tie: str = "seq") -> DataFrame:
    """First ``k`` by descending score (NaN first), ties by ``tie``, ranked from 1.  A heap per task, no full sort."""
    if k < 0:
        raise ValueError("k must not be negative")
    best = df.orderBy(F.desc(score), F.asc(tie)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(tie))))


def alerts(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Nodes at or above the threshold."""
    return df.filter(F.col(score) >= threshold)
