"""Row numbers in groups of any size.

A range exchange spreads a hot group over many tasks, and only one count a
(task, group) is summed up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import materialise, release

#: ``ranked`` broadcasts its table of offsets up to this many rows (about 100 bytes each).
BROADCAST_ROWS = 100_000


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if ``df`` (materialised, so counting is cheap) has at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def safe_eq(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it needs to be no name of ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 .. in each group by ``order``, without gathering a group in one task.

    A range exchange reads its input twice, once for a sample, so ``df`` is
    written first, if it is not a written table already.  Rows that tie in every
    column of ``order`` are numbered in an arbitrary but fixed order (the ranked
    rows are written once and read from there).  Keep ``df`` narrow: all its
    columns travel; they may have any names.  An empty input gives an empty table.
    """
    spark = df.sparkSession
    task, at, n, first, shift = unused([*df.columns, name], "_task", "_at", "_n", "_first", "_shift")
    keys = [F.col(g) for g in groups] + [F.col(o) if isinstance(o, str) else o for o in order]
    once = df if hasattr(df, "graphloom_path") else materialise(df, "unranked")
    dealt = (
        once.repartitionByRange(shuffle_width(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn(task, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    rows = materialise(dealt, "ranked")
    if once is not df:
        release(once)
    counts = rows.groupBy(task, *groups).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(first))
    before = Window.partitionBy(*groups).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(
        counts.select(task, *groups, (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).alias(shift)), "starts"
    )
    return (
        rows.join(small(starts, BROADCAST_ROWS), safe_eq(rows, starts, [task, *groups]))
        .select(*[rows[c] for c in df.columns], (rows[at] + starts[shift]).alias(name))
    )
