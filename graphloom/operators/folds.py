"""Ordered folds over telemetry: rolling means, best-so-far, exponential averages, early stopping, batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.ordering import ranked
from graphloom.sources.tables import table


def losses(spark: SparkSession, d: str) -> DataFrame:
    """Events as a loss series a user: (epoch = user_id, i, loss = value)."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("epoch"), (F.row_number().over(by) - 1).alias("i"), F.col("value").alias("loss"))


def rolling(series: DataFrame, width: int = 50) -> DataFrame:
    """Trailing mean of ``width`` losses within an epoch; a short beginning is averaged as it is."""
    w = Window.partitionBy("epoch").orderBy("i").rowsBetween(-(width - 1), 0)
    return series.select("epoch", "i", F.round(F.avg("loss").over(w), 6).alias("mean_loss"))


def best_so_far(series: DataFrame) -> DataFrame:
    """Whether a loss is below all before it in its epoch (the first always is)."""
    before = Window.partitionBy("epoch").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return series.select("epoch", "i", "loss", (F.col("loss") < F.coalesce(F.min("loss").over(before), F.lit(float("inf")))).alias("improved"))


#: Losses folded as one array; longer epochs are folded block by block.
BLOCK = 4096


def _first(series: DataFrame, points: int | None) -> DataFrame:
    return series if points is None else series.filter(F.col("i") < points)


def ema(series: DataFrame, decay: float, points: int | None = None, block: int = BLOCK) -> DataFrame:
    """(epoch, n, ema): s = decay x s + (1 - decay) x loss, seeded by the first loss.

    Every ``block`` losses are folded from 0 (the first block from its first
    loss) to one number; an epoch's number is then s = decay^k x s + that of a
    block of k losses.  So a row holds a block, or one number a block.  ``i`` counts an epoch's losses from 0.
    """
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", "loss"))), lambda x: x["loss"])
    cut = _first(series, points).withColumn("_block", F.floor(F.col("i") / block).cast("long"))
    xs = cut.groupBy("epoch", "_block").agg(values.alias("xs"))
    head = F.col("_block") == 0
    rest = F.when(head, F.slice("xs", F.lit(2), F.greatest(F.size("xs") - 1, F.lit(0)))).otherwise(F.col("xs"))
    folded = F.aggregate(rest, F.when(head, F.col("xs")[0]).otherwise(F.lit(0.0)), lambda s, x: decay * s + (1 - decay) * x)
    parts = xs.select("epoch", "_block", F.size("xs").alias("_k"), folded.alias("_s"))
    whole = parts.groupBy("epoch").agg(F.sum("_k").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("_block", "_k", "_s"))).alias("_parts"))
    others = F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0)))
    total = F.aggregate(others, F.col("_parts")[0]["_s"], lambda s, p: F.pow(F.lit(float(decay)), p["_k"]) * s + p["_s"])
    return whole.select("epoch", "n", F.round(total, 6).alias("ema"))


def early_stop(series: DataFrame, patience: int, min_delta: float, points: int | None = None) -> DataFrame:
    """(epoch, stopped_at, best): first position whose counter reaches ``patience``; -1 if none or patience <= 0.

    A loss improves if it is below best - min_delta, and sets the counter to 0.
    A counter may start anywhere, so the ordered rows are read one after the
    other: of an epoch of any length only the best loss, the counter and the
    position are held.
    """
    epoch = series.schema["epoch"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.int32(), pa.float64()), strict=True)], names=["epoch", "stopped_at", "best"])
            done.clear()
            return made

        done: list[tuple] = []
        begun, key, kind = False, None, None
        best, bad, stop, at = math.inf, 0, -1, 0
        for batch in batches:
            kind = batch.schema.field("epoch").type
            for k, x in zip(batch.column("epoch").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                if not begun or k != key:
                    if begun:
                        done.append((key, stop, best))
                    begun, key = True, k
                    best, bad, stop, at = math.inf, 0, -1, 0
                if stop >= 0:
                    continue
                if x is not None and x < best - min_delta:
                    best, bad = x, 0
                else:
                    bad += 1
                    if bad >= patience > 0:
                        stop = at
                at += 1
            if done:
                yield flush()
        if begun:
            done.append((key, stop, best))
            yield flush()

    rows = _first(series, points).select("epoch", "i", F.col("loss").cast("double").alias("loss"))
    return rows.repartition("epoch").sortWithinPartitions("epoch", "i").mapInArrow(run, f"epoch {epoch}, stopped_at int, best double")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Position of every row in a seeded order of its key's hash: reproducible on any partitioning."""
    return ranked(df, [], [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "pos")


def batches(series: DataFrame, size: int, drop_last: bool) -> DataFrame:
    """Add ``batch`` = i div size within an epoch; training drops the last partial batch, validation keeps it."""
    n = F.count(F.lit(1)).over(Window.partitionBy("epoch"))
    full = series.withColumn("batch", F.floor(F.col("i") / size).cast("long")).withColumn("_n", n)
    kept = full.filter(F.col("i") < F.floor(F.col("_n") / size) * size) if drop_last else full
    return kept.drop("_n")


def batch_means(series: DataFrame, size: int = 16, accumulate: int = 2) -> DataFrame:
    """(epoch, n_batches, n_steps, mean_of_means, train_loss): means of batch means, partial batches weighing as much.

    A step closes after every ``accumulate`` batches and after the last;
    train_loss averages only full batches (null if there are none).
    """
    per = batches(series, size, False).groupBy("epoch", "batch").agg(F.avg("loss").alias("m"), F.count(F.lit(1)).alias("k"))
    return per.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.ceil(F.count(F.lit(1)) / accumulate).cast("long").alias("n_steps"),
        F.round(F.avg("m"), 6).alias("mean_of_means"),
        F.round(F.avg(F.when(F.col("k") == size, F.col("m"))), 6).alias("train_loss"),
    )


def step_metrics(spark: SparkSession, d: str) -> DataFrame:
    """(step, metrics): one map a day of counts and totals with prefixed keys."""
    from graphloom.functions.scalars import prefixed

    day = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    ext = prefixed(F.create_map(F.lit("n_events"), F.col("n"), F.lit("n_users"), F.col("users")), "ext/")
    dyn = prefixed(F.create_map(F.lit("errors"), F.col("errors")), "dyn/")
    return day.select("step", F.map_concat(ext, dyn).alias("metrics"))


def metric_rows(steps: DataFrame, prefix: str = "") -> DataFrame:
    """Long form (step, subsystem, metric, value) of metric maps, keys of ``prefix`` only."""
    kept = steps.select("step", F.explode(F.map_filter("metrics", lambda k, _: k.startswith(prefix))))
    return kept.select("step", F.split_part("key", F.lit("/"), F.lit(1)).alias("subsystem"), F.split_part("key", F.lit("/"), F.lit(2)).alias("metric"), "value")
