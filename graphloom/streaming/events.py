"""Event streams from files: daily and sliding counts, sessions, running averages as custom state, resumable runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from graphloom.sources.shared import fresh_path


def source(spark: SparkSession, d: str, watermark: str = "1 hour") -> DataFrame:
    """``events`` as a file stream; times without zone are read as UTC, since watermarks need an instant."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # the file source reads folders, so the table is named by a pattern
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parquet*")
    return stream.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).withWatermark("ts", watermark)


def drained(query: Callable[[str], StreamingQuery], spark: SparkSession, name: str, out: str | None = None) -> DataFrame:
    """Run a query to the end of what is there; its Parquet result.

    ``out`` names a folder of result and checkpoint: a later run with the same
    folder resumes after the files that this one has read.  Without it a run is its own.
    """
    out = out or fresh_path(spark, f"stream-{name}")
    started = query(out)
    started.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def _to_parquet(df: DataFrame, out: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()


def _whole(df: DataFrame, trigger: dict | None = None) -> Callable[[str], StreamingQuery]:
    """Starts ``df`` in complete mode: each batch replaces the result.  ``trigger``: all there is by default, or e.g. processingTime."""
    def start(out: str) -> StreamingQuery:
        keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/data")
        return df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").outputMode("complete").trigger(**(trigger or {"availableNow": True})).start()

    return start


def daily(spark: SparkSession, d: str, out: str | None = None) -> DataFrame:
    """(day, event_type, n, total) of all days: the stream's state is rewritten whole each batch (complete mode)."""
    days = source(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    shown = days.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
    return drained(_whole(shown), spark, "daily", out)


def sliding(spark: SparkSession, d: str, width: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """(start, n): events in windows of ``width`` that begin every ``slide``."""
    counted = source(spark, d).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return drained(_whole(counted.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH").alias("start"), "n")), spark, "sliding")


def averages(spark: SparkSession, d: str, decay: float = 0.9, out: str | None = None) -> DataFrame:
    """(epoch, n, ema) of each user's values in order of time, as state of the stream: s = decay x s + (1 - decay) x value, seeded by the first.

    State is two numbers a user and survives a resumed run; inside a batch a
    user's rows are put in order.  The newest row of a user is the result.
    """
    def fold(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        n, s = state.get if state.exists else (0, 0.0)
        for x in pd.concat(list(frames)).sort_values(["ts", "event_id"])["value"]:
            s = float(x) if n == 0 else decay * s + (1 - decay) * float(x)
            n += 1
        state.update((n, s))
        yield pd.DataFrame({"epoch": [key[0]], "n": [n], "s": [s]})

    rows = source(spark, d).select("user_id", "ts", "event_id", "value").filter("value IS NOT NULL")
    folded = rows.groupBy("user_id").applyInPandasWithState(fold, "epoch long, n long, s double", "n long, s double", "update", "NoTimeout")

    def start(out: str) -> StreamingQuery:
        keep = lambda batch, _: batch.write.mode("append").parquet(f"{out}/data")
        return folded.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").outputMode("update").trigger(availableNow=True).start()

    found = drained(start, spark, "averages", out)
    return found.groupBy("epoch").agg(F.max_by(F.struct("n", "s"), "n").alias("x")).select("epoch", F.col("x.n").cast("int").alias("n"), F.round("x.s", 6).alias("ema"))


def sessions(spark: SparkSession, d: str, gap: str = "1 hour") -> DataFrame:
    """(user_id, n, seconds) of sessions that the watermark has closed; open ones at the end are not emitted."""
    by = source(spark, d).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    shown = by.select("user_id", "n", (F.unix_timestamp("hi") - F.unix_timestamp("lo")).alias("seconds"), F.date_format("lo", "yyyy-MM-dd HH:mm:ss").alias("started"))
    return drained(lambda out: _to_parquet(shown, out), spark, "sessions")
