"""Rates, accelerations, densities and cutoffs over time.  Formulas are our own definitions.

Temporal queries return every row with its ratio and a flag, so that quiet
data still give a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import table


def month_index(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def dense(counts: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """One row for every key and every step between the first and last step of all: missing values are 0."""
    ends = counts.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    keys = counts.select(key).distinct().join(F.broadcast(ends))
    grid = keys.select(key, F.explode(F.sequence("lo", "hi")).alias(at))
    return grid.join(counts, [key, at], "left").select(key, at, F.coalesce(value, F.lit(0)).alias(value))


def pre_breakthrough(spark: SparkSession, d: str) -> DataFrame:
    """(brand, month, n, velocity, acceleration, candidate) of part brands by month of shipping."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), month_index(F.col("l_shipdate")).alias("month"))
    n = lines.join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand")), "p_partkey").groupBy("brand", "month").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("brand").orderBy("month")
    full = dense(n, "brand", "month", "n").withColumn("velocity", F.col("n") - F.lag("n").over(by))
    full = full.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(by))
    return full.withColumn("candidate", F.coalesce((F.col("velocity") > 0) & (F.col("acceleration") > 0), F.lit(False)))


def convergence(spark: SparkSession, d: str, window: int = 12) -> DataFrame:
    """(brand, year, density, acceleration, pressure, score): distinct pairs x second yearly difference x pressure / window squared.

    Pressure = lines x mean(1 - discount) x distinct suppliers.
    """
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    by = lines.groupBy("brand", F.year("l_shipdate").alias("year")).agg(
        F.count_distinct("l_suppkey", "l_partkey").alias("density"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.avg(1 - F.col("l_discount")).alias("mood")
    )
    w = Window.partitionBy("brand").orderBy("year")
    return (
        by.withColumn("acceleration", F.col("n") - 2 * F.lag("n", 1).over(w) + F.lag("n", 2).over(w))
        .withColumn("pressure", F.round(F.col("n") * F.col("mood") * F.col("n_suppliers"), 4))
        .withColumn("score", F.round(F.col("density") * F.col("acceleration") * F.col("n") * F.col("mood") * F.col("n_suppliers") / (window * window), 5))
        .select("brand", "year", "density", "acceleration", "pressure", "score")
    )


def entropy_alerts(spark: SparkSession, d: str, days: int = 7, drop: float = 0.05) -> DataFrame:
    """(day, entropy, before, alert): Shannon entropy of event types a day, against the mean of the ``days`` before."""
    n = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("day").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    e = total.select("day", F.round(F.log("t") - F.col("nlogn") / F.col("t"), 9).alias("entropy"))
    before = F.round(F.avg("entropy").over(Window.orderBy("day").rowsBetween(-days, -1)), 6)
    return e.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("entropy", 6).alias("entropy"), before.alias("before")).withColumn(
        "alert", F.coalesce(F.col("entropy") < F.col("before") - drop, F.lit(False))
    )


def zone_density(spark: SparkSession, d: str, least: float = 2.5) -> DataFrame:
    """(event_type, hour, n, density, dense): events of an hour over the type's mean over its observed hours."""
    n = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    mean = n.groupBy("event_type").agg(F.avg("n").alias("mean"))
    return n.join(mean, "event_type").select(
        "event_type", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n", F.round(F.col("n") / F.col("mean"), 6).alias("density"), (F.col("n") >= least * F.col("mean")).alias("dense")
    )


def in_zones(events: DataFrame, zones: DataFrame) -> DataFrame:
    """``events`` (ts) with the ``zones`` (zone_id, zone_start, zone_end, multiplier) they fall in, start inclusive.

    Zones are a dimension, broadcast; an event outside all zones has nulls.
    """
    at = (F.col("ts") >= F.col("zone_start")) & (F.col("ts") < F.col("zone_end"))
    return events.join(F.broadcast(zones), at, "left")


def dormant(spark: SparkSession, d: str, hours: int = 48) -> DataFrame:
    """(event_id, user_id, gap_seconds, reactivated): gap to the user's event before; null for the first."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(by), F.col("ts"))
    return table(spark, d, "events").select("event_id", "user_id", gap.alias("gap_seconds")).withColumn(
        "reactivated", F.coalesce(F.col("gap_seconds") >= hours * 3600, F.lit(False))
    )


def velocity_doubling(spark: SparkSession, d: str, months: int = 18) -> DataFrame:
    """(month, n, ratio, doubled): orders of a month against ``months`` months before, on a dense calendar."""
    n = table(spark, d, "orders").groupBy(F.lit("all").alias("k"), month_index(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n", months).over(Window.partitionBy("k").orderBy("month"))
    return dense(n, "k", "month", "n").select("month", "n", F.round(F.try_divide(F.col("n"), before), 6).alias("ratio")).withColumn(
        "doubled", F.coalesce(F.col("ratio") >= 2, F.lit(False))
    )


def sync_acceleration(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, correlation): event types whose daily counts move together."""
    n = table(spark, d, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    full = dense(n, "event_type", "day", "n")
    a, b = full.select(F.col("event_type").alias("a"), "day", F.col("n").alias("x")), full.select(F.col("event_type").alias("b"), "day", F.col("n").alias("y"))
    return a.join(b, "day").filter("a < b").groupBy("a", "b").agg(F.round(F.corr("x", "y"), 6).alias("correlation"))


def investment_velocity(spark: SparkSession, d: str) -> DataFrame:
    """(segment, first_total, last_total, ratio): order value of a market segment in its last year over its first."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    by = o.groupBy("segment", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("total"))
    ends = by.groupBy("segment").agg(F.min_by("total", "year").alias("f"), F.max_by("total", "year").alias("l"))
    return ends.select("segment", F.round("f", 2).alias("first_total"), F.round("l", 2).alias("last_total"), F.round(F.try_divide("l", "f"), 6).alias("ratio"))


def time_warp(spark: SparkSession, d: str, cutoff: str = "1999-01-01") -> DataFrame:
    """(custkey, n_before, n_after, predicted, happened): active before the cutoff, and after it; nothing later is used for the prediction."""
    past = F.col("o_orderdate") < F.lit(cutoff).cast("timestamp_ntz")
    by = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count_if(past).alias("n_before"), F.count_if(~past).alias("n_after"))
    return by.select("*", (F.col("n_before") >= 5).alias("predicted"), (F.col("n_after") >= 3).alias("happened"))


def retrospective(split: DataFrame) -> DataFrame:
    """Hits, misses, false alarms, precision and recall of a time-warp split."""
    p, h = F.col("predicted"), F.col("happened")
    counts = split.agg(F.count_if(p & h).alias("hits"), F.count_if(~p & h).alias("missed"), F.count_if(p & ~h).alias("false_alarms"))
    return counts.select(
        "*", F.round(F.try_divide(F.col("hits"), F.col("hits") + F.col("false_alarms")), 6).alias("precision"), F.round(F.try_divide(F.col("hits"), F.col("hits") + F.col("missed")), 6).alias("recall")
    )


#: Scenarios of one aggregate: more would not be compiled as one stage.
TOGETHER = 20


def what_if(spark: SparkSession, d: str, scenarios: int = 100) -> DataFrame:
    """(scenario, n, mean_value): in each scenario an event stays if (7919 x event_id + 104729 x scenario) mod 1000 < 500.

    One conditional count and sum a scenario, TOGETHER scenarios in an
    aggregate: an event is read once for these and never multiplied.
    """
    events = table(spark, d, "events").select("event_id", "value")
    stays = lambda s: (F.col("event_id") * 7919 + s * 104729) % 1000 < 500

    def some(ids: range) -> DataFrame:
        sums = events.agg(*[x for s in ids for x in (F.count_if(stays(s)).alias(f"n{s}"), F.avg(F.when(stays(s), F.col("value"))).alias(f"m{s}"))])
        rows = [F.struct(F.lit(s).alias("scenario"), F.col(f"n{s}").alias("n"), F.round(F.col(f"m{s}"), 6).alias("mean_value")) for s in ids]
        return sums.select(F.inline(F.array(*rows))).filter("n > 0")

    return reduce(DataFrame.unionByName, [some(range(a, min(a + TOGETHER, scenarios))) for a in range(0, scenarios, TOGETHER)])
