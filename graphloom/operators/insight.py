"""Analytics over knowledge in time: anchors, registries, reactivation, gaps between discoveries, predictions, communities.

Formulas and thresholds are our own definitions; each docstring states them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import graph
from graphloom.functions import scalars
from graphloom.operators import structure, temporal
from graphloom.operators.ordering import ranked, small
from graphloom.sources.shared import materialise
from graphloom.sources.tables import table

#: A registry or a label table is broadcast up to so many rows (about 60 bytes each).
NAMES = 500_000
#: Convergence above this announces a breakthrough in so many months; not on the 0-100 scale of scan scores.
BREAKTHROUGH = 1_000.0
AHEAD = (12, 24)
#: Months until a prediction, from all conditions met to none.
EMERGENCE = (18, 36)


def anchored(spark: SparkSession, d: str) -> DataFrame:
    """(s, p, first): deliveries whose supplier had delivered another part before.

    A semi join on an earlier neighbour: with the supplier's earliest date known
    the neighbour need not be looked up, so nothing is joined pair by pair.
    """
    first = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(F.min("l_shipdate").alias("first"))
    begun = first.groupBy("s").agg(F.min("first").alias("begun"))
    return first.join(begun, "s").filter("begun < first").select("s", "p", F.date_format("first", "yyyy-MM-dd").alias("first"))


def registry(values: DataFrame, column: str) -> DataFrame:
    """(value, id): distinct non-null values numbered in their order, without gaps."""
    return ranked(values.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct(), [], ["value"], "id")


def registered(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source_id, lang_id): dimensions of documents as numbers of a global registry; null stays null."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    for name in ("source", "lang"):
        known = small(materialise(registry(docs, name), "registry"), NAMES).select(F.col("value").alias(name), F.col("id").alias(f"{name}_id"))
        docs = docs.join(known, name, "left")
    return docs.select("doc_id", "source_id", "lang_id")


def reactivated(spark: SparkSession, d: str, hours: int = 48, near: int = 24, groups: int = 10) -> DataFrame:
    """(event_id, user_id, gap_seconds, neighbour_gap, reactivated): users that come back after ``hours`` while a neighbour was active.

    Neighbours are users of the same number modulo ``groups``; a neighbour is
    active if the group's event before is at most ``near`` hours old.  A gap of
    the user longer than that makes the event another user's.
    """
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    group = Window.partitionBy("g").orderBy("ts", "event_id")
    since = lambda w: F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.pmod("user_id", F.lit(groups)).alias("g"))
    e = e.withColumn("gap_seconds", since(own)).withColumn("neighbour_gap", since(group))
    back = (F.col("gap_seconds") >= hours * 3600) & (F.col("neighbour_gap") <= near * 3600)
    return e.select("event_id", "user_id", "gap_seconds", "neighbour_gap", F.coalesce(back, F.lit(False)).alias("reactivated"))


def discovery_gaps(spark: SparkSession, d: str) -> DataFrame:
    """(brand, s, gap_seconds, shrinking): time between successive suppliers' first deliveries of a brand, and whether it is shorter than the time before."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    first = table(spark, d, "lineitem").join(parts, "l_partkey").groupBy("brand", F.col("l_suppkey").alias("s")).agg(F.min("l_shipdate").alias("first"))
    by = Window.partitionBy("brand").orderBy("first", "s")
    gaps = first.withColumn("gap_seconds", F.timestamp_diff("SECOND", F.lag("first").over(by), F.col("first")))
    return gaps.select("brand", "s", "gap_seconds", F.coalesce(F.col("gap_seconds") < F.lag("gap_seconds").over(by), F.lit(False)).alias("shrinking"))


def breakthroughs(spark: SparkSession, d: str) -> DataFrame:
    """(brand, year, score, alert, from_month, to_month): convergence above BREAKTHROUGH, and the months, counted from year 0, in which to expect it."""
    found = temporal.convergence(spark, d).select("brand", "year", "score")
    alert = F.coalesce(F.col("score") >= BREAKTHROUGH, F.lit(False))
    month = lambda m: F.when(alert, F.col("year") * 12 + 11 + m)
    return found.select("brand", "year", "score", alert.alias("alert"), month(AHEAD[0]).alias("from_month"), month(AHEAD[1]).alias("to_month"))


def predictions(readiness: DataFrame) -> DataFrame:
    """(domain, probability, window, prerequisites, conditions) of predicted nodes.

    ``readiness`` has a flag a condition.  Conditions that hold enable, others
    are prerequisites; the probability (0-100) is the share that holds; the
    window in months moves from the late end of EMERGENCE to the early one with it.
    """
    names = [c for c in readiness.columns if c not in ("domain", "ready")]
    held = lambda want: F.array_compact(F.array(*[F.when(F.col(c) == want, F.lit(c)) for c in names]))
    share = F.size("conditions") / F.lit(float(len(names)))
    early, late = EMERGENCE
    opens = (F.lit(late) - share * (late - early)).cast("int")
    listed = readiness.select("domain", held(True).alias("conditions"), held(False).alias("prerequisites"))
    return listed.select("domain", F.round(100 * share, 2).alias("probability"), F.struct(opens.alias("opens"), (opens + early).alias("closes")).alias("window"), "prerequisites", "conditions")


def shown_predictions(readiness: DataFrame) -> DataFrame:
    """``predictions`` flat: lists joined by commas."""
    return predictions(readiness).select(
        "domain", "probability", "window.opens", "window.closes", F.array_join("prerequisites", ", ").alias("prerequisites"), F.array_join("conditions", ", ").alias("conditions")
    )


def resource_readiness(spark: SparkSession, d: str) -> DataFrame:
    """(brand, first_price, last_price, ratio): price for a unit of volume in a brand's last year over its first; below 1 it got cheaper."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    by = table(spark, d, "lineitem").join(parts, "l_partkey").groupBy("brand", F.year("l_shipdate").alias("year")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    ends = by.groupBy("brand").agg(F.min_by("price", "year").alias("f"), F.max_by("price", "year").alias("l"))
    return ends.select("brand", F.round("f", 4).alias("first_price"), F.round("l", 4).alias("last_price"), F.round(F.try_divide("l", "f"), 6).alias("ratio"))


def communities(spark: SparkSession, d: str, least: int = 4, rounds: int = 3, dense: float = 0.25) -> DataFrame:
    """(community, n, n_links, density, emerging): label propagation over suppliers that share ``least`` strong parts or more.

    In every round a supplier takes the label most frequent among its
    neighbours, the least of equally frequent ones; linked pairs inside a
    community over its possible pairs are its density.  Rounds are a fixed number of joins.
    """
    links = materialise(structure.shared_parts(graph.strong(spark, d)).filter((F.col("s") != F.col("t")) & (F.col("common") >= least)).select("s", "t"), "links")
    labels = links.select("s", F.col("s").alias("label")).distinct()
    for _ in range(rounds):
        votes = links.join(labels.select(F.col("s").alias("t"), "label"), "t").groupBy("s", "label").agg(F.count(F.lit(1)).alias("k"))
        labels = materialise(votes.groupBy("s").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("label")), "labels")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ends = links.filter("s < t").join(labels, "s").join(labels.select(F.col("s").alias("t"), F.col("label").alias("other")), "t")
    inside = ends.filter("label = other").groupBy("label").agg(F.count(F.lit(1)).alias("n_links"))
    met = sizes.join(inside, "label", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    density = F.try_divide(2 * F.col("n_links"), F.col("n") * (F.col("n") - 1))
    return met.select(F.col("label").alias("community"), "n", "n_links", F.round(density, 6).alias("density"), F.coalesce(density >= dense, F.lit(False)).alias("emerging"))


def competitors(spark: SparkSession, d: str) -> DataFrame:
    """(brand, n_labs, n_mentions, share_positive): distinct suppliers, deliveries, and the share with a discount above 5%."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return table(spark, d, "lineitem").join(parts, "l_partkey").groupBy("brand").agg(
        F.count_distinct("l_suppkey").alias("n_labs"), F.count(F.lit(1)).alias("n_mentions"), F.round(F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)), 6).alias("share_positive")
    )


def score_bars(best: DataFrame) -> DataFrame:
    """(rank, node_id, share, bar) of ranked scores: each over the largest, and a bar of that length."""
    share = F.col("score") / F.max("score").over(Window.partitionBy())  # top-k rows only
    return best.select("rank", "node_id", F.round(share, 6).alias("share"), scalars.bar(share).alias("bar"))
