"""Queries of a run's bookkeeping: sizes, formats, remaining time, composed losses, averaged weights, checkpoints, training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import graph, training
from graphloom.functions import scalars
from graphloom.operators import folds, insight, learning, lookup, ranking, temporal
from graphloom.sources import artifacts
from graphloom.sources.tables import table

TEXTS = [("supplier#000000000", "nation_3"), ("Widget", "zzz"), ("zzz", "qqq"), ("SUPPLIER#000000001", "supplier#000000002"), ("nation_1", "asia")]


def edge_text_match(spark: SparkSession, d: str) -> DataFrame:
    return lookup.matched_edges(graph.nodes(spark, d), graph.edges(spark, d), lookup.literal(spark, TEXTS, "src string, tgt string"))


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(F.col("x")[i], 6).alias(c) for i, c in enumerate("abc")])


def edge_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _flat(learning.edge_vectors(graph.attached(graph.edges(spark, d), graph.nodes(spark, d))), "src", "tgt")


def forecast_scores(spark: SparkSession, d: str) -> DataFrame:
    return learning.predicted(learning.node_vectors(spark, d)).select("node_id", F.round("score", 6).alias("score"))


def training_set(spark: SparkSession, d: str, months: int = 24) -> DataFrame:
    """Edges of the live graph after ``months`` steps with vectors and labels."""
    live = training.LiveGraph(spark, d)
    live.advance(months)
    return _flat(training.dataset(live), "src", "tgt", "y")


def training_losses(spark: SparkSession, d: str) -> DataFrame:
    """(part, n, loss) of the training set of 24 steps under zero weights."""
    live = training.LiveGraph(spark, d)
    live.advance(24)
    found = training.losses(training.dataset(live).withColumn("part", F.lit("all")), [0.0] * (training.WIDTH + 1))
    return spark.createDataFrame([(k, n, round(loss, 6), *[round(g, 6) for g in gradient[:2]]) for k, (n, loss, gradient) in found.items()], "part string, n long, loss double, g0 double, g1 double")


def averaged_weights(spark: SparkSession, d: str) -> DataFrame:
    """(name, value): a supplier's mean discount before 1998, moved by a tenth towards that after; suppliers of one period only drop out."""
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    part = lambda past: table(spark, d, "lineitem").filter((F.col("l_shipdate") < cut) == past).groupBy(graph.named("S", F.col("l_suppkey")).alias("name")).agg(F.avg("l_discount").alias("value"))
    return learning.matched(part(True), part(False), 0.9).select("name", F.round("value", 6).alias("value"))


def trainable_size(spark: SparkSession, d: str) -> DataFrame:
    """(module, n_trainable, n_all): parameters of a module and those of them that train, with parts as parameters of their brand."""
    trains = F.col("p_retailprice") >= 1200
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("module")).agg(F.sum(F.when(trains, F.col("p_size")).otherwise(0)).alias("n_trainable"), F.sum("p_size").alias("n_all"))


def number_formats(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_suppkey") / F.lit(7.0)
    at = F.timestamp_seconds(F.col("s_suppkey") * 86_461 + 1_700_000_000)
    return table(spark, d, "supplier").select(
        "s_suppkey", scalars.percent(x).alias("percent"), scalars.decimals(x, 3).alias("three"), scalars.scientific(x).alias("scientific"), scalars.padded(F.col("s_suppkey"), 4).alias("padded"),
        scalars.thousands(F.col("s_suppkey") * 12_345).alias("thousands"), scalars.joined(F.array(x, x * 2), 2).alias("joined"), F.unix_timestamp(at).alias("epoch_seconds"), scalars.iso(at).alias("iso"),
    )


def time_left(spark: SparkSession, d: str) -> DataFrame:
    """(epoch, i, eta): seconds left of a user's series by what has passed and the share done."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", (F.row_number().over(by) - 1).alias("i"), F.timestamp_diff("SECOND", F.first("ts").over(by), F.col("ts")).alias("elapsed"))
    done = (F.col("i") + 1) / F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return e.select(F.col("user_id").alias("epoch"), "i", F.round(learning.eta(F.col("elapsed"), done), 4).alias("eta"))


def total_loss(spark: SparkSession, d: str) -> DataFrame:
    """(batch, total): weighted sum of four parts of a loss, here means of columns of an order priority's lines; a part without weight counts as it is."""
    parts = {"forecast": F.avg("l_discount"), "exist": F.avg("l_tax"), "comps": F.avg(F.col("l_quantity") / 50.0), "zone": F.avg(F.col("l_linenumber") / 7.0)}
    total = learning.weighted_loss(parts, {"forecast": 1.0, "exist": 0.5, "comps": 0.25})
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("batch")).agg(F.round(total, 6).alias("total"))


def component_zip(spark: SparkSession, d: str) -> DataFrame:
    """(s, name, value): names and values by position, up to the shorter list."""
    values = F.when(F.col("s_suppkey") % 2 == 0, F.array("s_acctbal", F.col("s_nationkey").cast("double"))).otherwise(F.array("s_acctbal"))
    pairs = scalars.zip_shorter(F.array(*[F.lit(c) for c in ("balance", "nation", "unused")]), values)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.inline(pairs))


def readiness_gate(spark: SparkSession, d: str) -> DataFrame:
    node = graph.nodes(spark, d)
    return spark.createDataFrame([(least, graph.ready(node, least)) for least in (20, 100_000_000)], "least long, ready boolean")


def checkpoint_choice(spark: SparkSession, d: str) -> DataFrame:
    """The file to load if orders were checkpoints, with the resume point of each layout's defaults."""
    files = table(spark, d, "orders").select(F.concat(F.lit(artifacts.PERIODIC), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").alias("mtime"), F.col("o_orderkey").alias("global_step"))
    chosen = artifacts.select_checkpoint(files)
    return chosen.select("name").join(artifacts.resume(chosen.select("global_step")).select("epoch", "global_step"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = scalars.l2_normalised(F.transform("embedding", lambda x: x * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(v[0], 5).alias("first"), F.round(scalars.dot(v, v), 5).alias("norm"))


def first_candidates(spark: SparkSession, d: str, k: int = 7) -> DataFrame:
    """The first ``k`` candidates in the provider's order, whatever their scores."""
    return temporal.pre_breakthrough(spark, d).filter("candidate").orderBy("brand", "month").limit(k).select("brand", "month", "acceleration")


def score_bars(spark: SparkSession, d: str) -> DataFrame:
    return insight.score_bars(ranking.top(ranking.percent_scores(graph.weights(spark, d)).withColumn("score", F.col("weight").cast("double")), 10))


def epoch_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return folds.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 42)


QUERIES = {
    f.__name__: f
    for f in (
        edge_text_match, edge_vectors, forecast_scores, training_set, training_losses, averaged_weights, trainable_size, number_formats, time_left, total_loss, component_zip,
        readiness_gate, checkpoint_choice, unit_vectors, first_candidates, score_bars, epoch_shuffle,
    )
}
