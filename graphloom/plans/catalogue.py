"""Every query of the engine by name: a function of (spark, data folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import graph
from graphloom.functions import embedding, scalars
from graphloom.operators import folds, insight, learning, lookup, ranking, structure, temporal, text, vectors
from graphloom.operators.ordering import ranked
from graphloom.plans import steps
from graphloom.plans.oracles import ORACLES
from graphloom.sources import artifacts
from graphloom.sources.tables import table, union_signals
from graphloom.streaming import events as streams

THRESHOLD = 72.5
TOP_K = 10
NEEDLES = ("red widget", "RED", "supplier#00000000", "nation_7", "", "zzz")


def _restricted(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without the larger parts, so that some edges dangle."""
    large = table(spark, d, "part").filter("p_size > 25").select(graph.named("P", F.col("p_partkey")).alias("node_id"))
    return graph.nodes(spark, d).join(large, "node_id", "left_anti")


def node_features(spark: SparkSession, d: str) -> DataFrame:
    return ranked(graph.nodes(spark, d), [], ["seq"], "pos").select(
        "node_id", "pos", scalars.approx_year(F.col("ts_sec")).alias("year_approx"), "acceleration_multiplier", "zone_multiplier", scalars.label(F.col("text"), F.col("node_id")).alias("label")
    )


def edge_partition(spark: SparkSession, d: str) -> DataFrame:
    kept = graph.attached(graph.edges(spark, d), _restricted(spark, d))
    part = F.when(F.col("is_containment"), "containment").otherwise("regular")
    return kept.select("src", "tgt", part.alias("part"), F.when(F.col("is_containment"), F.coalesce("source_zone", F.lit(1.0))).alias("multiplier"), "total_weight")


def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(graph.edges(spark, d), _restricted(spark, d)).select("src", "tgt")


def graph_size(spark: SparkSession, d: str) -> DataFrame:
    strong = ~F.col("is_containment") & (F.col("n_obs") >= graph.STRONG)
    flags = {"n_edges": F.lit(True), "n_containment": F.col("is_containment"), "n_strong": strong}
    e = graph.edges(spark, d).select(F.lit(False).alias("n_nodes"), *[c.alias(n) for n, c in flags.items()])
    n = graph.nodes(spark, d).select(F.lit(True).alias("n_nodes"), *[F.lit(False).alias(n) for n in flags])
    return n.unionByName(e).agg(*[F.count_if(c).alias(c) for c in ("n_nodes", *flags)])


def text_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.resolve(graph.nodes(spark, d), lookup.literal(spark, [(n,) for n in NEEDLES], "needle string"))


def edge_between(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookup.literal(spark, [(0, 1), (0, 2), (1, 2), (3, 3), (2, 999_999)], "a long, b long")
    return structure.similarity(graph.strong(spark, d), pairs)


def existing_edge(spark: SparkSession, d: str) -> DataFrame:
    first = graph.supply(spark, d).agg(F.min("suppkey").alias("s"), F.min_by("partkey", F.struct("suppkey", "partkey")).alias("p"))
    ends = first.select(graph.named("S", F.col("s")).alias("s"), graph.named("P", F.col("p")).alias("p"))
    pairs = ends.select(F.explode(F.array(F.struct(F.col("s").alias("a"), F.col("p").alias("b")), F.struct(F.col("p").alias("a"), F.col("s").alias("b")), F.struct(F.col("s").alias("a"), F.lit("nowhere").alias("b")))).alias("x"))
    return lookup.existing(graph.edges(spark, d), pairs.select("x.a", "x.b"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return ranking.percent_scores(graph.weights(spark, d))


def top_nodes(spark: SparkSession, d: str) -> DataFrame:
    best = ranking.top(_scores(spark, d), TOP_K)
    return best.select("rank", "node_id", scalars.label(F.col("text"), F.col("node_id"), 55).alias("label"), F.round("score", 6).alias("score"))


def scan_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: nodes whose score reaches the threshold, best first."""
    found = ranking.top(ranking.alerts(_scores(spark, d), THRESHOLD), TOP_K)
    return found.select("node_id", F.col("text").alias("node_text"), "weight", F.round("score", 6).alias("score"))


def pressure_top5(spark: SparkSession, d: str) -> DataFrame:
    best = ranking.top(structure.pressure(graph.strong(spark, d), graph.nodes(spark, d)), 5, "pressure")
    return best.select("node_id", scalars.label(F.col("text"), F.col("node_id"), 30).alias("label"), "pressure")


def phantom_gaps(spark: SparkSession, d: str) -> DataFrame:
    return structure.phantom_gaps(graph.strong(spark, d)).orderBy(F.desc("gap_score"), "s", "p").limit(100)


def report(spark: SparkSession, d: str) -> DataFrame:
    """Alerts, phantoms and size as one table of (section, rank, item, value)."""
    found = ranking.top(ranking.alerts(_scores(spark, d), THRESHOLD), TOP_K)
    gaps = structure.phantom_gaps(graph.strong(spark, d)).withColumn("seq", F.struct("s", "p"))
    phantoms = ranking.top(gaps, TOP_K, "gap_score")
    item = F.concat(graph.named("S", F.col("s")), F.lit(">"), graph.named("P", F.col("p")))
    size = graph.nodes(spark, d).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return (
        found.select(F.lit("alert").alias("section"), "rank", F.col("node_id").alias("item"), F.round("score", 6).alias("value"))
        .unionByName(phantoms.select(F.lit("phantom").alias("section"), "rank", item.alias("item"), F.col("gap_score").cast("double").alias("value")))
        .unionByName(size.select(F.lit("size").alias("section"), F.lit(1).alias("rank"), F.lit("nodes").alias("item"), "value"))
    )


def zone_events(spark: SparkSession, d: str) -> DataFrame:
    zones = lookup.literal(spark, [(1, "2024-01-03", "2024-01-06", 1.5), (2, "2024-01-15", "2024-01-16", 4.0)], "zone_id int, a string, b string, multiplier double")
    zones = zones.select("zone_id", F.col("a").cast("timestamp_ntz").alias("zone_start"), F.col("b").cast("timestamp_ntz").alias("zone_end"), "multiplier")
    met = temporal.in_zones(table(spark, d, "events"), zones)
    return met.groupBy("zone_id", "multiplier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(100).select(F.col("id").alias("epoch"), F.round(scalars.learning_rate(F.col("id"), 1e-4, 5, 100), 12).alias("lr"))


def checkpoint_retention(spark: SparkSession, d: str) -> DataFrame:
    """Retention over orders as if they were files: prefix = status, newest three kept."""
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("prefix"), F.col("o_orderdate").alias("mtime"))
    return artifacts.expired(files, 3).select(F.col("name").alias("id"), "prefix")


def inhibitory_drag(spark: SparkSession, d: str) -> DataFrame:
    """Returned quantity as a negative weight; feasible if at most half is returned."""
    back = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    by = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"))
    return by.agg(F.round(F.sum(F.col("l_quantity") - 2 * back), 4).alias("drive"), F.round(F.sum(back), 4).alias("drag"), (F.sum(back) <= 0.5 * F.sum("l_quantity")).alias("feasible"))


def signals_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, "events").select(F.lit("event").alias("origin"), F.col("user_id").cast("string").alias("author"), F.col("value").alias("strength")),
        table(spark, d, "documents").select(F.lit("document").alias("origin"), F.col("source").alias("author")),
        table(spark, d, "pages").select(F.lit("page").alias("origin")),
    ]
    return union_signals(parts).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("author").alias("n_authors"), F.count("strength").alias("n_strengths"))


def isomorphism(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of strong parts that occur in two part types (a weak structural likeness)."""
    degree = graph.strong(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("degree"))
    by = degree.join(table(spark, d, "part").select(F.col("p_partkey").alias("p"), F.col("p_type").alias("domain")), "p").groupBy("domain", "degree").agg(F.count(F.lit(1)).alias("n"))
    a, b = (by.select(F.col("domain").alias(f"domain_{x}"), "degree", F.col("n").alias(f"n_{x}")) for x in "ab")
    return a.join(b, "degree").filter("domain_a < domain_b").select("domain_a", "domain_b", "degree", "n_a", "n_b")


def simultaneous_discovery(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    month = temporal.month_index(F.col("l_shipdate"))
    return lines.groupBy("brand").agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count_distinct("l_suppkey").alias("n_people"))


def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Four conditions of a part type, and all of them (thresholds are ours)."""
    e = graph.strong(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("p"), F.col("p_type").alias("domain"), "p_size", "p_retailprice"), "p")
    by = e.groupBy("domain").agg(F.count_distinct("s").alias("suppliers"), F.sum("n_obs").alias("obs"), F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
    flags = by.select(
        "domain", (F.col("suppliers") >= 5).alias("structural"), (F.col("obs") >= 1000).alias("cultural"), (F.col("size") <= 26).alias("resource"), (F.col("price") <= 1500).alias("temporal")
    )
    return flags.withColumn("ready", F.col("structural") & F.col("cultural") & F.col("resource") & F.col("temporal"))


def hash_embedder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", embedding.embed(F.col("text")).alias("vector"))


def symbolic_step(spark: SparkSession, d: str) -> DataFrame:
    """(subsystem, metric, value) of one step: entropy alerts, candidates, missing edges, ruptures."""
    gaps = structure.phantom_gaps(graph.strong(spark, d))
    parts = [
        ("ext", "entropy_alerts", temporal.entropy_alerts(spark, d).filter("alert")),
        ("dyn", "pre_breakthrough_candidates", temporal.pre_breakthrough(spark, d).filter("candidate")),
        ("dyn", "total_virtual_nodes", gaps),
        ("topo", "rupture_count", structure.rupture_nodes(gaps).filter("ruptured")),
    ]
    return union_signals([df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(s).alias("subsystem"), F.lit(m).alias("metric"), "value") for s, m, df in parts])


def _series(run):
    return lambda spark, d: run(folds.losses(spark, d))


QUERIES = {
    "node_features": node_features,
    "edge_partition": edge_partition,
    "dangling_edges": dangling_edges,
    "graph_size": graph_size,
    "text_lookup": text_lookup,
    "edge_between": edge_between,
    "existing_edge": existing_edge,
    "top_nodes": top_nodes,
    "scan_alerts": scan_alerts,
    "pressure_top5": pressure_top5,
    "phantom_gaps": phantom_gaps,
    "rupture_nodes": lambda spark, d: structure.rupture_nodes(structure.phantom_gaps(graph.strong(spark, d))),
    "pre_breakthrough": temporal.pre_breakthrough,
    "convergence_score": temporal.convergence,
    "entropy_alert": temporal.entropy_alerts,
    "containment_tree": structure.containment,
    "recursive_forecast": lambda spark, d: structure.forecast(spark, d, "S0"),
    "forecast_scenario": lambda spark, d: structure.scenario(structure.forecast(spark, d, "S0")),
    "equifinal_paths": lambda spark, d: structure.equifinal(spark, d, 0),
    "source_sink_role": lambda spark, d: structure.roles(graph.edges(spark, d)),
    "cross_domain_bridges": structure.bridges,
    "bottleneck_missing": structure.bottlenecks,
    "bottleneck_rank": lambda spark, d: structure.bottleneck_rank(structure.bottlenecks(spark, d)),
    "cooccurrence": lambda spark, d: text.cooccurrence(table(spark, d, "documents")),
    "cooccurrence_all": lambda spark, d: text.all_cooccurrence(table(spark, d, "documents")),
    "credibility_consolidate": text.consolidate,
    "canonical_ids": text.canonical_ids,
    "orphan_clusters": text.orphan_clusters,
    "iceberg_ratio": text.iceberg,
    "zone_density": temporal.zone_density,
    "zone_events": zone_events,
    "dormant_reactivation": temporal.dormant,
    "velocity_doubling": temporal.velocity_doubling,
    "sync_acceleration": temporal.sync_acceleration,
    "investment_velocity": temporal.investment_velocity,
    "time_warp_split": temporal.time_warp,
    "retrospective_miss": lambda spark, d: temporal.retrospective(temporal.time_warp(spark, d)),
    "what_if": temporal.what_if,
    "vector_search": vectors.search,
    "hash_embedder_seed": lambda spark, d: table(spark, d, "documents").select("doc_id", scalars.md5_seed(F.col("text")).alias("seed")),
    "hash_embedder": hash_embedder,
    "rolling_loss": _series(folds.rolling),
    "best_so_far": _series(folds.best_so_far),
    "ema_series": _series(lambda s: folds.ema(s, 0.9)),
    "early_stopping": _series(lambda s: folds.early_stop(s, 10, 1e-5)),
    "lr_schedule": lr_schedule,
    "batch_means": _series(folds.batch_means),
    "checkpoint_retention": checkpoint_retention,
    "metric_map": lambda spark, d: folds.metric_rows(folds.step_metrics(spark, d)),
    "inhibitory_drag": inhibitory_drag,
    "report": report,
    "stream_daily": streams.daily,
    "stream_sessions": streams.sessions,
    "symbolic_step": symbolic_step,
    "signals_union": signals_union,
    "isomorphism": isomorphism,
    "simultaneous_discovery": simultaneous_discovery,
    "readiness": readiness,
    "node_vectors": lambda spark, d: learning.node_vectors(spark, d).select("node_id", *[F.round(F.col("x")[i], 6).alias(c) for i, c in enumerate("abc")]),
    "message_passing": learning.message_passing,
    "topology_features": learning.topology,
    "epoch_progress": _series(learning.epoch_progress),
    "recombination": structure.recombination,
    "emerging_clusters": structure.emerging,
    "void_pressure": lambda spark, d: structure.void_pressure(structure.phantom_gaps(graph.strong(spark, d))),
}

QUERIES |= steps.QUERIES | {
    "anchored_deliveries": insight.anchored,
    "registered_dimensions": insight.registered,
    "dormant_neighbours": insight.reactivated,
    "discovery_gaps": insight.discovery_gaps,
    "breakthrough_alerts": insight.breakthroughs,
    "predictions": lambda spark, d: insight.shown_predictions(readiness(spark, d)),
    "resource_readiness": insight.resource_readiness,
    "communities": insight.communities,
    "competitors": insight.competitors,
    "stream_sliding": streams.sliding,
    "stream_averages": streams.averages,
}

__all__ = ["ORACLES", "QUERIES"]
