"""The knowledge graph over the star tables: nodes, edges and the strong supply subgraph.

All definitions here are our own reading of the tables: regions, nations,
suppliers and parts are nodes; a supplier's deliveries of a part are one edge;
regions contain nations, nations contain suppliers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import epoch_seconds
from graphloom.sources.tables import table

#: ``seq`` = kind's rank x STEP + key carries the order of insertion.
STEP = 1_000_000_000
STRONG = 2


def _nodes(df: DataFrame, kind: str, rank: int, key: str, text: str, domain: Column, ts: Column, accel: Column) -> DataFrame:
    k = F.col(key).cast("long")
    return df.select(
        F.concat(F.lit(kind), k.cast("string")).alias("node_id"),
        (k + rank * STEP).alias("seq"),
        F.lit(kind).alias("kind"),
        F.col(text).alias("text"),
        domain.alias("domain"),
        ts.alias("ts_sec"),
        accel.alias("acceleration_multiplier"),
        (1 + F.pmod(k, F.lit(5)) * F.lit(0.25)).alias("zone_multiplier"),
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row a region, nation, supplier and part; ts_sec 0 means unknown."""
    lines = table(spark, d, "lineitem")
    first = lambda key: lines.groupBy(F.col(key).alias("k")).agg(F.min("l_shipdate").alias("first"))
    ts = F.coalesce(epoch_seconds(F.col("first")), F.lit(0.0))
    none, one = F.lit(0.0), F.lit(1.0)
    suppliers = table(spark, d, "supplier").join(first("l_suppkey"), F.col("s_suppkey") == F.col("k"), "left")
    parts = table(spark, d, "part").join(first("l_partkey"), F.col("p_partkey") == F.col("k"), "left")
    return (
        _nodes(table(spark, d, "region"), "R", 0, "r_regionkey", "r_name", F.lit("R"), none, one)
        .unionByName(_nodes(table(spark, d, "nation"), "N", 1, "n_nationkey", "n_name", F.lit("N"), none, one))
        .unionByName(_nodes(suppliers, "S", 2, "s_suppkey", "s_name", F.lit("S"), ts, one))
        .unionByName(_nodes(parts, "P", 3, "p_partkey", "p_name", F.col("p_type"), ts, 1 + F.col("p_size") / F.lit(50.0)))
    )


def supply(spark: SparkSession, d: str) -> DataFrame:
    """(suppkey, partkey, n_obs, total_weight): deliveries grouped to one edge a pair."""
    worth = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey")).agg(
        F.count(F.lit(1)).alias("n_obs"), F.round(F.sum(worth), 4).alias("total_weight")
    )


def strong(spark: SparkSession, d: str) -> DataFrame:
    """Supply edges seen STRONG times or more, as (s, p, n_obs) keys."""
    return supply(spark, d).filter(F.col("n_obs") >= STRONG).select(F.col("suppkey").alias("s"), F.col("partkey").alias("p"), "n_obs")


def named(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind), key.cast("string"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, tgt, is_containment, total_weight, n_obs); at most one edge an ordered pair."""
    one = [F.lit(True).alias("is_containment"), F.lit(1.0).alias("total_weight"), F.lit(1).cast("long").alias("n_obs")]
    supplied = supply(spark, d).select(
        named("S", F.col("suppkey")).alias("src"), named("P", F.col("partkey")).alias("tgt"), F.lit(False).alias("is_containment"), "total_weight", "n_obs"
    )
    nations = table(spark, d, "nation").select(named("R", F.col("n_regionkey")).alias("src"), named("N", F.col("n_nationkey")).alias("tgt"), *one)
    suppliers = table(spark, d, "supplier").select(named("N", F.col("s_nationkey")).alias("src"), named("S", F.col("s_suppkey")).alias("tgt"), *one)
    return supplied.unionByName(nations).unionByName(suppliers)


def attached(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes, with the source's zone_multiplier; dangling edges drop out."""
    source = node.select(F.col("node_id").alias("src"), F.col("zone_multiplier").alias("source_zone"))
    target = node.select(F.col("node_id").alias("tgt"))
    return edge.join(source, "src").join(target, "tgt", "left_semi")


def dangling(edge: DataFrame, node: DataFrame) -> DataFrame:
    ids = node.select("node_id")
    lost = edge.join(ids, edge["src"] == ids["node_id"], "left_anti")
    kept = edge.join(ids, edge["src"] == ids["node_id"], "left_semi")
    return lost.unionByName(kept.join(ids, kept["tgt"] == ids["node_id"], "left_anti"))


def weights(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, seq, kind, text, acceleration_multiplier, weight): integer sum of n_obs over a node's supply edges."""
    e = supply(spark, d)
    sums = e.groupBy(named("S", F.col("suppkey")).alias("node_id")).agg(F.sum("n_obs").alias("weight")).unionByName(
        e.groupBy(named("P", F.col("partkey")).alias("node_id")).agg(F.sum("n_obs").alias("weight"))
    )
    return nodes(spark, d).join(sums, "node_id").select("node_id", "seq", "kind", "text", "acceleration_multiplier", "weight")


def ready(node: DataFrame, least: int) -> bool:
    """Whether the graph has ``least`` nodes or more; reads no more than that many."""
    return node.limit(least).count() >= least
