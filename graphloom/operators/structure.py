"""Structure of the strong supply graph: gaps, tension, pressure, paths, roles, bounded projection.

Formulas are our own definitions (docstrings state them).  Self joins go over
a shared part or supplier, so their size follows degrees squared; counts are
pre-aggregated before they meet anything else.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.graph import named, nodes, strong
from graphloom.sources.shared import materialise, release
from graphloom.sources.tables import table


def shared_parts(e: DataFrame) -> DataFrame:
    """(s, t, common): ordered supplier pairs, themselves included, with their number of common strong parts."""
    a, b = e.select("s", "p"), e.select(F.col("s").alias("t"), "p")
    return a.join(b, "p").groupBy("s", "t").agg(F.count(F.lit(1)).alias("common"))


def phantom_gaps(e: DataFrame) -> DataFrame:
    """(s, p, gap_score) of missing supplier-part edges: the number of supplier-part-supplier-part paths to p."""
    pairs = shared_parts(e).filter("s <> t")
    paths = pairs.join(e.select(F.col("s").alias("t"), "p"), "t").groupBy("s", "p").agg(F.sum("common").alias("gap_score"))
    return paths.join(e.select("s", "p"), ["s", "p"], "left_anti")


def rupture_nodes(gaps: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """(node_id, kind, tension, ruptured): tension = sum of gap scores touching the node; ruptured above mean + ``sigmas`` x population deviation of its kind."""
    by_s = gaps.groupBy(named("S", F.col("s")).alias("node_id")).agg(F.sum("gap_score").alias("tension")).withColumn("kind", F.lit("S"))
    by_p = gaps.groupBy(named("P", F.col("p")).alias("node_id")).agg(F.sum("gap_score").alias("tension")).withColumn("kind", F.lit("P"))
    both = by_s.unionByName(by_p)
    limits = both.groupBy("kind").agg((F.avg("tension") + sigmas * F.stddev_pop("tension")).alias("limit"))
    return both.join(F.broadcast(limits), "kind").select("node_id", "kind", "tension", (F.col("tension") > F.col("limit")).alias("ruptured"))


def pressure(e: DataFrame, node: DataFrame) -> DataFrame:
    """(node_id, seq, text, pressure): sum over strong neighbours of n_obs x the neighbour's acceleration_multiplier."""
    out = e.select(named("S", F.col("s")).alias("a"), named("P", F.col("p")).alias("b"), "n_obs")
    both = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "n_obs"))
    accel = node.select(F.col("node_id").alias("b"), "acceleration_multiplier")
    summed = both.join(accel, "b").groupBy("a").agg(F.round(F.sum(F.col("n_obs") * F.col("acceleration_multiplier")), 4).alias("pressure"))
    return summed.join(node.select("node_id", "seq", "text"), F.col("a") == F.col("node_id")).select("node_id", "seq", "text", "pressure")


def similarity(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common_parts, union_parts, probability): Jaccard of strong part sets; unknown suppliers have the empty set and null."""
    sizes = e.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    left = pairs.join(sizes.select(F.col("s").alias("a"), F.col("n").alias("na")), "a", "left").join(
        sizes.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b", "left"
    )
    met = pairs.join(e.select(F.col("s").alias("a"), "p"), "a").join(e.select(F.col("s").alias("b"), "p"), ["b", "p"])
    common = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    both = left.join(common, ["a", "b"], "left").withColumn("common_parts", F.coalesce("c", F.lit(0)))
    union = F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)) - F.col("common_parts")
    return both.withColumn("union_parts", union).select(
        "a", "b", "common_parts", "union_parts", F.try_divide("common_parts", "union_parts").alias("probability")
    )


def roles(e: DataFrame) -> DataFrame:
    """(node_id, out_degree, in_degree, role) over edges (src, tgt): source, sink or relay by the greater degree."""
    out = e.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("o"))
    into = e.groupBy(F.col("tgt").alias("node_id")).agg(F.count(F.lit(1)).alias("i"))
    both = out.join(into, "node_id", "full").select("node_id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))
    role = F.when(F.col("out_degree") > F.col("in_degree"), "source").when(F.col("out_degree") < F.col("in_degree"), "sink").otherwise("relay")
    return both.withColumn("role", role)


def bridges(spark: SparkSession, d: str) -> DataFrame:
    """(domain_a, domain_b, n_suppliers, n_links): part types that strong suppliers join, a pair of parts each."""
    e = strong(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("p"), F.col("p_type").alias("domain")), "p")
    per = e.groupBy("s", "domain").agg(F.count(F.lit(1)).alias("k"))
    a, b = per.select("s", F.col("domain").alias("domain_a"), F.col("k").alias("ka")), per.select("s", F.col("domain").alias("domain_b"), F.col("k").alias("kb"))
    return a.join(b, "s").filter("domain_a < domain_b").groupBy("domain_a", "domain_b").agg(
        F.count(F.lit(1)).alias("n_suppliers"), F.sum(F.col("ka") * F.col("kb")).alias("n_links")
    )


#: Required kinds, a value each, are compared as one array up to so many.
KINDS = 100_000


def bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    """(s, missing, n_blocked): part kinds (brand and type) a strong supplier lacks, and how many suppliers lack that kind.

    A supplier's kinds are a set no larger than the dimension; what it lacks is
    the difference to the set of all, one array, so no supplier meets a kind it has.
    """
    kind = F.concat_ws(" ", "p_brand", "p_type")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("p"), kind.alias("missing"))
    kinds = parts.select("missing").distinct().limit(KINDS + 1).collect()
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds are required")
    have = strong(spark, d).join(parts, "p").groupBy("s").agg(F.collect_set("missing").alias("have"))
    wanted = F.from_json(F.lit(json.dumps(sorted(r["missing"] for r in kinds))), "array<string>")
    gone = have.select("s", F.explode(F.array_except(wanted, F.col("have"))).alias("missing"))
    blocked = gone.groupBy("missing").agg(F.count(F.lit(1)).alias("n_blocked"))
    return gone.join(blocked, "missing").select("s", "missing", "n_blocked")


def bottleneck_rank(blocked: DataFrame, k: int = 10) -> DataFrame:
    """(rank, missing, n_blocked): the kinds whose supply would unblock most suppliers."""
    kinds = blocked.groupBy("missing").agg(F.count(F.lit(1)).alias("n_blocked"))
    best = kinds.orderBy(F.desc("n_blocked"), "missing").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_blocked"), "missing")))


def containment(spark: SparkSession, d: str) -> DataFrame:
    """(path, node_id, depth, share): region > nation > supplier, each parent's stress 1 shared equally among its children."""
    region = table(spark, d, "region").select(named("R", F.col("r_regionkey")).alias("node_id"), F.col("r_regionkey").alias("rk"), F.lit(0).alias("depth"), F.lit(1.0).alias("share"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("rk"))
    n = n.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("rk")))
    nation = n.select(named("N", F.col("n_nationkey")).alias("node_id"), "n_nationkey", "rk", F.lit(1).alias("depth"), (F.lit(1.0) / F.col("k")).alias("share"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    sizes = s.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("k"))
    supplier = s.join(sizes, "n_nationkey").join((nation.select("n_nationkey", "rk", F.col("share").alias("above"))), "n_nationkey")
    r, nn = F.concat(F.lit("/R"), F.col("rk").cast("string")), F.concat(F.lit("/N"), F.col("n_nationkey").cast("string"))
    return (
        region.select(r.alias("path"), "node_id", "depth", F.round("share", 9).alias("share"))
        .unionByName(nation.select(F.concat(r, nn).alias("path"), "node_id", "depth", F.round("share", 9).alias("share")))
        .unionByName(
            supplier.select(
                F.concat(r, nn, F.lit("/S"), F.col("s_suppkey").cast("string")).alias("path"), named("S", F.col("s_suppkey")).alias("node_id"),
                F.lit(2).alias("depth"), F.round(F.col("above") / F.col("k"), 9).alias("share"),
            )
        )
    )


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Strong edges in both directions: (a, b, b_seq, n_obs, share), share = n_obs over the most of a."""
    node = nodes(spark, d).select("node_id", "seq")
    out = strong(spark, d).select(named("S", F.col("s")).alias("a"), named("P", F.col("p")).alias("b"), "n_obs")
    both = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "n_obs"))
    most = both.groupBy("a").agg(F.max("n_obs").alias("most"))
    return both.join(most, "a").join(node, F.col("b") == F.col("node_id")).select("a", "b", F.col("seq").alias("b_seq"), "n_obs", (F.col("n_obs") / F.col("most")).alias("share"))


def forecast(spark: SparkSession, d: str, seed: str, depth: int = 4, decay: float = 0.8, width: int = 5) -> DataFrame:
    """(depth, node_id, confidence): the ``width`` best new nodes of each depth.

    Confidence of a hop = confidence before x decay x n_obs / most n_obs of the
    expanded node; ties by node order; nodes seen at any earlier depth are not
    new.  Only the front, at most ``width`` nodes a depth, comes to the driver;
    each depth is one top-k job over the links.
    """
    links = materialise(_links(spark, d), "links")
    schema = "node_id string, confidence double, depth int"
    found = links.filter(F.col("a") == seed).select("a").limit(1).collect()
    seen = [(r["a"], 1.0, 0) for r in found]
    front = seen
    for level in range(1, depth + 1):
        if not front:
            break
        last = spark.createDataFrame([(n, c) for n, c, _ in front], "a string, confidence double")
        known = [n for n, _, _ in seen]
        hops = links.join(F.broadcast(last), "a").filter(~F.col("b").isin(known))
        best = hops.groupBy("b", "b_seq").agg(F.max(F.round(F.col("confidence") * decay * F.col("share"), 9)).alias("confidence"))
        front = [(r["b"], r["confidence"], level) for r in best.orderBy(F.desc("confidence"), "b_seq").limit(width).collect()]
        seen = seen + front
    release(links)
    return spark.createDataFrame(seen, schema).filter("depth > 0").select("depth", "node_id", "confidence")


def scenario(steps: DataFrame, shown: int = 5) -> DataFrame:
    """One row: geometric mean of the best confidence per depth, its complement, confidences by depth, first nodes."""
    by = steps.groupBy("depth").agg(F.max("confidence").alias("best"))
    path = by.agg(F.exp(F.avg(F.log("best"))).alias("coherence"), F.transform(F.array_sort(F.collect_list(F.struct("depth", "best"))), lambda x: x["best"]).alias("confidence_at_depth"))
    listed = steps.orderBy(F.desc("confidence"), "node_id").limit(shown)
    first = listed.agg(F.array_sort(F.collect_list("node_id")).alias("shown_nodes"))
    return path.join(F.broadcast(first)).select(
        F.round("coherence", 6).alias("coherence_score"), F.round(1 - F.col("coherence"), 6).alias("collapse_probability"), F.size("confidence_at_depth").alias("depth"), F.size("shown_nodes").alias("n_shown"),
    )


def equifinal(spark: SparkSession, d: str, seed: int, n_paths: int = 20) -> DataFrame:
    """(p, n_paths, probability) of parts reached from supplier ``seed`` by strong paths of 1 or 3 hops.

    A path's chance is the product of n_obs / (1 + n_obs); alternatives combine
    as 1 - prod(1 - chance) over the target's ``n_paths`` best paths.
    """
    e = strong(spark, d).select("s", "p", (F.col("n_obs") / (1 + F.col("n_obs"))).alias("c"))
    one = e.filter(F.col("s") == seed).select("p", F.col("c").alias("chance"), F.lit(-1).cast("long").alias("via_p"), F.lit(-1).cast("long").alias("via_s"))
    first = e.filter(F.col("s") == seed).select(F.col("p").alias("via_p"), F.col("c").alias("c1"))
    second = e.filter(F.col("s") != seed).select(F.col("p").alias("via_p"), F.col("s").alias("via_s"), F.col("c").alias("c2"))
    third = e.select(F.col("s").alias("via_s"), "p", F.col("c").alias("c3"))
    three = first.join(second, "via_p").join(third, "via_s").filter("p <> via_p").select("p", (F.col("c1") * F.col("c2") * F.col("c3")).alias("chance"), "via_p", "via_s")
    best = Window.partitionBy("p").orderBy(F.desc(F.round("chance", 12)), "via_p", "via_s")
    kept = one.unionByName(three).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= n_paths)
    return kept.groupBy("p").agg(F.count(F.lit(1)).alias("n_paths"), F.round(1 - F.exp(F.sum(F.log(1 - F.col("chance")))), 6).alias("probability"))


def recombination(spark: SparkSession, d: str, least: int = 2) -> DataFrame:
    """(s, t, common, kept, dropped): supplier pairs that share ``least`` part types or more; types both have, and one has."""
    e = strong(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("p"), F.col("p_type").alias("kind")), "p")
    kinds = e.groupBy("s").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    pairs = shared_parts(strong(spark, d)).filter("s < t")
    both = pairs.join(kinds.select("s", F.col("kinds").alias("ks")), "s").join(kinds.select(F.col("s").alias("t"), F.col("kinds").alias("kt")), "t")
    kept, gone = F.array_intersect("ks", "kt"), F.array_except(F.array_union("ks", "kt"), F.array_intersect("ks", "kt"))
    return both.filter(F.size(kept) >= least).select("s", "t", "common", F.size(kept).alias("kept"), F.size(gone).alias("dropped"))


def emerging(spark: SparkSession, d: str, share: float = 0.25) -> DataFrame:
    """(nation, n_suppliers, n_links, density, emerging): linked supplier pairs of a nation over its possible pairs."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("nation"))
    sizes = s.groupBy("nation").agg(F.count(F.lit(1)).alias("n_suppliers"))
    linked = shared_parts(strong(spark, d)).filter("s < t")
    inside = linked.join(s, "s").join(s.select(F.col("s").alias("t"), F.col("nation").alias("other")), "t").filter("nation = other")
    links = inside.groupBy("nation").agg(F.count(F.lit(1)).alias("n_links"))
    full = sizes.join(links, "nation", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    density = F.try_divide(2 * F.col("n_links"), F.col("n_suppliers") * (F.col("n_suppliers") - 1))
    return full.withColumn("density", F.round(density, 6)).withColumn("emerging", F.coalesce(F.col("density") >= share, F.lit(False)))


def void_pressure(gaps: DataFrame) -> DataFrame:
    """(s, n_gaps, pressure): 1 - exp(-gap score / 10) summed over a supplier's gaps."""
    return gaps.groupBy("s").agg(F.count(F.lit(1)).alias("n_gaps"), F.round(F.sum(1 - F.exp(-F.col("gap_score") / 10.0)), 6).alias("pressure"))
