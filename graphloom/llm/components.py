"""Connected components of an edge table by alternating star contraction, entirely in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, release, scratch, small

#: Edges of a node are dealt over joins of about so many.
SHARE = 256
#: Nodes of more than SHARE edges, at most 2 / SHARE of all edges, are broadcast up to so many (16 bytes each).
HUBS = 1_000_000


def _beside_least(both: DataFrame, least: DataFrame) -> DataFrame:
    """``both`` (a, b) with m of their a; the edges of a node with many (k) are dealt to copies of its row of ``least``."""
    hubs = small(least.filter(F.col("k") > SHARE).select("a", F.ceil(F.col("k") / SHARE).alias("shares")), HUBS)
    dealt = both.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1).cast("long"))).alias("share"))
    copies = least.select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("k") / SHARE) - 1)).alias("share"))
    return dealt.join(copies, ["a", "share"]).drop("share")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or smaller) neighbours on its least neighbour.

    The least neighbour is a grouped minimum, written once, that comes back by a
    join; a hub of any degree is pre-aggregated and its edges are dealt over
    tasks, never gathered.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k"))
    least = materialise(counted.select("a", F.least("a", "m").alias("m"), "k"), "least")
    near = _beside_least(both, least)
    if large:
        moved = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.filter("b < a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.filter("m < a").select("a", F.col("m").alias("b"))
        )
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root: none has two parents, or a parent and a child."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    by = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return not by.filter("up > 1 OR (up > 0 AND down > 0)").limit(1).count()


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: bigint): the least node reachable.

    Each round is written to the shared folder, which cuts the lineage; rounds
    grow with the logarithm of the longest chain.  No edges: no rows.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        with scratch(edges.sparkSession) as held:
            half = materialise(_star(now, True), "edges")
            after = held.keep(materialise(_star(half, False).distinct(), "edges"))
        release(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
