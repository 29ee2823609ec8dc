"""The engine's modes as functions and as a command line: query, forecast, scan, edge, report."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import graph
from graphloom.operators import lookup, ranking, structure
from graphloom.config import ModeOptions, add_options, loggers
from graphloom.session import session


def _seed(spark: SparkSession, d: str, text: str) -> str:
    """Id of the supplier that ``text`` resolves to; an unresolved text is an error."""
    suppliers = graph.nodes(spark, d).filter("kind = 'S'")
    found = lookup.resolve(suppliers, lookup.literal(spark, [(text,)], "needle string")).collect()
    if not found:
        raise LookupError(f"no node for {text!r}")
    return found[0]["node_id"]


def query(spark: SparkSession, d: str, text: str, n_paths: int = 20, top_k: int = 10) -> DataFrame:
    """Most probable parts reached from the resolved supplier over alternative paths."""
    reached = structure.equifinal(spark, d, int(_seed(spark, d, text)[1:]), n_paths)
    return ranking.top(reached.withColumn("seq", F.col("p")), top_k, "probability")


def forecast(spark: SparkSession, d: str, text: str, depth: int = 4) -> DataFrame:
    return structure.forecast(spark, d, _seed(spark, d, text), depth)


def scan(spark: SparkSession, d: str, threshold: float = 72.5, top_k: int = 10) -> DataFrame:
    scored = ranking.percent_scores(graph.weights(spark, d))
    return ranking.top(ranking.alerts(scored, threshold), top_k)


def edge(spark: SparkSession, d: str, src: str, tgt: str) -> DataFrame:
    """Likeness of two resolved suppliers, and the stored edge between them if there is one."""
    a, b = _seed(spark, d, src), _seed(spark, d, tgt)
    likeness = structure.similarity(graph.strong(spark, d), lookup.literal(spark, [(int(a[1:]), int(b[1:]))], "a long, b long"))
    stored = lookup.existing(graph.edges(spark, d), lookup.literal(spark, [(a, b)], "a string, b string"))
    return likeness.drop("a", "b").join(F.broadcast(stored))


def report(spark: SparkSession, d: str, text: str, depth: int = 3, threshold: float = 72.5, n_paths: int = 20, top_k: int = 10) -> DataFrame:
    """Query, scan and forecast as sections of one table (section, rank, item, value)."""
    q = query(spark, d, text, n_paths, top_k).select(F.lit("query").alias("section"), "rank", graph.named("P", F.col("p")).alias("item"), F.col("probability").alias("value"))
    s = scan(spark, d, threshold, top_k).select(F.lit("scan").alias("section"), "rank", F.col("node_id").alias("item"), F.col("score").alias("value"))
    f = forecast(spark, d, text, depth).select(F.lit("forecast").alias("section"), F.col("depth").alias("rank"), F.col("node_id").alias("item"), F.col("confidence").alias("value"))
    return q.unionByName(s).unionByName(f)


def result(spark: SparkSession, d: str, mode: str, best: DataFrame, top_k: int = 10) -> DataFrame:
    """One row (mode, graph, top_nodes): counts of the graph and the ``top_k`` ranked nodes with text and score, as the JSON result names them."""
    node = graph.nodes(spark, d)
    counts = F.struct(F.lit(node.count()).alias("n_nodes"), F.lit(graph.edges(spark, d).count()).alias("n_edges"))
    rows = best.filter(F.col("rank") <= top_k).select(F.struct("rank", "node_id", F.coalesce("text", F.lit("")).alias("text"), F.col("score").alias("forecast_score")).alias("r"))
    return rows.agg(F.array_sort(F.collect_list("r")).alias("top_nodes")).select(F.lit(mode).alias("mode"), counts.alias("graph"), "top_nodes")


MODES: dict[str, Callable[..., DataFrame]] = {"query": query, "forecast": forecast, "scan": scan, "edge": edge, "report": report}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("mode", choices=sorted(MODES))
    parser.add_argument("folder", help="folder of Parquet tables")
    parser.add_argument("texts", nargs="*", help="query text, or two texts of an edge")
    add_options(parser, ModeOptions)
    args = parser.parse_args(argv)
    log, _ = loggers()
    wanted = {"query": ("n_paths", "top_k"), "forecast": ("depth",), "scan": ("threshold", "top_k"), "edge": (), "report": ("depth", "threshold", "n_paths", "top_k")}
    options = {k: getattr(args, k) for k in wanted[args.mode]}
    spark = session()
    rows = MODES[args.mode](spark, args.folder, *args.texts, **options)
    log.info("mode %s over %s", args.mode, args.folder)
    if not args.output_json:
        rows.show(args.top_k, truncate=False)
    elif args.mode == "scan":
        result(spark, args.folder, args.mode, rows, args.top_k).coalesce(1).write.mode("overwrite").json(args.output_json)
    else:
        rows.write.mode("overwrite").json(args.output_json)


if __name__ == "__main__":
    main()
