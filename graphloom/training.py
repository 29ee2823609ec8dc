"""Training over a live graph: build steps, readiness, epochs of distributed gradients, averaging, early stopping, checkpoints, refresh.

The graph lives in time: after step k it holds the deliveries of the first
months of the table, one month a step.  The model is logistic regression on edge
vectors (is a supplier-part edge seen twice or more?).  An epoch is one
aggregate over the training set: a row of sums comes to the driver, whatever the
set's size.  State between epochs is a handful of numbers, saved as Parquet
tables, from which a later run resumes.
"""

from __future__ import annotations

import argparse
import json
import math
import signal
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import graph
from graphloom.config import TrainOptions, add_options, loggers, record, taken
from graphloom.operators.learning import edge_vectors
from graphloom.operators.temporal import month_index
from graphloom.session import session
from graphloom.sources import artifacts
from graphloom.sources.shared import drop_path, materialise, release
from graphloom.sources.tables import table

WIDTH = 3


@dataclass
class State:
    """All that an epoch leaves for the next, patience included."""

    epoch: int = 0
    step: int = 0
    months: int = 0
    weights: list[float] = field(default_factory=lambda: [0.0] * (WIDTH + 1))
    averaged: list[float] = field(default_factory=lambda: [0.0] * (WIDTH + 1))
    best_val_loss: float = math.inf
    bad_epochs: int = 0


class LiveGraph:
    """The graph as of a number of months; ``advance`` lets it grow."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d, self.months = spark, d, 0
        self.first = table(spark, d, "lineitem").agg(F.min(month_index(F.col("l_shipdate")))).first()[0] or 0

    def advance(self, steps: int) -> None:
        self.months += steps

    def supply(self) -> DataFrame:
        lines = table(self.spark, self.d, "lineitem").filter(month_index(F.col("l_shipdate")) < self.first + self.months)
        worth = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return lines.groupBy(graph.named("S", F.col("l_suppkey")).alias("src"), graph.named("P", F.col("l_partkey")).alias("tgt")).agg(
            F.count(F.lit(1)).alias("n_obs"), F.round(F.sum(worth), 4).alias("total_weight")
        )

    def nodes(self) -> DataFrame:
        e = self.supply()
        return e.select(F.col("src").alias("node_id")).unionByName(e.select(F.col("tgt").alias("node_id"))).distinct()

    def ready(self, least: int) -> bool:
        return graph.ready(self.nodes(), least)


def dataset(live: LiveGraph | DataFrame) -> DataFrame:
    """(src, tgt, y, x, part) from a live graph, or from a table of edges where there is none; one edge in five is for validation.

    The label is not among the features: deliveries count as one.
    """
    log = loggers()[1]
    if isinstance(live, LiveGraph):
        known = graph.nodes(live.spark, live.d).select(F.col("node_id").alias("src"), F.col("zone_multiplier").alias("source_zone"))
        edge = live.supply().join(known, "src")
    else:
        log.warning("no live graph: the training set comes from a table")
        edge = live
    plain = edge.select("src", "tgt", F.lit(False).alias("is_containment"), "total_weight", "source_zone", F.lit(1).alias("n_obs"))
    seen = edge.select("src", "tgt", F.when(F.col("n_obs") >= graph.STRONG, 1.0).otherwise(0.0).alias("y"))
    part = F.when(F.pmod(F.xxhash64("src", "tgt"), F.lit(5)) == 0, "validation").otherwise("training")
    return seen.join(edge_vectors(plain, dimension=WIDTH), ["src", "tgt"]).withColumn("part", part)


def losses(data: DataFrame, weights: list[float]) -> dict[str, tuple[int, float, list[float]]]:
    """(rows, mean log loss, mean gradient) of each part, in one aggregate."""
    xs = [F.lit(1.0), *[F.col("x")[i] for i in range(WIDTH)]]
    z = sum((F.lit(w) * x for w, x in zip(weights[1:], xs[1:], strict=True)), F.lit(weights[0]))
    p = 1 / (1 + F.exp(-z))
    inside = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    loss = -(F.col("y") * F.log(inside) + (1 - F.col("y")) * F.log(1 - inside))
    sums = data.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), *[F.avg((p - F.col("y")) * x).alias(f"g{i}") for i, x in enumerate(xs)])
    return {r["part"]: (r["n"], r["loss"], [r[f"g{i}"] for i in range(WIDTH + 1)]) for r in sums.collect()}


def learning_rate(epoch: int, options: TrainOptions, floor: float = 1e-7) -> float:
    """As ``scalars.learning_rate``, for one epoch."""
    w, rest = max(1, options.warmup_epochs), max(1, options.train_epochs - options.warmup_epochs)
    if epoch < options.warmup_epochs:
        return options.lr * (0.001 + 0.999 * epoch / w)
    return floor + (options.lr - floor) * (1 + math.cos(math.pi * (epoch - options.warmup_epochs) / rest)) / 2


def save(spark: SparkSession, state: State, path: str) -> None:
    """The whole state as one row, committed whole or not at all."""
    spark.createDataFrame([asdict(state)], SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


SCHEMA = "epoch int, step long, months int, weights array<double>, averaged array<double>, best_val_loss double, bad_epochs int"


def load(spark: SparkSession, path: str) -> State:
    return State(**spark.read.schema(SCHEMA).parquet(path).first().asDict())


def save_averaged(spark: SparkSession, state: State, path: str) -> None:
    """Only the averaged weights, by name: what inference needs."""
    rows = [(f"w{i}", w, state.epoch, state.best_val_loss) for i, w in enumerate(state.averaged)]
    spark.createDataFrame(rows, "name string, value double, epoch int, val_loss double").coalesce(1).write.mode("overwrite").parquet(path)


@contextmanager
def emergency(save_now: Callable[[], None]) -> Iterator[None]:
    """Save and exit with 0 on an interrupt or a termination signal inside the block; the former handlers come back after it."""
    def stop(number, frame):
        log = loggers()[1]
        log.warning("signal %s: saving an emergency checkpoint", number)
        try:
            save_now()
        finally:
            raise SystemExit(0)

    before = {s: signal.signal(s, stop) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        yield
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def train(spark: SparkSession, d: str, options: TrainOptions, on_epoch: Callable[[State], None] | None = None) -> tuple[State, list[tuple]]:
    """Run or resume; the last state and (epoch, train loss, validation loss, averaged validation loss, learning rate) of each epoch.

    The graph must have ``min_nodes_to_train`` nodes after the build steps.
    Every ``graph_interleave_every`` epochs, but not before the first, it grows
    by ``graph_interleave_steps`` and the training set is rebuilt.
    """
    log = loggers()[1]
    live, where = LiveGraph(spark, d), options.save_dir
    state = load(spark, options.resume) if options.resume else State(months=options.graph_build_steps)
    live.advance(state.months)
    if not live.ready(options.min_nodes_to_train):
        raise RuntimeError(f"the graph has fewer than {options.min_nodes_to_train} nodes after its build steps")
    data, history, periodic = materialise(dataset(live), "training-set"), [], []
    with emergency(lambda: save(spark, state, f"{where}/emergency")):
        while state.epoch < options.train_epochs:
            if options.graph_interleave_every > 0 and state.epoch > 0 and state.epoch % options.graph_interleave_every == 0:
                live.advance(options.graph_interleave_steps)
                state.months = live.months
                grown = materialise(dataset(live), "training-set")
                release(data)
                data = grown
            rate = learning_rate(state.epoch, options)
            both = losses(data, state.weights)
            _, loss, gradient = both["training"]
            norm = math.sqrt(sum(g * g for g in gradient))
            scale = min(1.0, options.grad_clip / (norm + 1e-12)) if options.grad_clip > 0 else 1.0
            state.weights = [w - rate * (scale * g + options.weight_decay * w) for w, g in zip(state.weights, gradient, strict=True)]
            keep = options.ema_decay
            state.averaged = [keep * a + (1 - keep) * w for a, w in zip(state.averaged, state.weights, strict=True)]
            checked = losses(data.filter("part = 'validation'"), state.averaged).get("validation", (0, math.inf, []))[1]
            state.epoch, state.step = state.epoch + 1, state.step + 1
            history.append((state.epoch, loss, both.get("validation", (0, math.inf, []))[1], checked, rate))
            log.info("epoch %d: training %.6f, averaged validation %.6f", state.epoch, loss, checked)
            if checked < state.best_val_loss - options.min_delta:
                state.best_val_loss, state.bad_epochs = checked, 0
                save(spark, state, f"{where}/best")
                save_averaged(spark, state, f"{where}/best_averaged")
            else:
                state.bad_epochs += 1
            if options.save_every > 0 and state.epoch % options.save_every == 0:
                periodic.append(f"{where}/{artifacts.PERIODIC}{state.epoch:04d}")
                save(spark, state, periodic[-1])
                while options.keep_last and len(periodic) > options.keep_last:
                    drop_path(spark, periodic.pop(0))
            if on_epoch:
                on_epoch(state)
            if 0 < options.patience <= state.bad_epochs:
                break
    save(spark, state, f"{where}/final")
    release(data)
    return state, history


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder", help="folder of Parquet tables")
    add_options(parser, TrainOptions)
    args = parser.parse_args(argv)
    options = taken(TrainOptions, args)
    spark = session()
    spark.createDataFrame([(json.dumps(record(options)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{options.save_dir}/run_config")
    train(spark, args.folder, options)


if __name__ == "__main__":
    main()
