"""Training over the live graph, configuration, signals, resumable streams."""

import logging
import os
import signal
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import config, graph, modes, training
from graphloom.functions import embedding
from graphloom.operators import learning, lookup
from graphloom.sources.shared import materialise, release, scratch, sweep
from graphloom.streaming import events


def options(where, **changes):
    usual = dict(save_dir=f"file://{where}", graph_build_steps=24, train_epochs=6, lr=0.02, warmup_epochs=1, ema_decay=0.5, save_every=1, keep_last=2)
    return config.TrainOptions(**(usual | changes))


def test_training_learns_refreshes_and_resumes(spark, sf_dir, tmp_path):
    grown = []
    whole, history = training.train(spark, sf_dir, options(tmp_path / "a", graph_interleave_every=2, graph_interleave_steps=3), lambda s: grown.append(s.months))
    assert grown == [24, 24, 27, 27, 30, 30] and whole.epoch == 6 and history[-1][1] < history[0][1]
    assert sorted(p.name for p in (tmp_path / "a").iterdir() if p.name.startswith("checkpoint")) == ["checkpoint_epoch_0005", "checkpoint_epoch_0006"]
    averaged = {r.name: r.value for r in spark.read.parquet(f"file://{tmp_path}/a/best_averaged").collect()}
    assert len(averaged) == training.WIDTH + 1
    stopped = options(tmp_path / "b", graph_interleave_every=2, graph_interleave_steps=3)

    class Stop(Exception):
        pass

    def stop(s):
        if s.epoch == 4:
            raise Stop

    with pytest.raises(Stop):
        training.train(spark, sf_dir, stopped, stop)
    resumed = options(tmp_path / "b", graph_interleave_every=2, graph_interleave_steps=3, resume=f"file://{tmp_path}/b/checkpoint_epoch_0004")
    again, rest = training.train(spark, sf_dir, resumed)
    assert [h[0] for h in rest] == [5, 6] and again.weights == pytest.approx(whole.weights) and again.best_val_loss == pytest.approx(whole.best_val_loss)


def test_gradients_equal_numpy_and_the_gate_holds(spark, sf_dir, tmp_path):
    live = training.LiveGraph(spark, sf_dir)
    live.advance(24)
    data = training.dataset(live)
    w = [0.1, -0.2, 0.05, 0.3]
    found = training.losses(data, w)
    for part in ("training", "validation"):
        rows = data.filter(F.col("part") == part).collect()
        x = np.array([[1.0, *r.x] for r in rows])
        y = np.array([r.y for r in rows])
        p = 1 / (1 + np.exp(-x @ np.array(w)))
        n, loss, gradient = found[part]
        assert n == len(rows) and loss == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) and gradient == pytest.approx(((p - y)[:, None] * x).mean(0))
    with pytest.raises(RuntimeError):
        training.train(spark, sf_dir, options(tmp_path, min_nodes_to_train=10**9))


def test_patience_stops(spark, sf_dir, tmp_path):
    state, history = training.train(spark, sf_dir, options(tmp_path, train_epochs=50, lr=0.0, patience=2))
    assert len(history) == 3 and state.bad_epochs == 2


def test_a_signal_saves_and_exits(tmp_path):
    saved = []
    before = signal.getsignal(signal.SIGTERM)
    with pytest.raises(SystemExit) as e, training.emergency(lambda: saved.append(1)):
        os.kill(os.getpid(), signal.SIGTERM)
    assert saved == [1] and e.value.code == 0 and signal.getsignal(signal.SIGTERM) is before


def test_configuration_records_the_listed_keys_only():
    got = config.record(config.ModeOptions(top_k=3), {"model_latent_dim": 8, "secret": 1})
    assert got["oracle_config"] == {"model_latent_dim": 8} and got["cli_args"]["top_k"] == 3 and len(config.RECORDED) == 14
    assert len(config.record(config.TrainOptions())["oracle_config"]) == 14
    assert [x.name for x in config.loggers()] == ["graphloom", "graphloom.training"] and logging.getLogger().handlers


def test_command_lines(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "session", lambda: spark)
    monkeypatch.setattr(modes, "session", lambda: spark)
    training.main([sf_dir, "--train_epochs", "1", "--save_dir", f"file://{tmp_path}/t"])
    assert "oracle_config" in spark.read.text(f"file://{tmp_path}/t/run_config").first()[0]
    modes.main(["scan", sf_dir, "--top_k", "3", "--output_json", f"file://{tmp_path}/out"])
    row = spark.read.json(f"file://{tmp_path}/out").first()
    assert row.mode == "scan" and row.graph.n_nodes > 100 and [r["rank"] for r in row.top_nodes] == [1, 2, 3]
    modes.main(["forecast", sf_dir, "supplier#000000000", "--depth", "2", "--output_json", f"file://{tmp_path}/all"])
    assert spark.read.json(f"file://{tmp_path}/all").count() == 10


def test_builders_and_tables_can_stand_in(spark, sf_dir):
    edge = spark.createDataFrame([("A", "B", False, 2.0, 3, 1.5), ("A", "C", False, -1.0, 1, 1.0), ("R", "A", True, 1.0, 1, 1.0)], "src string, tgt string, is_containment boolean, total_weight double, n_obs int, source_zone double")
    usual = {r.tgt: r.x for r in learning.edge_vectors(edge).collect()}
    assert usual["C"] == [0.0, 0.0, 0.0] and usual["B"] == pytest.approx([0.3, np.log(3), 1.5]) and len(usual) == 2
    own = learning.edge_vectors(edge, lambda e: F.when(e["tgt"] == "B", F.array(F.lit(9.0))), 1)
    assert {r.tgt: r.x for r in own.collect()} == {"B": [9.0], "C": [0.0]}
    assert learning.edge_vectors(edge.limit(0)).count() == 0
    assert {r.tgt: r.y for r in training.dataset(edge.filter("NOT is_containment")).collect()} == {"B": 1.0, "C": 0.0}
    assert not graph.ready(edge.limit(0), 1) and graph.ready(edge, 3)


def test_edges_by_text_take_the_first_two_nodes(spark):
    node = spark.createDataFrame([("A", 3, "Ruby laser"), ("B", 1, "maser"), ("C", 2, "LASER"), ("D", 4, "none")], "node_id string, seq long, text string")
    edge = spark.createDataFrame([("C", "B", 5.0)], "src string, tgt string, total_weight double")
    texts = spark.createDataFrame([("laser", "maser"), ("ruby", "none"), ("ruby", "zzz"), ("zzz", "qqq")], "src string, tgt string")
    got = {(r.src, r.tgt): (r.a, r.b, r.direction, r.total_weight) for r in lookup.matched_edges(node, edge, texts).collect()}
    assert got == {("laser", "maser"): ("B", "C", "reverse", 5.0), ("ruby", "none"): ("A", "D", "none", None)}


def test_hash_vectors_come_from_the_stated_generator():
    import hashlib

    for text in ("laser", "", "ß"):
        v = np.random.default_rng(int(hashlib.md5(text.encode()).hexdigest(), 16) % 2**32).standard_normal(384).astype(np.float32)
        assert np.array_equal(embedding.hash_vector(text), v / (np.linalg.norm(v) + 1e-8))


def test_a_missing_encoder_falls_back(monkeypatch):
    assert embedding.encoder("no_such_package_at_all") is embedding.hash_vector
    class Stub:
        @staticmethod
        def SentenceTransformer(model):
            return type("M", (), {"encode": staticmethod(lambda t: [1.0])})
    monkeypatch.setitem(sys.modules, "stub_encoder", Stub)
    assert embedding.encoder("stub_encoder")("x") == [1.0]


def test_streams_resume_after_what_they_have_read(spark, tmp_path):
    folder = f"{tmp_path}/in/events.parquet"
    def add(first, n):
        rows = spark.range(first, first + n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))
        rows.coalesce(1).write.mode("append").parquet(folder)
    out = f"file://{tmp_path}/out"
    add(0, 30)
    first = {r.epoch: (r.n, r.ema) for r in events.averages(spark, f"{tmp_path}/in", out=out).collect()}
    add(30, 31)
    second = {r.epoch: (r.n, r.ema) for r in events.averages(spark, f"{tmp_path}/in", out=out).collect()}
    for n, got in ((30, first), (61, second)):
        for u in range(3):
            values, s = [float(i) for i in range(n) if i % 3 == u], None
            for x in values:
                s = x if s is None else 0.9 * s + (1 - 0.9) * x
            assert got[u] == (len(values), pytest.approx(s, abs=1e-6))


def test_scratch_keeps_only_what_is_kept(spark):
    with scratch(spark) as held:
        gone, kept = materialise(spark.range(3), "gone"), held.keep(materialise(spark.range(4), "kept"))
    assert kept.count() == 4
    with pytest.raises(Exception):
        gone.count()
    release(kept)
    other = materialise(spark.range(2), "other")
    sweep(spark)
    with pytest.raises(Exception):
        other.count()
