"""Literal fixtures: sentinels, ties, gaps, folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import graph
from graphloom.functions import embedding, scalars
from graphloom.operators import folds, lookup, ranking, structure, temporal
from graphloom.sources import artifacts, tables

NODES = "node_id string, seq long, text string, zone_multiplier double"


def test_approximate_years(spark):
    df = spark.createDataFrame([(0.0,), (819_936_000.0,), (-1e11,), (1e11,)], "t double")
    assert [r[0] for r in df.select(scalars.approx_year(F.col("t"))).collect()] == [2000, 1996, 1700, 2100]


def test_edges_keep_only_known_ends(spark):
    node = spark.createDataFrame([("A", 1, "a", 1.5), ("B", 2, "b", 1.0)], NODES)
    edge = spark.createDataFrame([("A", "B", True), ("A", "X", False), ("B", "A", False), ("Y", "Z", False)], "src string, tgt string, is_containment boolean")
    assert sorted((r.src, r.tgt, r.source_zone) for r in graph.attached(edge, node).collect()) == [("A", "B", 1.5), ("B", "A", 1.0)]
    assert sorted((r.src, r.tgt) for r in graph.dangling(edge, node).collect()) == [("A", "X"), ("Y", "Z")]
    assert graph.attached(edge.limit(0), node).count() == 0


def test_lookup_tiers_and_ties(spark):
    node = spark.createDataFrame([("1", 1, "ruby laser", 1.0), ("2", 2, "Laser", 1.0), ("3", 3, "Laser", 1.0)], NODES)
    needles = spark.createDataFrame([("laser",), ("ruby",), ("zzz",), ("",)], "needle string")
    assert {r.needle: r.node_id for r in lookup.resolve(node, needles).collect()} == {"laser": "2", "ruby": "1", "": "1"}


def test_reverse_edges_are_found(spark):
    edge = spark.createDataFrame([("B", "A", 2.0), ("C", "D", 3.0), ("D", "C", 4.0)], "src string, tgt string, total_weight double")
    pairs = spark.createDataFrame([("A", "B"), ("C", "D"), ("A", "D")], "a string, b string")
    found = {(r.a, r.b): (r.direction, r.total_weight) for r in lookup.existing(edge, pairs).collect()}
    assert found == {("A", "B"): ("reverse", 2.0), ("C", "D"): ("forward", 3.0), ("A", "D"): ("none", None)}


def test_top_puts_nan_first_and_rejects_negative_k(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 2.0)], "seq long, score double")
    assert [r.seq for r in ranking.top(df, 2).orderBy("rank").collect()] == [2, 3]
    with pytest.raises(ValueError):
        ranking.top(df, -1)


def test_percent_scores_equal_percent_rank(spark):
    df = spark.createDataFrame([("x", w) for w in (5, 1, 1, 3)] + [("y", 9)], "kind string, weight long")
    got = sorted((r.kind, r.weight, round(r.score, 4)) for r in ranking.percent_scores(df).collect())
    assert got == [("x", 1, 0.0), ("x", 1, 0.0), ("x", 3, 66.6667), ("x", 5, 100.0), ("y", 9, 0.0)]


def series(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "epoch long, i int, loss double")


def test_folds(spark):
    assert folds.rolling(series(spark, range(1, 61))).orderBy(F.desc("i")).first()["mean_loss"] == 35.5
    assert folds.ema(series(spark, [1, 2, 3]), 0.9).first()["ema"] == 1.29
    stop = folds.early_stop(series(spark, [5, 4, 4, 4, 3]), 2, 1e-5).first()
    assert (stop["stopped_at"], stop["best"]) == (3, 4.0)
    assert folds.early_stop(series(spark, [1, 2, 3]), 0, 1e-5).first()["stopped_at"] == -1
    assert [r.improved for r in folds.best_so_far(series(spark, [3, 3, 2])).orderBy("i").collect()] == [True, False, True]
    many = series(spark, range(35))
    assert folds.batches(many, 16, True).count() == 32 and folds.batches(many, 16, False).select("batch").distinct().count() == 3
    assert folds.batch_means(series(spark, [1] * 16 + [3]), 16).first()["mean_of_means"] == 2.0
    assert folds.batch_means(series(spark, range(65)), 16).first()["n_steps"] == 3


def test_shuffle_is_reproducible(spark):
    df = spark.range(50)
    order = lambda d, s: [r.id for r in folds.shuffled(d, "id", s).orderBy("pos").collect()]
    assert order(df, 1) == order(df.repartition(7), 1) != order(df, 2)


def test_retention_and_selection(spark):
    files = spark.createDataFrame([(f"checkpoint_epoch_{i}", "p", i) for i in range(5)], "name string, prefix string, mtime int")
    assert sorted(r.mtime for r in artifacts.expired(files, 3).collect()) == [0, 1]
    assert artifacts.expired(files, 0).count() == 0
    assert artifacts.select_checkpoint(files).first()["mtime"] == 4
    best = files.unionByName(spark.createDataFrame([("best_model.pt", "b", 0), ("other", "o", 99)], "name string, prefix string, mtime int"))
    assert artifacts.select_checkpoint(best).first()["name"] == "best_model.pt"
    assert artifacts.select_checkpoint(files.limit(0)).count() == 0


def test_layouts_resume_and_config(spark, tmp_path):
    df = spark.createDataFrame([(b"w",)], "weights binary")
    assert artifacts.layout(df) == "weights"
    with pytest.raises(ValueError):
        artifacts.layout(spark.range(1))
    assert tuple(artifacts.resume(df).first()) == (0, 0, float("inf"))
    row = artifacts.run_config(spark, {"phantom_max_count": "10", "secret": "x"}).first()
    assert row["config"] == {"phantom_max_count": "10"} and "secret" in row["args"]
    artifacts.write_json(spark.range(9), f"{tmp_path}/out", 3, [F.desc("id")])
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/out").collect()) == [6, 7, 8]


def test_dense_calendar_and_differences(spark):
    counts = spark.createDataFrame([("a", 1954, 1), ("a", 1955, 5), ("a", 1957, 34), ("a", 1958, 89)], "k string, y int, n int")
    assert [r.n for r in temporal.dense(counts, "k", "y", "n").orderBy("y").collect()] == [1, 5, 0, 34, 89]


def test_scalars(spark):
    one = spark.range(1)
    zipped = one.select(scalars.zip_shorter(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(1), F.lit(2))).alias("z")).first()["z"]
    assert [tuple(x) for x in zipped] == [("a", 1), ("b", 2)]
    assert one.select(scalars.bar(F.lit(0.5)), scalars.bar(F.lit(-1.0)), scalars.percent(F.lit(0.125))).first()[:] == ("#" * 10, "", "12.5%")
    norm = one.select(scalars.l2_normalised(F.array(F.lit(3.0), F.lit(4.0)))).first()[0]
    assert norm == pytest.approx([0.6, 0.8])


def test_hash_embedder_equals_numpy(spark):
    df = spark.createDataFrame([("laser",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(embedding.embed(F.col("t"))).collect()]
    assert np.allclose(got[0], embedding.hash_vector("laser"), atol=1e-6) and len(got[1]) == embedding.DIMENSIONS and got[2] is None


def test_roles_and_shares(spark, sf_dir):
    edge = spark.createDataFrame([("A", "B"), ("A", "C"), ("C", "A"), ("C", "B")], "src string, tgt string")
    assert {r.node_id: r.role for r in structure.roles(edge).collect()} == {"A": "source", "B": "sink", "C": "source"}
    by = structure.containment(spark, sf_dir).filter("depth = 1").groupBy(F.substring("path", 1, 3).alias("r")).agg(F.sum("share").alias("s"))
    assert all(abs(r.s - 1) < 1e-6 for r in by.collect())


def test_partitions_do_not_change_results(spark, sf_dir):
    from graphloom.plans.catalogue import QUERIES

    seen = []
    for n in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([sorted(map(str, QUERIES[q](spark, sf_dir).collect())) for q in ("scan_alerts", "phantom_gaps", "ema_series")])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_union_fills_missing_columns(spark):
    both = tables.union_signals([spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2,)], "a int")])
    assert sorted((r.a, r.b) for r in both.collect() if r.b) == [(1, "x")] and both.count() == 2


def test_registered_folds_read_long_series_whole(spark, tmp_path):
    from graphloom.plans.catalogue import QUERIES

    # user 1: 9,000 losses that fall for 6,000 steps and then stay; user 2: rising ever after its first
    value = {1: lambda i: 7000.0 - min(i, 6000) + i % 3 * 1e-7, 2: lambda i: 1.0 + i}
    rows = [(u * 100_000 + i, i, u, value[u](i)) for u, n in ((1, 9000), (2, 30)) for i in range(n)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    smooth = {}
    for u, n in ((1, 9000), (2, 30)):
        s = value[u](0)
        for i in range(1, n):
            s = 0.9 * s + (1 - 0.9) * value[u](i)
        smooth[u] = (n, round(s, 6))
    got = {r.epoch: (r.n, r.ema) for r in QUERIES["ema_series"](spark, str(tmp_path)).collect()}
    assert got == {u: (n, pytest.approx(s, abs=2e-6)) for u, (n, s) in smooth.items()}
    stops = {r.epoch: (r.stopped_at, r.best) for r in QUERIES["early_stopping"](spark, str(tmp_path)).collect()}
    assert stops == {1: (6010, 1000.0), 2: (10, 1.0)}


def test_cooccurrence_counts_frequent_tokens_and_long_documents(spark, tmp_path):
    from collections import Counter
    from itertools import combinations

    from graphloom.operators import text
    from graphloom.plans.catalogue import QUERIES

    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    # 40 documents of up to 150 tokens: frequencies from 1 to 40, more than 100 tokens a document
    docs = [(i, " ".join(word(j) for j in range(150) if j % (i % 5 + 1) == 0 or j % 40 == i)) for i in range(40)]
    seen = Counter(p for _, t in docs for p in combinations(sorted(set(t.split())), 2))
    want = sorted((a, b, n) for (a, b), n in seen.items() if n >= 3)
    frame = spark.createDataFrame([*docs, (41, None), (42, ""), (43, "abc d")], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["cooccurrence_all"](spark, str(tmp_path)).collect())) == want
    assert sorted(map(tuple, text.all_cooccurrence(frame.unionByName(frame), block=7).collect())) == want


def test_search_takes_every_twentieth_vector_as_query(spark, tmp_path):
    from graphloom.operators import vectors
    from graphloom.plans.catalogue import QUERIES

    x = np.random.default_rng(1).normal(size=(2_300, 8)).astype("f4")
    x[100:160] = x[0]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 8)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = np.round(x.astype("f8") @ x.astype("f8").T, 6)
    want = sorted((q, v, r + 1) for q in range(0, 2_300, 20) for r, v in enumerate(sorted((v for v in range(2_300) if v != q), key=lambda v: (-near[q, v], v))[:5]))
    got = QUERIES["vector_search"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got) == want
    assert all(r.similarity == pytest.approx(near[r.query_id, r.vec_id], abs=2e-6) for r in got)
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in vectors.search(spark, str(tmp_path), block=17).collect()) == want
