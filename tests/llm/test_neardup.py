import random

import pytest

from graphloom.llm import neardup
from graphloom.llm.components import components
from tests.llm.brute import components as brute_components
from tests.llm.brute import shingles


def family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def check(spark, rows):
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id), r
        assert r.n_shingles == len(shingles(dict(rows)[r.doc_id]))


def test_components_equal_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts = family(1, 60, 120, 12) + family(2, 30, 40, 4) + family(3, 10, 300, 40)
    odd = [None, "", " \n", "a", "A", "a b", "a  b", "A\tB", "a b c d e", "a b c d e f", "a b c d é", "x " * 400, "x " * 500]
    rows += [(1000 + i, t) for i, t in enumerate(texts + odd)]
    check(spark, rows)


def test_chains_reach_the_least_id(spark):
    words = [f"v{i}" for i in range(140)]
    rows = [(100 - k, " ".join(words[3 * k : 3 * k + 60])) for k in range(20)]
    check(spark, rows)


def test_null_and_repeated_ids_and_no_rows(spark):
    schema = "doc_id long, text string, n int, rep string"
    rows = [(None, "a b c d e", 1, "r"), (7, "a b c d e", 1, "r"), (7, "p q r s t", 1, "r"), (9, "p q r s t", 1, "r"), (3, "a b c d e", 1, "r"), (7, "a b c d e", 1, "r")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, True), (3, 3, True), (7, 3, False), (7, 3, False), (7, 3, False), (9, 3, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("share", [4, 256])
def test_components_of_a_path_and_a_star(spark, monkeypatch, share):
    monkeypatch.setattr("graphloom.llm.components.SHARE", share)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_hubs_long_texts_and_clashing_names(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "CHUNK", 4)
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(i, t) for i, t in enumerate(family(7, 50, 90, 6) + [long, long + " x", None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.select("*", *[F.lit("clash").alias(c) for c in ("n", "rep", "h1", "mins", "hashes", "share", "key", "component", "kept")])
    want = brute_components(rows)
    got = neardup.near_duplicates(clash).collect()
    assert {r.doc_id: r.component_id for r in got} == want and list(want.values()).count(0) > 20
