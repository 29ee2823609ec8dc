"""All pairs of tokens that stand together: cells of ranges against plain counts."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from graphloom.operators import text, together


@pytest.mark.parametrize("seed", range(60))
def test_cells_count_every_pair_once(seed, monkeypatch):
    r = random.Random(seed)
    least, wide = r.choice([1, 2, 3, 5]), r.choice([3, 20, 300, 90_000])
    sets = [sorted(r.sample(range(wide), min(wide, r.randint(1, 30)))) for _ in range(r.randint(1, 60))]
    # arrays of counts, sorting, both; slices, gathering, both; sets in one piece and one by one
    for name, values in (("SPARSE", [0, 1, 8, 10**9]), ("LONG", [0, 32, 1_000]), ("SORTED", [5, 1 << 18]), ("DEALT", [1, 50, 1 << 20])):
        monkeypatch.setattr(together, name, r.choice(values))
    bounds = [0, r.randint(1, wide - 1), wide]
    halves = [(i, s[q::2]) for i, s in enumerate(sets) for q in (0, 1) if s[q::2]] + [(len(sets), sets[0]), (len(sets), sets[0])]
    rows = pa.RecordBatch.from_arrays([pa.array([i for i, _ in halves]), pa.array([together.pack(np.array(s, "i8")) for _, s in halves], pa.binary())], names=["doc_id", "ids"])
    held = {}
    for batch in together.dealt(bounds)(iter([rows])):
        for cell, _, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            xs, ys = held.setdefault(cell, ([], []))
            xs.append(x)
            ys.extend([y] if y else [])
    got = []
    for cell, (xs, ys) in held.items():
        i, j = together.cells(2)[cell]
        for a, b, n in together.counts(xs, ys, together.width(bounds), least):
            got += [((p + bounds[i], q + bounds[j]), m) for p, q, m in zip(a.tolist(), b.tolist(), n.tolist())]
    seen = Counter(p for s in [*sets, sets[0]] for p in combinations(s, 2))
    assert sorted(got) == sorted((p, n) for p, n in seen.items() if n >= least)


def test_numbers_with_gaps_of_any_size_come_back():
    keys = np.cumsum([0, 1, together.FAR - 1, together.FAR, together.FAR + 1, 5 * together.FAR, 1 << 40])
    assert together.unpack(together.pack(keys[:-1])).tolist() == keys[:-1].tolist()
    assert together.unpack(b"").tolist() == []


def test_pairs_do_not_travel_before_they_are_counted(spark):
    # the documents have 450 million pairs: none may be a row before it is counted
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    has = np.random.default_rng(3).random((100, 6_000)) < 0.5
    has[:, 7] = has[:, 4_001] = has[:, 5_999] = True
    docs = spark.createDataFrame([(i, " ".join(word(j) for j in np.flatnonzero(x))) for i, x in enumerate(has)], "doc_id long, text string")
    found = text.all_cooccurrence(docs, least=70)
    assert "explode(" not in found._jdf.queryExecution().executedPlan().toString()
    n = np.triu(has.T.astype("f4") @ has.astype("f4"), 1).astype(int)
    want = sorted((word(a), word(b), int(n[a, b])) for a, b in np.argwhere(n >= 70))
    assert want and sorted(map(tuple, found.collect())) == want


def test_no_token_often_enough_gives_no_pair(spark):
    docs = spark.createDataFrame([(1, None), (2, "abcd efgh"), (None, "abcd efgh"), (3, "")], "doc_id long, text string")
    found = text.all_cooccurrence(docs, least=2)
    assert found.columns == ["a", "b", "n"] and found.collect() == []
    named = spark.createDataFrame([("x", "abcd efgh"), ("y", "efgh abcd"), ("y", "efgh abcd")], "doc_id string, text string")
    assert list(map(tuple, text.all_cooccurrence(named, least=2).collect())) == [("abcd", "efgh", 2)]
