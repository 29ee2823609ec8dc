import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline as cp
from graphloom.llm import packing
from graphloom.llm.common import materialise
from graphloom.llm import mixing
from tests.llm.brute import WORD, components, rule_counts


def test_stages_on_the_small_table(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    names = docs.columns
    at = docs
    for name, stage in cp.STAGES:
        at = materialise(stage(spark, at, sf_dir), "test-stage")
        after = at.collect()
        if name == "quality classifier":
            left = {r.doc_id for r in after}
            assert all(r.doc_id in left for r in before if labels.get(r.doc_id) == 1 and r.n_chars > 500)
        if name == "quality rules":
            left = {r.doc_id for r in after}
            for r in before:
                n, _, _, _, repeated = rule_counts(r.text)
                if n < 50 or 2 * repeated > n:
                    assert r.doc_id not in left
        if name == "near-dedup":
            groups = components([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted({*groups.values()})
        if name == "mixing":
            texts = {r.doc_id: r.text for r in before}
            words = sum(len(WORD.findall(t)) for t in texts.values())
            mixed = sum(len(WORD.findall(r.text)) for r in after)
            assert abs(mixed - 1.5 * words) < 0.01 * words
            for r in after:
                assert texts[r.doc_id].startswith(r.text)
        if name != "packing":
            assert at.columns == names
            before = after
        else:
            assert {r.sequence_id for r in after} == set(range(len(after)))
            assert sum(r.length for r in after if r.start == 0) > 0


def test_nothing_in_nothing_out(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert cp.run(spark, d).count() == 0


def test_packed_sequences_hold_their_tokens(spark):
    docs = spark.createDataFrame([(1, "one two three " * 300), (2, "x <|endoftext|> y"), (2, "x <|endoftext|> y"), (3, None)], "doc_id long, text string")
    rows = cp.pack_sequences(spark, docs, "").collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert [r.length for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted((r.length for r in rows), reverse=True)
    copies = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        copies.setdefault((r.doc_id, r["copy"]), bytearray()).extend(r.ids)
    assert sorted(i for i, _ in copies) == [1, 2, 2, 3]
    for (i, _), ids in copies.items():
        text = {r.doc_id: r.text for r in docs.collect()}[i]
        assert bytes(ids) == packing.encoder(None, added=True).encode([text or ""])[0] + bytes(4)


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like those the stages use."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    same, long = text(80), text(40_000)
    rows = [(1, same, "en", "a", len(same)), (2, same, None, None, None), (2, same, None, None, None), (3, same + " x", "de", "b", 9), (None, text(70), "en", "a", 1)]
    rows += [(None, same, "en", "a", 1), (4, None, "en", "a", 0), (5, "", None, "b", 0), (6, " \n\t ", "en", None, 3), (7, long, "en", "a", len(long))]
    rows += [(10 + i, text(60), "en", "ab"[i % 2], 5) for i in range(12)] + [(8, text(90), "en", "z", 1), (8, text(90), "en", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("kept", "score", "quality", "_content", "_doc", "_own", "k", "host", "rep", "size", "taken", "copy", "ids", "task")])


def test_stages_on_odd_rows(spark, sf_dir):
    docs = odd_documents(spark).cache()
    rows = docs.collect()
    key = lambda r: (r.doc_id, r.text, r.lang, r.source, r.n_chars)
    odd = lambda found: sorted(map(str, map(key, found)))
    judged = cp.quality_classifier(spark, docs, sf_dir)
    assert judged.columns == list(cp.COLUMNS)
    kept = {key(r) for r in judged.collect()}
    assert odd(judged.collect()) == odd(r for r in rows if key(r) in kept)
    ruled = cp.quality_rules(spark, docs, sf_dir).collect()
    assert odd(ruled) == odd(r for r in rows if not ((c := rule_counts(r.text))[0] < 50 or 2 * c[4] > c[0]))
    once = cp.near_dedup(spark, docs, sf_dir).collect()
    known = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    groups = components([(i, t) for i, t in known.items()])
    assert sorted(r.doc_id for r in once if r.doc_id is not None) == sorted({*groups.values()}) and sum(r.doc_id is None for r in once) == 2
    mixed = cp.mix_sources(spark, docs, sf_dir).collect()
    taken = sum(r.taken for r in mixing.mix(mixing.sized(docs), near=mixing.NEAR).collect())
    assert sum(len(WORD.findall(r.text)) for r in mixed) == taken and {r.text for r in mixed} & {long for long in known.values() if long and len(long) > 10**5}
    packed = cp.pack_sequences(spark, docs, sf_dir).collect()
    assert sorted(r.sequence_id for r in packed) == list(range(len(packed))) and sum(r.start == 0 for r in packed) == len(rows)
    none = docs.limit(0)
    assert [stage(spark, none, sf_dir).count() for _, stage in cp.STAGES] == [0] * 5
