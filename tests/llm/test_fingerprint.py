import hashlib

from pyspark.sql import functions as F

from graphloom.llm import fingerprint as fp
from tests.llm.brute import alike, edited_texts, order_min_hash


def test_op2_on_the_small_table(spark, sf_dir):
    out = fp.op2_fingerprints(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    edits = edited_texts(texts.items())
    assert {r.doc_id: r.edited_sha256 for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in edits.items()}
    by_text = {}
    for r in out:
        assert r.n_chars == len(texts[r.doc_id]) and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in out if r.n_chars > 500]
    assert sum(r.near_edited for r in long) / len(long) > 0.1 > 3 * sum(r.near_next for r in long) / len(long)


def test_one_order_change_lowers_likeness_and_occurrences_count(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    rows = [(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(words)), (4, "a b c " * 50), (5, "a b c " * 100), (6, None), (7, ""), (8, "x"), (9, "y" * 300)]
    df = fp.with_fingerprint(spark.createDataFrame(rows, "id long, text string"), F.col("text"), "p")
    p = {r.id: r.p for r in df.collect()}
    same = lambda a, b: sum(x == y for x, y in zip(p[a], p[b], strict=True)) / len(p[a])
    assert same(1, 3) == 1 and same(1, 2) < 0.75 and same(4, 5) < 1
    assert all(p[i] == order_min_hash(t) for i, t in rows)
    assert p[6] == p[7] == [] and len(p[8]) == len(p[9]) == fp.COORDINATES


def test_elements_match_a_plain_version(spark):
    text = "a b c a b c a b d a b c"
    df = spark.createDataFrame([(text,)], "text string")
    h = fp.with_tokens(df, F.col("text"), "w").select(fp.kmers(F.col("w")).alias("p"))
    numbered = h.select(fp._numbered(F.col("p")).alias("s")).first()["s"]
    grams = [tuple(text.split()[i : i + 3]) for i in range(10)]
    assert len(set(x >> fp.AT_BITS for x in numbered)) == len(grams)
    assert sorted(x & (1 << fp.AT_BITS) - 1 for x in numbered) == list(range(10))


def test_single_and_empty_tables(spark, tmp_path):
    for n in (0, 1):
        d = f"{tmp_path}/{n}"
        spark.createDataFrame([(5, "one two three four")][:n], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
        out = fp.op2_fingerprints(spark, d).collect()
        assert len(out) == n and all(r.near_next == 1 for r in out)


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "e f g h"), (None, None), (3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert fp.op2_fingerprints(spark, str(tmp_path)).count() == 5


def test_op2_equals_a_plain_version_on_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    rows = [(1, "a b c d"), (2, None), (3, ""), (4, " \n\t"), (5, long), (6, long + " x"), (7, "z" * 500 + " é ü " + "q" * 25), (8, "one"), (9, "one"), (10, "a b c " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in ("print", "bucket", "copy", "next_text", "_head", "_fp_w", "n_chars")])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(rows)
    edits = edited_texts(rows)
    show = lambda p: "".join(f"{x & 0xFFFFFFFF:08X}" for x in p)
    got = fp.op2_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        own, edited, after = (order_min_hash(t) for t in (texts[r.doc_id], edits[r.doc_id], texts[r.doc_id % len(rows) + 1]))
        assert (r.fingerprint, r.edited_fingerprint) == (show(own), show(edited))
        assert (r.near_edited, r.near_next) == (alike(own, edited), alike(own, after))


def test_words_about_the_cut_length_stay_alike(spark):
    base = [(f"{i:x}" * 8)[:23] for i in range(300)]
    near = [w + "y" * 20 if i in (7, 9) else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(w + "z" for w in base[:40]) + " " + " ".join(base[40:]))]
    p = {r.id: r.p for r in fp.with_fingerprint(spark.createDataFrame(rows, "id long, text string"), F.col("text"), "p").collect()}
    assert alike(p[1], p[2]) > 0.8 and alike(p[1], p[3]) > 0.4


def test_short_texts_have_many_distinct_coordinates(spark):
    rows = [(" ".join(f"w{n}x{i}" for i in range(18)),) for n in range(40)]
    prints = [r.p for r in fp.with_fingerprint(spark.createDataFrame(rows, "text string"), F.col("text"), "p").collect()]
    assert sum(len(set(p)) for p in prints) / len(prints) > 20
