import math
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import rules
from tests.llm.brute import rule_counts, rule_cutoffs

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a b"), (6, "a b c a b c"), (7, "x " * 3000), (8, "l1\nl1\n\n\nl1 \nl2"),
    (9, "é|é <b> 50% #1 *"), (10, "a b c\x85d"), (11, "a b c d a b c e a b c\x0bq\x0cq\rq"), (12, "w" * 5000),
]


def test_measures_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-i, t) for i, t in ODD], "doc_id long, text string")
    )
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rules.measure(docs, ["doc_id"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rule_counts(texts[r.doc_id]), r


@pytest.mark.parametrize("n, risk, level", [(0, 0.1, 0.05), (10, 0.1, 0.05), (300, 0.01, 0.01), (1000, 0.02, 1e-4), (5000, 0.05, 1e-3)])
def test_allowed_rejections_is_the_exact_binomial_bound(spark, n, risk, level):
    found = spark.range(1).select(rules.allowed_rejections(F.lit(n).cast("long"), risk, F.lit(level))).first()[0]
    total, k = 0.0, -1
    for i in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk))
        if n == 0 or total > level:
            break
        k = i
    assert found == k


def test_good_texts_are_kept_and_symbol_junk_is_not(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", None, None, 1) for i in range(1500)]
    bad = [(5000 + i, " ".join(f"b{i}x{j}%%%" for j in range(80)), "en", None, None, 0) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, stratum string, rule string, quality int")
    out = rules.judge(docs.drop("quality"), docs.select("doc_id", "quality")).collect()
    assert len(out) == 1600
    assert all(r.kept == (r.doc_id < 5000) for r in out)


def test_empty_table_and_null_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert rules.judge(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [(r.base_failed, r.kept) for r in rules.judge(one, labels).collect()] == [(True, False)]


def test_cutoffs_are_fitted_on_all_labelled_rows(spark):
    measured = spark.range(250_000).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(80).alias("n_words"), F.lit(0).alias("n_repeat_words"),
        F.when(F.col("id") % 5 == 0, 0.5).otherwise(0.0).alias("symbol_share"), *[F.lit(0.0).alias(r) for r in rules.RULES[1:]],
    )
    labels = measured.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("quality"))
    found = rules.fit(measured, labels, "lang").collect()
    assert all(r.proved for r in found) and sorted(r.rule for r in found) == sorted(rules.RULES)
    assert [(r.rule, r.n_good, r.good_rejected, r.bad_rejected) for r in found if r.cutoff] == [("symbol_share", 200_000, 0, 50_000)]


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(2400):
        bad, lang = i % 8 == 0, ("en", "de", "xx", None)[min(3, i % 13 % 5)]
        words = [f"{rng.choice('abc')}{rng.randrange(10**6)}" for _ in range(60)]
        junk = rng.randrange(0, 40) if bad else rng.randrange(0, 3)
        words[:junk] = [w + "%#" for w in words[:junk]]
        if bad and rng.random() < 0.5:
            words = [w.upper() for w in words]
        docs.append((i if i % 97 else None, " ".join(words), lang, 1))
        labels += [(i, int(not bad))] * (2 if i % 50 == 0 else 1)
    docs += [(9000, None, "en", 1), (9001, "", None, 1), (9002, docs[8][1], "yy", 1), (9002, docs[8][1], "yy", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, cutoff int").select("*", *[F.lit("clash").alias(c) for c in ("stratum", "kept", "n_words", "_words", "_c_caps_share", "quality")])
    label_frame = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, quality int")
    got = rules.judge(frame, label_frame).collect()
    shares = [{k: r[k] for k in rules.RULES} for r in got]
    quality = {}
    for i, q in labels:
        quality.setdefault(i, []).append(q)
    labelled = [(r.lang, q, s) for r, s in zip(got, shares) if not r.base_failed for q in quality.get(r.doc_id, [])]
    cutoffs = rule_cutoffs(labelled, rules.RULES)
    assert sum(c is not None for c in cutoffs.values()) > 1
    for r, s in zip(got, shares):
        broken = [k for k in rules.RULES if cutoffs.get((r.lang, k)) is not None and s[k] > cutoffs[r.lang, k]]
        assert r.rejected_by == broken and r.kept == (not r.base_failed and not broken)
        assert r.lang != "yy" or r.unproved == list(rules.RULES)
    assert sum(not r.kept and not r.base_failed for r in got) > 100 and len(got) == len(docs)


def test_rules_reject_beyond_the_base_rule_in_more_than_one_language(spark):
    where = "/root/testdata/sf0.1"
    if not os.path.isdir(where):
        pytest.skip("no table of this size")
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.judge(docs, labels)
    beyond = judged.filter("NOT base_failed AND NOT kept").join(labels, "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good")).collect()
    print(beyond, judged.groupBy("lang", "unproved").count().collect())
    assert sum(r.bad > 0 for r in beyond) > 1 and sum(r.good for r in beyond) < 0.01 * labels.filter("quality = 1").count()
