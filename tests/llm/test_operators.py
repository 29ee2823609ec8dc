"""Edge cases of toxicity, language, quality, mixing, packing and sharding."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import boosting, language, mixing, packing, quality, sharding, toxicity
from graphloom.llm.common import ranked
from tests.llm.brute import WORD, held_out, rendezvous, site_bayes

LONG = "lorem ipsum dolor " * 4000
#: Nulls in any column, empty and blank texts, a very long one, repeated rows, columns whose names operators use inside.
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", None), (4, "12 34 !!", "de", "b"), (5, LONG, "en", "a"),
    (5, LONG, "en", "a"), (None, "some words here", "en", "a"), (7, "some words here", None, "b"), (8, "x", "en", "ü"),
]
CLASHING = [
    "score", "size", "_rank", "kept", "rule", "host", "path", "p_doc", "y", "count", "shard", "slot", "part", "fold", "x", "copy", "task", "nth", "taken",
    "_text", "_task", "_at", "_n", "_first", "_shift", "_copies", "_row", "_cut", "_key", "_taken", "_size", "_full", "_rest", "_part", "_doc", "_own", "length",
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxic_corpus(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, 60))
        bad = i % 6 == 0
        for _ in range(3 * bad):
            text[rng.integers(60)] = rng.choice(["vileone", "viletwo", "grim", "foul"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad), 1 - int(i % 7 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_separates_held_out_texts(spark):
    docs, labels = toxic_corpus(spark)
    found = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i in found if held_out(i)]
    assert sum((found[i] >= 0.5) == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in found.values())


def test_toxicity_equals_a_plain_walk(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    trees, (at, chance) = model.trees.trees, model.trees.knots
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, model).filter("doc_id % 10 = 0").collect():
        x = model.lexicon.features(texts[r.doc_id])
        raw = trees.start
        for feature, split, leaf in zip(trees.features, trees.splits, trees.leaves, strict=True):
            node = 0
            while node < len(feature):
                cell = sum(cut < x[feature[node]] for cut in trees.cuts[feature[node]])
                node = 2 * node + 1 + int(cell > split[node])
            raw += leaf[node - len(feature)]
        assert r.score == pytest.approx(0.999 * np.interp(raw, at, chance) + 0.001 / (1 + np.exp(-raw)))


def test_lexicons_leave_their_fold_out(spark):
    rows = [(i, 1, i % boosting.FOLDS, f"a{i} vile{'one' if i % boosting.FOLDS else 'two'} b") for i in range(80)] + [(100 + i, 0, i % 4, f"c{i} fine d") for i in range(80)]
    found = toxicity.learn_lexicons(spark.createDataFrame(rows, "doc_id long, y int, fold int, text string"), 100)
    assert ["viletwo" in x.words for x in found] == [False, True, True, True, True]
    assert all("vileone" in x.words and "fine" not in x.words for x in found)


def test_toxicity_odd_rows_and_no_labels(spark, odd):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.score(odd.limit(0), model).count() == 0
    blank = toxicity.train(docs.limit(0), labels.limit(0))
    assert {r.score for r in toxicity.score(odd, blank).collect()} == {0.5}


def test_disguised_words_are_seen():
    lex = toxicity.Lexicon({"idiot": 3.0}, {})
    plain, leet, spelled, clean = (dict(zip(toxicity.FEATURES, lex.features(t), strict=True)) for t in ("you idiot", "such 1d an id10t now", "an i d i o t now", "fine"))
    assert plain["near_you"] == 1 and leet["disguised_hits"] == 1 and spelled["disguised_hits"] == 1 and not clean["word_hits"]


def test_isotonic_is_monotone_and_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = boosting.Calibrated(x, y)
    assert ((model.probability(x) >= 0.5) == (y > 0)).mean() > 0.9
    order = np.argsort(model.raw(x))
    assert (np.diff(model.probability(x)[order]) >= -1e-12).all()


def test_language_on_held_out_documents(spark, tables):
    docs, _ = tables
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, language.train(docs), ["doc_id"]).collect()}
    held = [r for r in docs.collect() if held_out(r.doc_id)]
    assert sum(found[r.doc_id] == r.lang for r in held) / len(held) > 0.9


def test_every_language_is_learned(spark):
    words = lambda lang: " ".join(f"{chr(97 + lang % 26)}{chr(97 + lang // 26)}{chr(97 + j % 26)}{chr(97 + j % 7)}" for j in range(60))
    # 70 languages, the last of which has fewest rows
    rows = [(i, words(i % 70 if i < 700 else i % 69), f"l{i % 70 if i < 700 else i % 69:02d}") for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = language.train(docs)
    assert list(dictionaries) == [f"l{i:02d}" for i in range(70)]
    assert sum(map(len, dictionaries.values())) <= language.LANGUAGES * language.DICTIONARY_BYTES
    last = docs.filter("lang = 'l69'")
    assert {r.lang_pred for r in language.identify(last, dictionaries, ["doc_id"]).collect()} == {"l69"}
    # one doc_id of least hash repeated beyond every bound leaves room for the others
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    least = spark.range(5_000, 9_000).filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).orderBy(place).first()["id"]
    hot = spark.range(40_000).select(F.lit(least).alias("doc_id"), F.lit("hot words of one document").alias("text"), F.lit("hot").alias("lang"))
    two = language.train(hot.unionByName(docs.filter("lang = 'l01'")))
    assert list(two) == ["hot", "l01"] and two["hot"] == b"hot words of one document"


def test_language_equals_a_plain_loop(spark, tables):
    import zstandard as zs

    docs, _ = tables
    dictionaries = language.train(docs)
    plain = {k: zs.ZstdCompressor(level=language.LEVEL, dict_data=zs.ZstdCompressionDict(v, dict_type=zs.DICT_TYPE_RAWCONTENT), write_content_size=False) for k, v in dictionaries.items()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    agree = 0
    got = language.identify(docs, dictionaries, ["doc_id"]).collect()
    for r in got:
        data = language.normalised(texts[r.doc_id]).encode()
        sizes = {k: len(c.compress(data)) for k, c in plain.items()}
        agree += (r.lang_pred if data else "und") == (min(sizes, key=sizes.get) if data else "und")
    # a compressor that prepared its dictionary may choose other matches by a byte or two
    assert agree / len(got) > 0.99


def test_dictionaries_hold_parts_from_everywhere_in_whole_texts(spark):
    text = " ".join(f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd" for d in "efghijklmn")
    learnable = next(i for i in range(100) if not held_out(i))
    got = language.train(spark.createDataFrame([(learnable, text, "en"), (learnable, text, "en")], "doc_id long, text string, lang string"))["en"].decode()
    assert sorted(got.split())[0][:1] == "a" and "jtd" in got and len(got) > 0.98 * len(text)


def test_language_odd_rows(spark, tables, odd):
    docs, _ = tables
    dictionaries = language.train(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd, dictionaries, ["doc_id"]).collect()]
    assert len(got) == len(ODD) and all(p == "und" and s == 0 for i, p, s in got if i in (1, 2, 3, 4))
    assert all(p in dictionaries and 0 <= s <= 1 for i, p, s in got if i not in (1, 2, 3, 4))
    assert language.identify(odd.limit(0), {}, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.train(docs.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_quality_shrinks_sparse_sites(spark):
    rows = [("big", "big/x", 0.95)] * 300 + [("bad", "bad/x", 0.05)] * 300 + [("new", "new/x", 0.5), (None, None, 0.5)]
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, p_doc double")
    every = quality.combine(scored, quality.site_posteriors(scored)).collect()
    want = site_bayes(rows)
    assert all((r.p_host, r.p_path) == pytest.approx(want[r.doc_id]) for r in every)
    got = {r.host: r for r in every}
    assert got["big"].p_path > 0.8 > 0.6 > got["new"].p_path > 0.4 > 0.2 > got["bad"].p_path
    assert got["new"].p_path == pytest.approx(got[None].p_path) and len(got) == 4


def test_quality_weight_and_scores_equal_a_plain_version(spark, tables):
    docs, labels = tables
    got = quality.judge(docs, labels, ["doc_id"]).collect()
    model, learned = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = site_bayes([(r.host, r.path, r.p_doc) for r in got])
    odds = lambda p: np.log(np.clip(p, 0.01, 0.99) / (1 - np.clip(p, 0.01, 0.99)))
    rate = np.mean([r.p_doc for r in got])
    shifts = {r.doc_id: odds(want[i][1]) - odds(rate) for i, r in enumerate(got)}
    known = [(*learned[i], shifts[i]) for i in sorted(learned)]
    # the likeliest weight on a grid
    fit = lambda w: sum(np.log(q if y else 1 - q) for p, y, s in known for q in [1 / (1 + np.exp(-odds(p) - w * s))])
    weight = max((w / 100 for w in range(101)), key=fit)
    for i, r in enumerate(got):
        assert r.p_doc == pytest.approx(model.probability(np.array([quality.features(texts[r.doc_id] or "")]))[0])
        assert (r.p_host, r.p_path) == pytest.approx(want[i])
        assert r.score == pytest.approx(1 / (1 + np.exp(-odds(r.p_doc) - weight * shifts[r.doc_id])), abs=0.02) and r.kept == (r.score >= 0.5)
    held = {r.doc_id: r.quality for r in labels.collect() if held_out(r.doc_id) and r.quality is not None}
    assert sum(r.kept == (held[r.doc_id] == 1) for r in got if r.doc_id in held) / len([r for r in got if r.doc_id in held]) > 0.9
    assert quality.site_weight(np.array([0.5] * 40), np.array([1.0, -1.0] * 20), np.array([1.0, 0.0] * 20)) == 1.0
    assert quality.site_weight(np.array([0.5] * 40), np.array([1.0, -1.0] * 20), np.array([0.0, 1.0] * 20)) == 0.0


def test_quality_odd_rows(spark, tables, odd):
    docs, labels = tables
    assert quality.judge(odd, labels, ["doc_id"]).count() == len(ODD)
    assert quality.judge(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_mix_meets_targets(spark, odd):
    got = mixing.mix(mixing.sized(odd)).collect()
    assert len(got) == len(ODD)
    size = {s: sum(r["size"] for r in got if r.source == s) for s in {r.source for r in got}}
    for r in got:
        assert r.source_size == size[r.source] and 0 <= r.taken <= 2 * r["size"] and r.target <= 2 * size[r.source] + 1e-9
    for s in size:
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= max(1, size[s] * 0.5)
    assert mixing.mix(mixing.sized(odd.limit(0))).count() == 0


def test_mix_reruns_agree_and_newton_reaches_the_ratio(spark, tables):
    docs, _ = tables
    one, two = (sorted(map(tuple, mixing.mix(mixing.sized(docs.repartition(n))).select("doc_id", "taken").collect())) for n in (1, 6))
    assert one == two
    want = {"a": (1000, 2000.0), "b": (1000, 3.0), "c": (10**9, 1.0), "d": (5, 0.0), "e": (0, 0.0), None: (7, 7.0)}
    cells = spark.createDataFrame([(s, n // 5 if n > 9 else n, 5 if n > 9 else 1) for s, (n, _) in want.items()], "source string, size long, n long")
    targets = spark.createDataFrame([(s, n, t) for s, (n, t) in want.items()], "source string, source_size long, target double")
    rates = {r.source: r.rate for r in mixing.newton_tilt(cells, targets).collect()}
    assert rates == pytest.approx({s: t / n if n else 0 for s, (n, t) in want.items()}, rel=1e-9)


def test_expand_gives_what_the_mix_takes(spark, odd):
    want = {(r.doc_id, r.source): 0 for r in odd.collect()}
    for r in mixing.mix(mixing.sized(odd), near=mixing.NEAR).collect():
        want[r.doc_id, r.source] += r.taken
    rows = mixing.expand(odd).collect()
    got = dict.fromkeys(want, 0)
    texts = {t for _, t, _, _ in ODD}
    for r in rows:
        got[r.doc_id, r.source] += len(WORD.findall(r.text))
        assert r.text in texts or any((t or "").startswith(r.text) for t in texts)
    assert got == want and rows[0].asDict().keys() == dict.fromkeys(odd.columns).keys()
    assert mixing.expand(odd.limit(0)).count() == 0


def test_expand_deals_equal_rows_and_cuts_at_the_word(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BATCH", 3)
    monkeypatch.setattr(mixing, "NEAR", 0.0)
    rows = [(1, "a\tb  c\n\nd e", "s", 10)] * 20 + [(2, " x\ty\n\n z w v u", "t", 15), (3, "p  q\tr", "t", 7), (None, "m n", "u", 3), (None, "m n", "u", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = {}
    for r in mixing.mix(mixing.sized(df)).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = mixing.expand(df).collect()
    words = dict.fromkeys(taken, 0)
    whole = {i: t for i, t, _, _ in rows}
    for r in out:
        words[r.doc_id] += len(WORD.findall(r.text))
        assert whole[r.doc_id].startswith(r.text) and (r.text == whole[r.doc_id] or len(r.text) == r.n_chars and r.text[-1] not in " \t\n")
    assert words == taken and any(r.text != whole[r.doc_id] for r in out)


def test_pack_equals_the_tokenizer(spark, tables, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tricky = ["a  b", " a", "a ", "a\n b", "a\n  b", "  x", "don't  stop 'tis", "x <|endoftext|> y", "\t \t", "é　 ü", "a \n", "1 2 3", "a\x1c b", "a\u2028\u00a0b", "\n", " "]
    docs = tables[0].select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("doc_id <> 5 OR doc_id IS NULL")).unionByName(
        spark.createDataFrame([(-i - 1, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    )
    key = docs.withColumn("doc_id", F.xxhash64("doc_id", "text"))
    texts = {r.doc_id: r.text for r in key.collect()}
    pieces: dict[int, list] = {}
    for r in packing.pack(key).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for i, got in pieces.items():
        got = sorted({(r.start, r.length, bytes(r.ids), r.doc_tokens) for r in got})
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        assert b"".join(g[2] for g in got) == np.array(ids, "<u4").tobytes() and got[-1][3] == len(ids)
        assert all(n & (n - 1) == 0 and n <= 1024 for _, n, _, _ in got)


def test_op7_equals_the_tokenizer_as_it_is(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    end = "<|endoftext|>"
    texts = [f"x {end} y", end, end * 3, f"a  {end}  b", f" {end}\n", f"a{end}b {end[:-1]}", "plain text", f"x \n {end} {end}c  d", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.start, r.length): (r.ids_crc32, r.doc_tokens) for r in packing.op7_packing(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        start = 0
        for n in packing.piece_lengths(len(ids)):
            want[i, start, n] = (zlib.crc32(ids[start : start + n].tobytes()), len(ids))
            start += n
    assert got == want


def test_numbered_sequences_have_no_gaps(spark, odd):
    got = packing.digest(odd).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and {r.offset for r in got} == {0}
    assert [r.length for r in sorted(got, key=lambda r: r.sequence_id)] == sorted((r.length for r in got), reverse=True)
    many = packing.digest(odd.crossJoin(spark.range(40)).repartition(7)).collect()
    assert sorted(r.sequence_id for r in many) == list(range(40 * len(got)))
    assert packing.digest(odd.limit(0)).count() == 0
    assert [packing.piece_lengths(n) for n in (1, 3, 1024, 2051)] == [[1], [2, 1], [1024], [1024, 1024, 2, 1]]


def test_crc_is_of_little_endian_ids(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    row = packing.pack(df).select("ids", F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(bytes(row["ids"]))


def test_growth_moves_rows_only_into_the_new_shard(spark):
    got = sharding.assign(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", [1.0] * 16, [1.0] * 17).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert all(r.grown_shard == 16 for r in moved) and 0.04 < len(moved) / len(got) < 0.08
    sizes = np.bincount([r.shard for r in got], minlength=16)
    assert sizes.min() > 1000 and sizes.max() < 1500
    double = np.bincount([r.shard for r in sharding.assign(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", [2.0, 1.0, 1.0]).collect()])
    assert 9_500 < double[0] < 10_500


def test_shards_equal_plain_rendezvous(spark):
    keys = [*range(-20, 300), None, 2**62]
    weights = [1.0, 2.5, 0.5, 1.0]
    got = sharding.assign(spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id", weights, [*weights, 3.0]).collect()
    known = [r for r in got if r.doc_id is not None]
    assert all((r.shard, r.grown_shard) == (rendezvous(r.doc_id, weights), rendezvous(r.doc_id, [*weights, 3.0])) for r in known) and len(got) == len(keys)


def test_op10_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op10_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id == 1} == {(1, 0)}


def test_ranked_numbers_hot_groups(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(99)).otherwise(F.col("id") % 7).alias("g"))
    got = ranked(df, ["g"], ["id"], "n").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.id, r.n))
    for v in by.values():
        assert [n for _, n in sorted(v)] == list(range(len(v)))
