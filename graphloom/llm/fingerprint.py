"""Order MinHash fingerprints (DataFrame functions only).

A text is cut into tokens, its k-mers are ``K`` consecutive tokens, and the
n-th occurrence of a k-mer is an element of its own.  Each coordinate orders
all elements at random, takes the ``L`` least, puts them back into text order
and hashes the tuple, so a coordinate of two texts agrees when they share those
elements *in the same order*: likeness falls with edit distance, not only with
the k-mer sets' difference.

The coordinates' orders are circulant permutations of ``ORDERS`` independent
ones: elements get one hash an order, and a coordinate starts its order at an
anchor on the hash circle, wrapping round.  One sort of the hashes then serves
all coordinates of an order: those of an anchor are the next ``L`` elements from
there on.  A text of n elements has at most n distinct coordinates an order, so
likeness is coarser for texts of less than ``COORDINATES / ORDERS`` elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.arrays import AT_BITS, HASH_BITS, HASH_MASK, high, low
from graphloom.llm.common import materialise, shuffle_width, spaced, table

K = 3
#: ``coordinate`` orders a pair.
L = 2
COORDINATES = 64
#: Independent orders, each read from COORDINATES / ORDERS anchors.
ORDERS = 4
#: Longer words are cut, each by itself, so that texts without blanks have many tokens too.
TOKEN = 24
#: The "next document" pass deals documents to at most so many buckets of consecutive ids.
MOST_BUCKETS = 65_536


def with_tokens(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add array ``name``: the text's words, those longer than TOKEN as pieces of TOKEN characters."""
    spaces = df.withColumn("_fp_spaced", spaced(text)).withColumn(name, F.array_remove(F.split("_fp_spaced", " ", -1), ""))
    pieces = F.regexp_extract_all(F.col("_fp_spaced"), F.lit("[^ ]{1,%d}" % TOKEN), F.lit(0))
    # the pattern finds the same tokens where no word is long, but a split is faster
    longer = F.exists(name, lambda w: F.length(w) > TOKEN)
    return spaces.withColumn(name, F.when(longer, pieces).otherwise(F.col(name))).drop("_fp_spaced")


def kmers(tokens: Column) -> Column:
    """Packed (hash of K consecutive tokens, position), sorted; a shorter text is one k-mer."""
    first = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (K - 1), F.lit(1)))
    after = lambda i, j: F.when(i + j < F.size(tokens), tokens[F.least(i + j, F.size(tokens) - 1)])
    long = lambda x, i: F.xxhash64(x, *[tokens[i + j] for j in range(1, K)])
    short = lambda x, i: F.xxhash64(x, *[after(i, j) for j in range(1, K)])
    pack = lambda h, i: h.bitwiseAND(F.lit(HASH_MASK)).bitwiseOR(i.cast("long"))
    grams = F.when(F.size(tokens) >= K, F.transform(first, lambda x, i: pack(long(x, i), i))).otherwise(
        F.transform(first, lambda x, i: pack(short(x, i), i))
    )
    return F.sort_array(grams)


def _numbered(pack: Column) -> Column:
    """Packed k-mers sorted -> packed elements (k-mer and its occurrence number, position), sorted.

    The first occurrence keeps the k-mer's hash, the n-th hashes the k-mer with
    n.  Equal k-mers stand together in text order; the start of an element's
    run is found by steps of falling powers of two, so a text that repeats one
    word n times costs n log n.
    """
    bits = F.array(*[F.lit(1 << b) for b in range(AT_BITS - 1, -1, -1)])

    def element(x: Column, t: Column) -> Column:
        same = lambda s: F.shiftright(pack[s].bitwiseXOR(x), AT_BITS) == 0
        start = F.aggregate(bits, t, lambda at, step: F.when((at >= step) & same(F.greatest(at - step, F.lit(0))), at - step).otherwise(at))
        again = F.xxhash64(high(x), t - start).bitwiseAND(F.lit(HASH_MASK)).bitwiseOR(low(x))
        return F.when((t > 0) & same(F.greatest(t - 1, F.lit(0))), again).otherwise(x)

    return F.sort_array(F.transform(pack, element))


def anchors() -> list[int]:
    """Evenly spaced starting points on the circle of packed hashes."""
    each = COORDINATES // ORDERS
    return [(j * (1 << HASH_BITS) // each) << AT_BITS for j in range(each)]


def _reordered(s: Column, order: int) -> Column:
    """Packed elements in another random order (order 0: as they are)."""
    if not order:
        return s
    return F.sort_array(F.transform(s, lambda x: F.xxhash64(high(x), F.lit(-order)).bitwiseAND(F.lit(HASH_MASK)).bitwiseOR(low(x))))


def _coordinate(s: Column):
    """Function of a count of packed elements below an anchor: hash of the ``L`` elements of ``s`` from there on, in text order."""

    def of(below: Column) -> Column:
        a, b = (s[F.pmod(below + i, F.size(s))] for i in range(L))
        return F.when(low(a) <= low(b), F.hash(high(a), high(b))).otherwise(F.hash(high(b), high(a)))

    return of


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add array<int> ``name``: one 32-bit hash a coordinate; null or blank text gives an empty array.

    A text of fewer than K tokens is one k-mer.  Row-local: no shuffle, memory
    in proportion to the row's own text.
    """
    t = "_fp_"
    out = with_tokens(df, text, f"{t}w")
    out = out.withColumn(f"{t}p", kmers(F.col(f"{t}w"))).drop(f"{t}w")
    out = out.withColumn(f"{t}s", _numbered(F.col(f"{t}p"))).drop(f"{t}p")
    marks = anchors()
    prints = []
    for order in range(ORDERS):
        s = F.col(f"{t}o")
        out = out.withColumn(f"{t}o", _reordered(F.col(f"{t}s"), order))
        # anchors sorted in among the elements: an anchor's place less the anchors before it counts the elements below it
        out = out.withColumn(f"{t}m", F.sort_array(F.concat(s, F.array(*[F.lit(a) for a in marks]))))
        below = [(F.array_position(f"{t}m", F.lit(a)) - (1 + j)).cast("int") for j, a in enumerate(marks)]
        out = out.withColumn(f"{t}b", F.array(*below)).drop(f"{t}m")

        prints.append(f"{t}{order}")
        found = F.when(F.size(s) > 0, F.transform(f"{t}b", _coordinate(s))).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(prints[-1], found).drop(f"{t}o", f"{t}b")
    return out.withColumn(name, F.concat(*prints)).drop(f"{t}s", *prints)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal coordinates; two texts without tokens are alike (1), one without is unlike any other (0)."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    both = F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), equal / F.lit(float(COORDINATES))).otherwise(both)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def _bucket(ids: DataFrame, key: str, buckets: int) -> Column:
    """Number of the id range of equal row count that ``key`` falls in (null ids: the last).

    The boundaries come from one quantile sketch; at most MOST_BUCKETS numbers reach the driver.
    """
    shares = "[" + ",".join(str(i / buckets) for i in range(1, buckets)) + "]"
    cuts = ids.agg(F.percentile_approx(key, F.from_json(F.lit(shares), "array<double>"), 20 * buckets).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    bounds = F.from_json(F.lit(str(cuts)), "array<bigint>")
    top = 1 << (len(cuts).bit_length() - 1)
    steps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])
    at_least = lambda at, step: bounds[F.least(at + step, F.lit(len(cuts))) - 1] <= F.col(key)
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & at_least(at, step), at + step).otherwise(at)
    )
    return F.when(F.col(key).isNull(), F.lit(len(cuts) + 1)).otherwise(found)


def with_heads(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``bucket`` and ``copy``, and a marked copy of each bucket's first row in the bucket before.

    Ids are dealt to ranges of equal count; order: doc_id (nulls last), then
    text.  With the copies, no range waits for another to see what comes next.
    """
    dealt = docs.withColumn("bucket", _bucket(docs.select("doc_id"), "doc_id", buckets)).withColumn("copy", F.lit(False))
    least = dealt.groupBy("bucket").agg(F.min("doc_id").alias("_head"))
    heads = (
        dealt.join(F.broadcast(least.withColumnRenamed("bucket", "_b")), (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_head")))
        .groupBy("bucket")
        .agg(F.min(F.struct("text", "doc_id")).alias("h"))
    )
    around = Window.orderBy("bucket")
    last = F.max("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = materialise(heads, "heads")
    before = heads.select("bucket").select("bucket", F.coalesce(F.lag("bucket").over(around), last).alias("_before"))
    copies = heads.join(F.broadcast(before), "bucket").select("h.doc_id", "h.text", F.col("_before").alias("bucket"), F.lit(True).alias("copy"))
    return dealt.unionByName(copies)


def beside_next(printed: DataFrame) -> DataFrame:
    """Rows of ``with_heads`` (and ``print``) with the next document's text and print, copies left out; after the last comes the first.

    One exchange of the texts by bucket; inside a bucket the next row is a window's lead.
    """
    within = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_last(), "text")
    lead = printed.withColumn("next_text", F.lead("text").over(within)).withColumn("next_print", F.lead("print").over(within))
    return lead.filter(~F.col("copy")).drop("bucket", "copy")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document.

    Null text is empty; an empty or blank text has the fingerprint '' and likeness
    1 to another such one, 0 to any other; a single document's next is itself;
    an empty table gives no rows.  Repeated doc_ids follow each other by text,
    null ids are last; rows of one doc_id (or none) share a bucket.  A very long
    text is fingerprinted whole, in memory in proportion to it.  Other columns
    are not read, whatever their names.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = max(1, min(MOST_BUCKETS, 4 * shuffle_width(spark)))
    pairs = beside_next(with_fingerprint(with_heads(docs, buckets), F.col("text"), "print"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - half), F.substring("next_text", 1, half))
    texts = pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "print", likeness(F.col("print"), F.col("next_print")).alias("near_next")
    )
    both = with_fingerprint(texts, F.col("edited"), "edited_print")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        "near_next",
    )
