"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text's set of word shingles becomes a signature of ``COORDINATES``
   minima and a 128-bit sum that names the set.  Texts of equal sets form one
   class; only its representative goes on.
2. A class is posted under its coordinate-value pairs.  Two sets of the wanted
   likeness agree in at least ``MATCHES`` coordinates but for a chance below
   1e-6, so pairs are sought by counting collisions.  Prefix filter: with the
   coordinates of each class in order of rarity, two classes with ``MATCHES``
   agreements share one of the first ``COORDINATES - MATCHES + 1``.  Values
   that one class alone has cannot collide: they take up room in that prefix
   but are never posted, and a class with too few shared values leaves.
3. Skip merging: the lists of a class's most frequent values are not merged but
   probed, by counting agreeing coordinates of the pairs that the rarer lists
   yield.  Each list first meets one member only (a star), the one whose values
   are most frequent, which stands nearest to the text that all were copied
   from.  Confirmed links are contracted, and lists that lie within one
   component are skipped.
4. Pairs between components of a list that stays open are not read off the list:
   texts that share one frequent passage, but are not alike, would give all
   their pairs.  The lists tell who is open; open members are joined by the
   rarest shingles of their full sets, in prefixes whose lengths follow from
   both sizes, so no link between components is lost.  A list of thousands of
   copies costs its length, not its square.
5. Pairs with MATCHES agreeing coordinates or more are confirmed on full sets.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import map_texts, materialise, scratch, small, table
from graphloom.llm.components import components

SHINGLE = 5
#: Linked: 100 x intersection >= PERCENT x union.
PERCENT = 75
COORDINATES = 64
#: P(binomial(64, 0.75) < 28) is 4e-7.
MATCHES = 28
#: Ids of candidates are broadcast up to this many (16 bytes each) to filter texts before they are read into sets.
BROADCAST_IDS = 1_000_000
#: A set that more pairs need is sent in copies, one for each so many pairs.
CHUNK = 128

BLANKS = (9, 10, 11, 12, 13, 32)


@functools.cache
def _constants():
    """Hash constants, drawn from a fixed seed."""
    import numpy as np

    rng = np.random.default_rng(20240607)
    draw = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    blank = np.zeros(256, bool)
    blank[list(BLANKS)] = True
    return {"byte": draw(256), "radix": draw(1)[0], "order": draw(SHINGLE), "none": draw(SHINGLE), "a": draw(COORDINATES), "b": draw(COORDINATES), "blank": blank}


_powers: list = []


def _power(n: int):
    """Powers of the radix and of its inverse modulo 2^64, at least ``n`` of each."""
    import numpy as np

    if not _powers or len(_powers[0]) < n:
        radix = int(_constants()["radix"])
        inverse = pow(radix, -1, 1 << 64)
        size = max(n, 1 << 16)
        made = []
        for base in (radix, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers


def _mixed(x):
    """Bijective finalizer (xor-shift-multiply) on uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str):
    """Sorted distinct 64-bit hashes of the text's word shingles (uint64; none without words).

    A-Z is lowered; fewer than SHINGLE words are one shingle.  Word hashes are
    differences of one running polynomial over the bytes.
    """
    import numpy as np

    c = _constants()
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    solid = ~c["blank"][data]
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _power(len(data) + 1)
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c["byte"][data] * up[: len(data)], dtype=np.uint64)))
        words = _mixed((running[end] - running[start]) * down[start])
        if n < SHINGLE:
            parts = np.concatenate((words, c["none"][: SHINGLE - n]))
            return _mixed((parts * c["order"]).sum(keepdims=True, dtype=np.uint64))
        total = np.zeros(n - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            total += words[j : n - SHINGLE + 1 + j] * c["order"][j]
        return np.unique(_mixed(total))


def minima(hashes):
    """Signature: for each coordinate the least upper half of a*x + b (zeros for an empty set)."""
    import numpy as np

    c = _constants()
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            part = hashes[None, at : at + 4096] * c["a"][:, None] + c["b"][:, None]
            out = np.minimum(out, (part >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32).view(np.int32)


def _name(hashes) -> tuple[int, int]:
    """128 bits that name a set: wrapped sums of two finalizations."""
    import numpy as np

    with np.errstate(over="ignore"):
        one = int(_mixed(hashes).sum(dtype=np.uint64))
        two = int(_mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
    return one - (1 << 64) * (one >> 63), two - (1 << 64) * (two >> 63)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2, mins): size, name and signature of every row's set."""

    def run(texts: list[str]) -> list:
        sets = [shingle_set(t) for t in texts]
        names = [_name(s) for s in sets]
        return [[len(s) for s in sets], [a for a, _ in names], [b for _, b in names], [minima(s) for s in sets]]

    return map_texts(docs, ["doc_id"], run, "n bigint, h1 bigint, h2 bigint, mins array<int>")


def full_sets(docs: DataFrame, listed: bool = False) -> DataFrame:
    """(doc_id, h1, h2, hashes): the sets themselves, as sorted little-endian uint64 bytes or (``listed``) arrays of longs."""

    def run(texts: list[str]) -> list:
        sets = [shingle_set(t) for t in texts]
        names = [_name(s) for s in sets]
        return [[a for a, _ in names], [b for _, b in names], [s.view("int64") if listed else s.astype("<u8").tobytes() for s in sets]]

    return map_texts(docs, ["doc_id"], run, f"h1 bigint, h2 bigint, hashes {'array<bigint>' if listed else 'binary'}")


def postings(classes: DataFrame) -> DataFrame:
    """(key, rep, common) to be merged: each class under the rarest of its shared coordinate values.

    Of ``s`` shared values a class posts the ``s - MATCHES + 1`` rarest, which is
    the prefix of COORDINATES - MATCHES + 1 less the unshared values in it.
    ``common`` measures how frequent all its values are.
    """
    every = classes.select("rep", F.explode(F.transform("mins", lambda v, j: F.shiftleft(j.cast("long"), 32).bitwiseOR(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))).alias("key"))
    # written, so that adaptive execution sees two plain sides and can split the rows of a value that very many classes have
    often = materialise(every.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    shared = every.join(often, "key")
    rare = Window.partitionBy("rep").orderBy("often", "key")
    each = Window.partitionBy("rep")
    ranked_ = shared.withColumn("at", F.row_number().over(rare)).withColumn("s", F.count(F.lit(1)).over(each))
    ranked_ = ranked_.withColumn("common", F.round(F.sum(F.log("often")).over(each), 6))
    return ranked_.filter((F.col("s") >= MATCHES) & (F.col("at") <= F.col("s") - (MATCHES - 1))).select("key", "rep", "common")


def _with_sets(pairs: DataFrame, known: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """``pairs`` with set_{side} of their class on that side.

    A class in more than CHUNK pairs (``known`` has these pairs narrow) has its
    pairs dealt to copies of its set, so that no task gets all of a hub.
    """
    hubs = known.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("shares")).filter("shares > 1")
    hubs = small(materialise(hubs, "hubs"), BROADCAST_IDS)
    keys = [side, f"h1_{side}", f"h2_{side}"]
    other = "b" if side == "a" else "a"
    dealt = pairs.join(hubs, side, "left").withColumn("share", F.pmod(F.xxhash64(other), F.coalesce("shares", F.lit(1)))).drop("shares")
    named = sets.select(F.col("doc_id").alias(side), F.col("h1").alias(keys[1]), F.col("h2").alias(keys[2]), F.col("hashes").alias(f"set_{side}"))
    copies = named.join(hubs, side, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    return dealt.join(copies.withColumn("share", F.col("share").cast("long")), [*keys, "share"]).drop("share", keys[1], keys[2])


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: representatives) whose sets are linked.

    First the sizes and the count of agreeing coordinates, then the full sets,
    which are made only of texts that still stand in a pair.  Sets of ``a`` join
    first and travel on to ``b``, so ``b`` should be the side of the hubs.
    """
    one, two = (classes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "h1", "h2", "mins")]) for s in "ab")
    met = pairs.join(one, F.col("a") == F.col("rep_a")).join(two, F.col("b") == F.col("rep_b"))
    agree = F.aggregate(F.zip_with("mins_a", "mins_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda k, x: k + x)
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    close = materialise(met.filter(sized & (agree >= MATCHES)).select("a", "h1_a", "h2_a", "b", "h1_b", "h2_b"), "candidates")
    ids = close.select(F.col("a").alias("doc_id")).unionByName(close.select(F.col("b").alias("doc_id"))).distinct()
    ids = materialise(ids, "candidate-ids")
    n = ids.limit(BROADCAST_IDS + 1).count()
    if not n:
        return close.select("a", "b")
    read = docs.select("doc_id", "text").join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = full_sets(read).dropDuplicates(["doc_id", "h1", "h2"])
    both = _with_sets(_with_sets(close, close, sets, "a"), close, sets, "b").select("a", "b", "set_a", "set_b")

    def linked(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                inner = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * inner >= PERCENT * (len(p) + len(q) - inner))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(linked, "a bigint, b bigint")


def _stars(posted: DataFrame) -> DataFrame:
    """Each list's member of most frequent values (b) with every other one (a)."""
    centre = posted.groupBy("key").agg(F.max_by("rep", F.struct("common", "rep")).alias("b"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return posted.join(materialise(centre, "centres"), "key").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def _within_reach(r_a, n_a, r_b, n_b):
    """Whether a shingle at rarity ranks r_a, r_b lies in both prefixes of sets of sizes n_a, n_b that could be linked.

    Linked sets share at least o = ceil(PERCENT (n_a + n_b) / (100 + PERCENT))
    shingles, and then one of the first n - o + 1 of each in any common order.
    """
    o = F.ceil((n_a + n_b) * PERCENT / F.lit(100.0 + PERCENT) - 1e-9)
    return (r_a <= n_a - o + 1) & (r_b <= n_b - o + 1)


def _across(posted: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of members of open lists that are in different components and can be linked by their full sets.

    A list is open if it has more than one component; a member outside its
    list's largest one is a straggler, and one of each pair is.  Pairs come from
    an exact prefix join: shingles of the open members in order of rarity, ranks
    limited by both sizes.  Copies of one text that differ in many places share
    only frequent shingles, which stand behind these prefixes.
    """
    labelled = posted.join(found, posted["rep"] == found["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    per = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    open_ = per.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    rest = labelled.join(materialise(open_.select("key", "major"), "open-lists"), "key")
    members = rest.groupBy("rep").agg(F.min("component").alias("component"), F.max(F.col("component") != F.col("major")).alias("straggler"))
    members = materialise(members, "open-members")
    ids = members.select(F.col("rep").alias("doc_id"))
    read = docs.select("doc_id", "text").join(small(ids, BROADCAST_IDS), "doc_id", "left_semi")
    sets = materialise(full_sets(read, listed=True), "open-sets")
    each = sets.select("doc_id", "h1", F.size("hashes").alias("n"), F.explode("hashes").alias("x"))
    often = materialise(each.groupBy("x").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "often")
    rare = Window.partitionBy("doc_id", "h1").orderBy("c", "x")
    ranks = each.join(often, "x", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("r", F.dense_rank().over(rare))
    longest = F.col("n") - F.ceil(F.col("n") * PERCENT / 100.0 - 1e-9) + 1
    prefix = ranks.filter((F.col("c") > 1) & (F.col("r") <= longest)).join(members, F.col("doc_id") == F.col("rep"))
    prefix = materialise(prefix.select("x", "rep", "n", "r", "component", "straggler"), "open-prefixes")
    a = prefix.filter("straggler").select("x", *[F.col(c).alias(f"{c}_a") for c in ("rep", "n", "r", "component")])
    b = prefix.select(F.col("x").alias("x_b"), *[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "r", "component")])
    reach = _within_reach(F.col("r_a"), F.col("n_a"), F.col("r_b"), F.col("n_b"))
    pairs = a.join(b, (F.col("x") == F.col("x_b")) & (F.col("component_a") != F.col("component_b")) & reach)
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    A document is linked to another if 100 x intersection >= 75 x union of
    their shingle sets; the component's id is the least doc_id reachable and its
    document alone is kept.  Null, empty or blank texts have the empty set and
    are linked with nothing.  A very long text is one set of all its shingles,
    in the memory of one row.  Rows of one doc_id are one document: it is linked
    if any of its texts is.  Rows without doc_id are kept, unlinked, with null
    component.  An empty table gives no rows; other columns are not read,
    whatever their names.  The result is a written, narrow table; all that it was
    made from is dropped.
    """
    with scratch(docs.sparkSession) as held:
        return held.keep(materialise(_near_duplicates(docs.select("doc_id", "text")), "near-duplicates"))


def _near_duplicates(docs: DataFrame) -> DataFrame:
    signed = materialise(signatures(docs), "signatures")
    known = signed.filter("doc_id IS NOT NULL")
    grouped = known.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("mins").alias("mins"))
    classes = materialise(grouped, "classes")
    member = known.select("doc_id", "n", "h1", "h2").join(classes.select("rep", "n", "h1", "h2"), ["n", "h1", "h2"], "left")
    member = materialise(member.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")

    posted = materialise(postings(classes), "postings")
    links = materialise(confirm(_stars(posted), classes, docs), "links")
    found = materialise(components(links), "components")
    more = materialise(confirm(_across(posted, found, classes, docs), classes, docs), "links")

    # a doc_id of several texts joins their classes
    several = member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).filter("b < hi").select("doc_id", "b")
    joined = member.join(several, "doc_id").select(F.col("rep").alias("a"), "b").filter("a <> b")
    final = components(links.unionByName(more).unionByName(joined))

    labelled = member.join(final, member["rep"] == final["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )
    unknown = signed.filter("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return labelled.unionByName(unknown).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents; edge cases as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
