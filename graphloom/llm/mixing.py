"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Among all document rates that meet each source's token target, entropy
balancing takes the one nearest to "every document once" in token-weighted
Kullback-Leibler divergence:

    min  sum_d size_d (r_d ln r_d - r_d)   with   sum_{d in s} size_d r_d = T_s

Its dual is convex, its solution the exponential tilt ``r_d = exp(lambda_s)``.
Every Newton iteration is a pass over the documents, pre-aggregated to a count
for each (source, size): it sums the tokens under the present tilt, which is the
Hessian and, less the target, the gradient, and moves each source's tilt.
With one token constraint a source the Hessian is diagonal and the solution is
known, ``lambda_s = ln(T_s / sum of sizes)``; the tests hold the iteration, and
the SQL twin the whole mix, against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import content, materialise, ranked, release, scratch, shuffle_width, small, spaced, table, unused, words

#: Fixed by the contract of the mix: weights by source in code point order, share of all tokens, most repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2

#: Newton from 0 falls by at most 1 an iteration until it is near ln(T/S), then converges quadratically; a step below
#: STILL ends it.  More than NEWTON_STEPS iterations (a target below e^-200 of its source) are an error.
NEWTON_STEPS = 250
STILL = 1e-12
#: Tilts are broadcast up to so many sources (about 60 bytes each).
SOURCES = 200_000
#: Rates are held in billionths, so that rounding is integer arithmetic.
UNIT = 1_000_000_000


def capped_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Token target of each source: weight's share of ``share`` x all tokens, never above ``most`` x its own.

    ``totals`` has one row a source (source, source_size).  Resharing the
    excess by weight until none is above ends with the sources of least
    ``cap / weight`` at their caps and all others at one level a weight, which
    a running sum in that order finds directly.  Sources are few beside
    documents: the windows here see one row a source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(every) - 1) % n + 1)
    capped = totals.select("source", "source_size", cycle.alias("weight"), (F.col("source_size") * most).alias("cap"))
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = capped.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("_below"),
        F.sum("weight").over(onward).alias("_rest"),
        (F.sum("source_size").over(whole) * F.lit(share)).alias("_all"),
    ).withColumn("_full", F.col("cap") * F.col("_rest") <= F.col("weight") * (F.col("_all") - F.col("_below")))
    free = F.col("_full") == F.lit(False)
    left = F.col("_all") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(whole)
    share_of = F.col("weight") * left / F.sum(F.when(free, F.col("weight")).otherwise(0)).over(whole)
    return level.withColumn("target", F.when(F.col("_full"), F.col("cap").cast("double")).otherwise(share_of)).select(
        "source", "source_size", "target"
    )


def newton_tilt(cells: DataFrame, targets: DataFrame, most: int = NEWTON_STEPS) -> DataFrame:
    """``targets`` with ``tilt`` = the dual's lambda of each source, and ``rate`` = exp(tilt).

    ``cells`` counts documents: (source, size, n).  An iteration sums n x size x
    exp(tilt) over a source's cells in tasks and then over tasks, and steps by
    gradient / Hessian; only the largest step comes to the driver.  A source
    without tokens or without a target has no tilt and rate 0.
    """
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    now = materialise(targets.select("source", "source_size", "target", F.when(live, F.lit(0.0)).alias("tilt")), "mix-tilts")
    for _ in range(most):
        tilted = cells.alias("c").join(small(now, SOURCES).alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).filter("t.tilt IS NOT NULL")
        passed = tilted.groupBy("t.source", "t.source_size", "t.target", "t.tilt").agg(F.sum(F.col("c.n") * F.col("c.size") * F.exp("t.tilt")).alias("tokens"))
        stepped = passed.select("source", "source_size", "target", "tilt", ((F.col("tokens") - F.col("target")) / F.col("tokens")).alias("step"))
        still = now.filter("tilt IS NULL").select("*", F.lit(0.0).alias("step"))
        after = materialise(stepped.withColumn("tilt", F.col("tilt") - F.col("step")).unionByName(still), "mix-tilts")
        release(now)
        now = after.drop("step")
        now.graphloom_path = after.graphloom_path
        if (after.agg(F.max(F.abs("step"))).first()[0] or 0.0) < STILL:
            return now.withColumn("rate", F.coalesce(F.exp("tilt"), F.lit(0.0)))
    raise RuntimeError(f"the tilts did not settle in {most} iterations")


def mix(df: DataFrame, carry: tuple[str, ...] = (), near: float = 0.0) -> DataFrame:
    """Entropy-balanced copies of every row of ``df`` (needs doc_id, source and size; ``carry`` are more columns to keep).

    Rates become whole copies by systematic rounding along each source's
    documents from the largest to the smallest, which keeps the taken tokens
    within one document of the target; the source's largest document then takes
    the remainder (never below 0 or above twice its size): as whole copies where
    that leaves the source within ``near`` x target, else its last copy is cut.
    Adds source_size, target, rate, copies (whole copies before the remainder)
    and taken.

    Null source is a source of its own, last in order; null size counts as 0 and
    takes 0; rows of equal doc_id are mixed each; ties in size go by doc_id, then
    by the carried columns; no hash or random draw is used, so reruns agree; an
    empty table gives no rows.  Columns that are not named are not read; names of
    ``carry`` must not be those of the result.
    """
    docs = df.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), *carry)
    docs = materialise(docs, "mix-sizes")
    rank, unit, rest = unused([*docs.columns, "source_size", "target", "rate", "copies", "taken"], "_rank", "_unit", "_others")
    rows = ranked(docs, ["source"], [F.desc("size"), F.asc("doc_id"), *carry], rank)
    cells = materialise(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = materialise(newton_tilt(cells, capped_targets(totals)), "mix-targets")
    release(docs, cells)
    rates = small(solved, SOURCES).select("*", F.floor(F.col("rate") * UNIT + 0.5).cast("long").alias(unit))
    whole = lambda i: F.expr(f"({i} * {unit} + {UNIT // 2}) div {UNIT}")
    dealt = (
        rows.alias("r")
        .join(rates.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select("r.doc_id", "r.source", "r.size", *[f"r.{c}" for c in carry], rank, "source_size", "target", "rate", unit)
        .withColumn("copies", whole(f"({rank} + 1)") - whole(rank))
    )
    others = dealt.filter(F.col(rank) > 0).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias(rest))
    others = materialise(others, "mix-others")
    left = F.least(F.greatest(F.floor(F.col("target") + 0.5).cast("long") - F.coalesce(F.col(rest), F.lit(0)), F.lit(0)), F.col("size") * MOST)
    uncut = F.least(F.floor(left / F.nullif(F.col("size"), F.lit(0)) + 0.5).cast("long"), F.lit(MOST)) * F.col("size")
    last = F.when(F.abs(uncut - left) <= F.lit(near) * F.col("target"), uncut).otherwise(left)
    return (
        dealt.alias("d")
        .join(small(others, SOURCES).alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")), "left")
        .withColumn("taken", F.when(F.col(rank) > 0, F.col("copies") * F.col("size")).otherwise(last))
        .select("d.doc_id", "d.source", "d.size", *[f"d.{c}" for c in carry], "source_size", "target", "rate", "copies", "taken")
    )


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), *carry)


def up_to_word(text: Column, n: Column) -> Column:
    """``text`` from its beginning to the end of its ``n``-th word (n >= 1), every blank as it stands."""
    start = F.struct(n.cast("long").alias("left"), F.lit(-1).cast("long").alias("end"))

    def step(s: Column, token: Column) -> Column:
        more = F.struct((s["left"] - F.when(token != "", 1).otherwise(0)).alias("left"), (s["end"] + 1 + F.length(token)).alias("end"))
        return F.when(s["left"] <= 0, s).otherwise(more)

    end = F.aggregate(F.split(spaced(text), " ", -1), start, step)["end"]
    return F.substring(text, F.lit(1), end.cast("int"))


#: A source that whole copies leave within this share of its target has none of its documents cut.
NEAR = 0.01
#: Copies that one row is turned into at once.
BATCH = 1_024


def expand(docs: DataFrame) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as taken.

    Copies are whole texts, unless whole copies leave a source farther than NEAR
    from its target: then the last copy of its largest document ends after the
    word where the mix cuts it, and n_chars, if there, follows.  Columns are those
    of ``docs``, whatever their names.  Only (doc_id, a hash of the row) travel
    through the mix; a row that takes nothing goes.  Rows equal in all columns
    share their copies: their text is taken once and the copies are dealt to
    tasks in batches.  Null texts and an empty table give no rows.
    """
    spark = docs.sparkSession
    key, taken, size, n, full, rest, part, cut = unused(docs.columns, "_key", "_taken", "_size", "_n", "_full", "_rest", "_part", "_cut")
    keyed = docs.withColumn(key, content([c for c, kind in docs.dtypes if "map<" not in kind]))
    with scratch(spark) as held:
        mixed = mix(sized(keyed, (key,)), (key,), NEAR).filter("taken > 0")
        per = mixed.groupBy("doc_id", key).agg(F.sum("taken").alias(taken), F.max("size").alias(size), F.count(F.lit(1)).alias(n))
        takes = held.keep(materialise(per, "mix-takes"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a[key] == b[key])
    found = takes.select(F.col("doc_id").alias("_doc"), F.col(key).alias("_own"), n, F.expr(f"{taken} div {size}").alias(full), F.expr(f"{taken} % {size}").alias(rest))

    def met(rows: DataFrame, takers: DataFrame) -> DataFrame:
        t = takers.alias("t")
        return rows.alias("d").join(t, F.col("d.doc_id").eqNullSafe(F.col("t._doc")) & (F.col(f"d.{key}") == F.col("t._own"))).select("d.*", f"t.{full}", f"t.{rest}")

    out = met(keyed, found.filter(F.col(n) == 1)).withColumn(part, F.lit(0).cast("long"))
    if takes.filter(F.col(n) > 1).limit(1).count():
        several = takes.filter(F.col(n) > 1)
        once = keyed.join(several, same(keyed, several), "left_semi").dropDuplicates(["doc_id", key])
        batches = F.sequence(F.lit(0).cast("long"), F.expr(f"{full} div {BATCH}"))
        out = out.unionByName(met(once, found.filter(F.col(n) > 1)).withColumn(part, F.explode(batches)).repartition(shuffle_width(spark)))
    here = F.least(F.greatest(F.col(full) - F.col(part) * BATCH, F.lit(0)), F.lit(BATCH)).cast("int")
    whole = F.array_repeat(F.lit(0).cast("long"), here)
    last = F.when((F.col(rest) > 0) & (F.col(part) == 0), F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    dealt = out.withColumn(cut, F.explode(F.concat(whole, last)))
    dealt = dealt.withColumn("text", F.when(F.col(cut) > 0, up_to_word(F.col("text"), F.col(cut))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        dealt = dealt.withColumn("n_chars", F.when(F.col(cut) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return dealt.select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source.

    Null, empty and blank texts have size 0 and take 0; a very long text is
    counted whole; repeated rows are mixed each; an empty table gives no rows;
    other columns of the table are not read, whatever their names.
    """
    return mix(sized(table(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighted AS (
  SELECT source, source_size, source_size * 2 AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM totals
), level AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         (SELECT sum(source_size) FROM totals) * CAST(1.5 AS DOUBLE) AS everything
  FROM weighted
), marked AS (
  SELECT *, cap * rest <= weight * (everything - below) AS full_up FROM level
), targets AS (
  SELECT source, source_size,
         CASE WHEN full_up THEN CAST(cap AS DOUBLE)
              ELSE weight * (everything - (SELECT coalesce(sum(cap), 0) FROM marked WHERE full_up))
                   / (SELECT sum(weight) FROM marked WHERE NOT full_up) END AS target
  FROM marked
), rates AS (
  SELECT *, CASE WHEN source_size > 0 AND target > 0 THEN CAST(floor(target / source_size * 1000000000 + 0.5) AS BIGINT) ELSE 0 END AS unit
  FROM targets
), dealt AS (
  SELECT d.doc_id, d.size, r.source, r.source_size, r.target, d.rn,
         (CAST(d.rn AS HUGEINT) * unit + 500000000) // 1000000000 - (CAST(d.rn - 1 AS HUGEINT) * unit + 500000000) // 1000000000 AS copies
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) AS rn FROM docs) d
  JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), others AS (
  SELECT source, CAST(sum(copies * size) AS BIGINT) AS words FROM dealt WHERE rn > 1 GROUP BY source
)
SELECT d.doc_id, d.size, d.source_size, d.target,
       CAST(CASE WHEN d.rn > 1 THEN d.copies * d.size
                 ELSE greatest(0, least(CAST(floor(d.target + 0.5) AS BIGINT) - coalesce(o.words, 0), 2 * d.size)) END AS BIGINT) AS taken
FROM dealt d LEFT JOIN others o ON d.source IS NOT DISTINCT FROM o.source
"""
