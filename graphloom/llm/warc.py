"""WARC archives: writing with de-duplication, reading with boundary-chain verification.

A payload may hold the record magic itself, even whole fake records, so the magic
alone does not prove a boundary.  Reading therefore works in three steps:

1. Tasks read any byte range of any archive, cut at every magic, and emit one
   candidate a cut: its offset and the offset its own header declares for its
   successor.  Digests of complete candidates are taken on the way; contents
   are not kept.
2. Pointer jumping: from each file's start the set of reached offsets doubles
   with every round (reach is joined with jumps of length 1, 2, 4 ..), so a file
   of n records is verified in log2 n rounds of joins, across tasks and splits.
3. What is not reached lies inside a payload.  Only records that were cut by
   such a false magic are put together again, from a second read of their files.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.common import fresh_path, materialise, release, small, table

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
#: Equal payloads of at least so many bytes are stored once.
LEAST_BYTES = 100
#: A file holds at most so many records.
FILE_RECORDS = 16_384
#: Digests that occur twice, or pieces of cut records, are broadcast up to so many rows (about 60 bytes each).
BROADCAST_ROWS = 300_000
PREFIX = "urn:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def describe(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, bytes, digest, refers_to): who is a revisit of whom.

    Null html is an empty payload.  Of equal payloads of LEAST_BYTES or more the
    least page_id is the response; rows that repeat that page_id are responses
    too, and if all are null so are all.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html.cast("binary"), 256).alias("digest"))
    often = known.filter(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    often = materialise(often.select(F.col("digest").alias("_digest"), "first_id"), "twice")
    joined = known.join(small(often, BROADCAST_ROWS), (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= LEAST_BYTES), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "bytes", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record(row: dict[str, Column]) -> Column:
    """One WARC record as text, without its last line end (the writer adds it)."""
    is_revisit = row["refers_to"].isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _header("Content-Length", row["bytes"].cast("string")), F.lit("\r\n"))
    block = F.when(is_revisit, http).otherwise(F.concat(http, row["html"]))
    identity = F.concat(F.lit(f"<{PREFIX}"), F.coalesce(row["page_id"].cast("string"), F.lit("null")), F.lit(">"))
    refers = F.concat(F.lit(f"<{PREFIX}"), row["refers_to"].cast("string"), F.lit(">"))
    uri = F.regexp_replace(F.coalesce(row["url"], F.lit("about:blank")), r"[\x00-\x20\x7F]", "")
    return F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", identity),
        _header("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        _header("WARC-Target-URI", uri),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), row["digest"])),
        F.when(is_revisit, F.concat(_header("WARC-Refers-To", refers), _header("WARC-Profile", F.lit(REVISIT)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )


def write(pages: DataFrame, path: str) -> None:
    """Write a record per row of ``pages`` (page_id, url, html).  Each task commits its files whole, or not at all."""
    rows = describe(pages)
    out = rows.select(record({c: F.col(c) for c in rows.columns}).alias("value"))
    out.write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


CANDIDATE = (
    "file bigint, block bigint, nth bigint, local bigint, size bigint, declared bigint, whole boolean, kind string, identity string, "
    "refers string, payload_bytes bigint, payload_digest string"
)


def _parsed(chunk: bytes) -> tuple:
    """(declared size from the magic's end to the successor's magic, whole, kind, identity, refers, payload bytes, digest)."""
    import hashlib

    head, gap, rest = chunk.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return (None, False) + (None,) * 5
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not gap or not length.isdigit():
        return (None, False) + (None,) * 5
    declared = len(head) + 4 + int(length) + 4
    text = lambda name: fields.get(name, b"").decode("utf-8", "replace")
    kind = text(b"warc-type")
    known = (kind, text(b"warc-record-id"), text(b"warc-refers-to"))
    if declared != len(chunk) or not chunk.endswith(b"\r\n\r\n"):
        return (declared, False, *known, None, None)
    http, _, payload = rest[: int(length)].partition(b"\r\n\r\n")
    if kind == "revisit":
        sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return (declared, True, *known, int(sizes[0]) if sizes else 0, text(b"warc-payload-digest").removeprefix("sha256:"))
    return (declared, True, *known, len(payload), hashlib.sha256(payload).hexdigest())


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value binary): what stands between magics, in file order within a task."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def _numbered(batches: Iterator) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(file, block, number in block, offset in block, content) of every chunk; chunks of a block arrive in order."""
    at, nth, local = None, 0, 0
    for batch in batches:
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (file, block) != at:
                at, nth, local = (file, block), 0, 0
            chunk = value.as_py() or b""
            yield file, block, nth, local, chunk
            nth += 1
            local += len(chunk) + len(MAGIC)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic of the archives at ``path`` with its file offset ``at`` and the declared offset ``next`` of its successor.

    Offsets inside a byte range are counted by the task that reads it; the
    ranges' lengths, one row a range, are summed up to give each its start.
    """

    fields = StructType.fromDDL(CANDIDATE)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        rows: list[tuple] = []
        for file, block, nth, local, chunk in _numbered(batches):
            rows.append((file, block, nth, local, len(chunk), *_parsed(chunk)))
            if len(rows) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    seen = materialise(_chunks(spark, path).mapInArrow(run, CANDIDATE), "candidates")
    blocks = seen.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    at = F.col("base") + F.col("local") - len(MAGIC)
    placed = seen.join(starts, ["file", "block"]).withColumn("at", at).filter("at >= 0")
    return materialise(placed.withColumn("next", F.col("at") + len(MAGIC) + F.col("declared")).drop("base", "local", "declared"), "placed")


def reachable(found: DataFrame, most_rounds: int = 48) -> DataFrame:
    """(file, at) of the candidates on the chain from offset 0 of their file, by pointer jumping."""
    jump = materialise(found.filter("next IS NOT NULL").select("file", "at", "next"), "jump")
    reach = materialise(found.filter("at = 0").select("file", "at"), "reach")
    n = reach.count()
    for _ in range(most_rounds):
        moved = reach.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        longer = materialise(reach.unionByName(moved).distinct(), "reach")
        m = longer.count()
        release(reach)
        reach = longer
        if m == n:
            return reach
        n = m
        on = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        twice = materialise(jump.join(on, ["file", "next"]).select("file", "at", F.col("after").alias("next")), "jump")
        release(jump)
        jump = twice
    raise RuntimeError("a chain longer than 2^48 records")


def _rejoined(spark: SparkSession, path: str, found: DataFrame, cut: DataFrame) -> DataFrame:
    """Payload facts of records that false magics cut: (file, at, payload_bytes, payload_digest).

    ``found`` has all chunks with ``owner``, the offset of the record each lies in; ``cut`` the records to repair.
    A record's chunks meet in one row, as large as that record.
    """
    pieces = found.select("file", "block", "nth", "at", "owner").join(cut.select("file", F.col("at").alias("owner")), ["file", "owner"])
    pieces = materialise(pieces, "pieces")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for file, block, nth, _, chunk in _numbered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((file, pa.int64()), (block, pa.int64()), (nth, pa.int64()), (chunk, pa.binary()))], names=["file", "block", "nth", "value"])

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = []
            for parts in batch.column(2).to_pylist():
                whole = MAGIC.encode().join(p["value"] for p in parts)
                made.append(_parsed(whole)[5:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())],
                names=["file", "at", "payload_bytes", "payload_digest"],
            )

    wanted = _chunks(spark, path).mapInArrow(run, "file bigint, block bigint, nth bigint, value binary")
    whole = wanted.join(small(pieces, BROADCAST_ROWS), ["file", "block", "nth"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    return whole.mapInArrow(join, "file bigint, at bigint, payload_bytes bigint, payload_digest string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record on the verified chains: kind, identity, refers, payload_bytes, payload_digest.

    The digest is that of the stored payload (of a revisit: the one its header
    states).  Bytes that no chain reaches are ignored; a chain that leads into
    no candidate ends there.  An empty archive gives no rows.
    """
    found = candidates(spark, path)
    reach = materialise(reachable(found), "reached")
    true = materialise(found.join(reach, ["file", "at"]), "records")
    cut = true.filter(~F.col("whole"))
    facts = ["kind", "identity", "refers", "payload_bytes", "payload_digest"]
    good = true.filter("whole").select(*facts)
    if not cut.limit(1).count():
        return good
    broken = cut.select("file").distinct()
    marked = found.join(broken, "file").join(reach.withColumn("owner", F.col("at")), ["file", "at"], "left")
    so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("owner", F.max("owner").over(so_far))
    repaired = _rejoined(spark, path, owned, cut)
    return good.unionByName(cut.select("file", "at", "kind", "identity", "refers").join(repaired, ["file", "at"]).select(*facts))


def _page(identity: Column) -> Column:
    return F.expr(f"try_cast(regexp_extract({identity}, '{PREFIX}(-?[0-9]+)>', 1) AS bigint)")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back.  An empty table gives no rows."""
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select(
        _page("identity").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), _page("refers").alias("refers_to")
    )


OP4_SQL = """
WITH described AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM described WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND d.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND d.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM described d LEFT JOIN firsts f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
