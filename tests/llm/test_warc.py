import hashlib

from graphloom.llm import warc
from graphloom.llm.common import fresh_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def expected(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = data in first and first[data] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, rows, split=None):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split or before)
    try:
        path = fresh_path(spark, "warc")
        warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
        got = warc.read(spark, path).select(
            warc._page("identity").alias("i"), "payload_bytes", "payload_digest", "kind", warc._page("refers").alias("r")
        )
        return sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_magic_fake_records_and_copies(spark):
    same = "<p>copy</p>" * 20
    rows = [(5, "u", same), (3, "u", same), (9, "u x\r\ny", same), (1, None, None), (2, "u", ""), (4, "u", "short"), (6, "u", "short")]
    rows += [(10, "u", FAKE), (11, "u", "x" + FAKE * 3 + "y"), (12, "u", "WARC/1.1\r\n"), (13, "u", "WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n\r\n"), (None, "u", "no id é")]
    rows += [(100 + i, "u", f"page {i} é " + "w " * (i * 7 % 90) + (FAKE if i % 5 == 0 else "")) for i in range(120)]
    assert round_trip(spark, rows) == expected(rows)
    # small byte ranges: records, magics and fakes across the borders of splits
    assert round_trip(spark, rows, "777b") == expected(rows)


def test_no_pages(spark):
    assert round_trip(spark, []) == []


def test_clashing_names_long_pages_and_repeats(spark, tmp_path):
    from pyspark.sql import functions as F

    long = "<p>" + "é " * 300_000 + FAKE + "</p>"
    rows = [(1, "u", long), (2, "u", long), (2, "u", long), (None, None, long), (3, None, None), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", "x" * 100), (7, "u", "x" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("clash").alias(c) for c in ("bytes", "digest", "refers_to", "first_id", "_digest", "file", "block", "value")])
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op4_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
