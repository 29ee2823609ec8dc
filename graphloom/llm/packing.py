"""Packing by power-of-two decomposition (Arrow batches: a tokenizer has no SQL form).

A document's ids, end id included, are cut into pieces whose lengths are powers
of two: as many of ``most`` as fit, then the binary digits of the rest, largest
first.  Every piece is a sequence by itself, sequences of equal length form a
bucket and batch together, so no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_ROWS, materialise, release, small, table

MOST = 1024
END = 0
TOKENIZER = "byte_bpe_50k.json"

#: Documents tokenized at once.
SLICE = 128
#: The vocabulary's split into pre-tokens, and the same for texts without two blanks in a row: a pattern
#: without look-ahead, which the engine runs as a plain automaton.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, copy bigint, task int, nth bigint"


def piece_lengths(n: int, most: int = MOST) -> list[int]:
    """Powers of two that sum to ``n``, none above ``most`` (a power of two), descending."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def single_spaced(text: str) -> bool:
    """No two blanks (in the widest sense) stand side by side."""
    if not text:
        return True
    words = text.split()
    blanks = len(text) - sum(map(len, words))
    return blanks <= len(words) - 1 + text[0].isspace() + text[-1].isspace()


class Encoder:
    """Whole-text ids as little-endian uint32 bytes, equal to those of the tokenizer file; none are put around a text.

    The file's vocabulary lists merges in order of id, so its tokens' bytes
    ranked by id are the whole model.  Strings of special tokens in a text are
    those tokens if ``added`` (the tokenizer's default), else ordinary text.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        named = {t["content"]: t["id"] for t in model.get("added_tokens", []) if t.get("special")}
        special = set(named.values())
        self.named = named if added else {}
        letters = byte_letters()
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if i not in special}
        self.full, self.single = (
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.named) for name, pattern in (("full", SPLIT), ("single", SPLIT_SINGLE))
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        from array import array

        def one(t: str) -> list[int]:
            engine = self.single if single_spaced(t) else self.full
            return engine.encode(t, allowed_special="all") if any(n in t for n in self.named) else engine.encode_ordinary(t)

        ids = [one(t) for t in texts]
        out = [array("I", i) for i in ids]
        if sys.byteorder == "big":
            for a in out:
                a.byteswap()
        return [a.tobytes() for a in out]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str | None, added: bool = False) -> Encoder:
    """One encoder a worker process and file; None: the public vocabulary ``TOKENIZER``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def pack(df: DataFrame, tokenizer: str | None = None, most: int = MOST, end: int = END, added: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, copy, task, nth) of every row's text; ``ids`` are little-endian uint32 bytes.

    ``copy`` tells rows apart, ``nth`` counts the pieces of one length in their
    task: write the pieces before they are read twice.  Null or empty text is
    the end id alone; a repeated row yields its pieces again.  Row-local: no
    shuffle; memory in proportion to SLICE texts, of which a very long one may
    be any.  Other columns of ``df`` are not read, whatever their names.
    ``added``: strings of special tokens in a text are those tokens, as in the
    tokenizer, else ordinary text.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(tokenizer, added)
        closing = int(end).to_bytes(4, "little")
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "copy": pa.int64(), "task": pa.int32(), "nth": pa.int64()}
        schema = pa.schema(list(kinds.items()))
        seen: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows: list[tuple] = []
                encoded = enc.encode([t or "" for t in part.column(1).to_pylist()])
                for doc, ids, copy, task in zip(part.column(0).to_pylist(), encoded, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    data = ids + closing
                    start, n = 0, len(data) // 4
                    for length in piece_lengths(n, most):
                        nth = seen[length] = seen.get(length, -1) + 1
                        rows.append((doc, start, length, data[4 * start : 4 * (start + length)], n, copy, task, nth))
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    row = F.monotonically_increasing_id().alias("copy"), F.spark_partition_id().alias("task")
    return df.select(F.col("doc_id").cast("bigint"), "text", *row).mapInArrow(run, PIECES)


def number(pieces: DataFrame) -> DataFrame:
    """Give each piece of a written table its sequence: numbers without gaps, bucket by bucket (longest first), then task by task.

    Each task has counted its own pieces of a length, so only one count a
    (length, task) is summed up: no piece is shuffled or sorted.
    """
    counts = materialise(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "bucket-tasks")
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n"))
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # one row a length: eleven at most
    buckets = lengths.select(F.col("length").alias("bucket"), F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("base"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    starts = inside.join(buckets, inside["length"] == buckets["bucket"]).select("length", "task", (F.col("base") + F.col("first")).alias("first"))
    starts = materialise(starts, "bucket-starts")
    release(counts)
    placed = pieces.join(small(starts, BROADCAST_ROWS), ["length", "task"]).withColumn("sequence_id", F.col("first") + F.col("nth"))
    return placed.withColumn("offset", F.lit(0).cast("long")).drop("first", "nth", "task")


def digest(docs: DataFrame) -> DataFrame:
    """The numbered pieces with a CRC in place of their ids."""
    pieces = materialise(pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids", "copy"), "pieces")
    return number(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame) -> DataFrame:
    """The numbered pieces with their ids, their CRC and ``copy``, which tells rows of one doc_id apart.

    Edge cases as in ``pack``; an empty table gives no rows.
    """
    pieces = materialise(pack(docs).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    return number(pieces).select("doc_id", "copy", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed.

    Null and empty texts are one piece, the end id; very long texts are many
    pieces of MOST; repeated rows are packed each; ties have no meaning here; an
    empty table gives no rows; other columns are not read, whatever their names.
    """
    return digest(table(spark, sf_dir, "documents"))
