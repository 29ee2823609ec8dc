"""Shared pieces of the training-data operators: words, and Python functions over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.ordering import BROADCAST_ROWS, ranked, shuffle_width, small, unused
from graphloom.sources.shared import fresh_path, materialise, release, scratch
from graphloom.sources.tables import table

__all__ = [
    "BROADCAST_ROWS", "content", "fresh_path", "map_texts", "materialise", "ranked", "release", "scratch", "shuffle_width", "small", "spaced", "table",
    "unused", "words",
]

#: The white space of the contracts: space and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"

def spaced(text: Column) -> Column:
    """``text`` with every blank of the contracts turned into a space; null gives ''."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit(" ")), BLANK[1:], F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    """The maximal runs ``[^\\x20\\x09-\\x0D]+`` of ``text`` in order (null or blank: none)."""
    return F.array_remove(F.split(spaced(text), " ", -1), "")


def content(columns: Sequence[str]) -> Column:
    """64 bits that name a row by what it holds in ``columns``; together with an id they tell rows apart without their texts."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


#: Texts that one call of a Python function sees; results leave the worker slice by slice.
TEXTS = 256


def map_texts(df: DataFrame, carry: Sequence[str], run: Callable[[list[str]], list], added: str) -> DataFrame:
    """Columns ``carry`` of ``df`` with those that ``run`` makes of its texts, over Arrow batches.

    ``run`` gets up to TEXTS whole texts (null as '') and returns a list or
    array for each column of the schema ``added``.  Carried columns pass as
    Arrow arrays, so nulls and large integers stay what they are; other
    columns of ``df`` are not read, whatever their names.
    """
    head = df.select(*carry)
    schema = T.StructType([*head.schema.fields, *T.StructType.fromDDL(added).fields])

    def batches(arriving: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in arriving:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                made = run([t or "" for t in part.column(len(carry)).to_pylist()])
                columns = [part.column(i) for i in range(len(carry))]
                columns += [pa.array(c, out.field(len(carry) + i).type) for i, c in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return df.select(*[F.col(c) for c in carry], F.col("text").alias("_text")).mapInArrow(batches, schema)
