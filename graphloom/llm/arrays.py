"""Array expressions for word windows, kept inside Spark's expression engine.

Hashes are sorted together with their positions by packing both into one long,
because Spark sorts arrays of longs as primitives and arrays of structs by an
interpreted comparator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A packed long holds 32 bits of a hash above 31 bits of a position, which number every element an array can have.
AT_BITS = 31
HASH_BITS = 63 - AT_BITS
AT_MASK = (1 << AT_BITS) - 1
HASH_MASK = ((1 << HASH_BITS) - 1) << AT_BITS


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def windows(hashes: str, k: int) -> Column:
    """64-bit hashes of the ``k`` consecutive entries at each position of column ``hashes`` (none if shorter)."""
    col = F.col(hashes)
    first = F.slice(col, F.lit(1), F.greatest(F.size(col) - (k - 1), F.lit(0)))
    return F.transform(first, lambda x, i: F.xxhash64(x, *[col[i + j] for j in range(1, k)]))


def packed(hashes: Column, shift: int = 0) -> Column:
    """Sorted longs: hash bits (those from ``shift`` down) above the position."""

    def pack(x: Column, i: Column) -> Column:
        high = F.shiftleft(x, shift) if shift else x
        return high.bitwiseAND(F.lit(HASH_MASK)).bitwiseOR(i.cast("long"))

    return F.sort_array(F.transform(hashes, pack))


def high(x: Column) -> Column:
    return F.shiftright(x, AT_BITS)


def low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(AT_MASK))
