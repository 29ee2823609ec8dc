"""Scalar expressions on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_SECONDS = 31_536_000.0


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts).cast("double")


def approx_year(ts_sec: Column) -> Column:
    """Year by 365-day years, 2000 for the sentinel 0, within [1700, 2100].  Late December drifts into the next year."""
    year = F.when(ts_sec != 0, (ts_sec / YEAR_SECONDS + 1970).cast("int")).otherwise(F.lit(2000))
    return F.greatest(F.least(year, F.lit(2100)), F.lit(1700))


def label(text: Column, node_id: Column, length: int = 50) -> Column:
    return F.coalesce(F.substring(text, 1, length), node_id)


def bar(value: Column, width: int = 20) -> Column:
    """Text bar of ``width`` marks for 1; zero or less is empty."""
    return F.repeat(F.lit("#"), F.greatest((value * width).cast("int"), F.lit(0)))


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)


def decimals(value: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", value.cast("double"))


def scientific(value: Column, n: int = 3) -> Column:
    return F.format_string(f"%.{n}e", value.cast("double"))


def padded(value: Column, width: int) -> Column:
    return F.format_string(f"%0{width}d", value.cast("long"))


def thousands(value: Column) -> Column:
    return F.format_string("%,d", value.cast("long"))


def joined(values: Column, n: int, separator: str = ", ") -> Column:
    """Numbers with ``n`` decimals, joined."""
    return F.array_join(F.transform(values, lambda x: decimals(x, n)), separator)


def iso(ts: Column) -> Column:
    """Date and time to the second; the time is a parameter, so results can be repeated."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def zip_shorter(names: Column, values: Column) -> Column:
    """Pairs by position up to the shorter array."""
    n = F.least(F.size(names), F.size(values))
    return F.arrays_zip(F.slice(names, F.lit(1), n).alias("name"), F.slice(values, F.lit(1), n).alias("value"))


def l2_normalised(vector: Column, epsilon: float = 1e-8) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + epsilon
    return F.transform(vector, lambda x: x.cast("double") / norm)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def md5_seed(text: Column) -> Column:
    """md5 as a big integer modulo 2^32: its last eight hex digits."""
    return F.conv(F.right(F.md5(text.cast("binary")), F.lit(8)), 16, 10).cast("long")


def learning_rate(epoch: Column, base: float, warmup: int, total: int, floor: float = 1e-7) -> Column:
    """Linear warm-up from base/1000 over max(1, warmup) epochs, then a cosine to ``floor`` over max(1, total - warmup)."""
    w, rest = max(1, warmup), max(1, total - warmup)
    rising = base * (0.001 + 0.999 * epoch / w)
    falling = floor + (base - floor) * (1 + F.cos(F.lit(math.pi) * (epoch - warmup) / rest)) / 2
    return F.when(epoch < warmup, rising).otherwise(falling)


def prefixed(metrics: Column, prefix: str) -> Column:
    return F.transform_keys(metrics, lambda k, _: F.concat(F.lit(prefix), k))
