"""Parquet tables of a data folder, and signals that come from many tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, layouts: dict[str, set[str]]) -> str:
    """Name of the first layout whose columns ``df`` has all; an error names what is missing."""
    for name, columns in layouts.items():
        if columns <= set(df.columns):
            return name
    raise ValueError(f"columns {sorted(df.columns)} fit none of {({k: sorted(v) for k, v in layouts.items()})}")


def union_signals(parts: list[DataFrame]) -> DataFrame:
    """All sources under one schema; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
