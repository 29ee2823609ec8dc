"""Tables in the folder that all executors share: cut lineage, read back, drop.

``materialise`` writes a Parquet table below the folder that
``spark.checkpoint.dir`` names, so a lost executor re-reads instead of
recomputing, and a plan that needs a table twice sees the same rows twice.
What is written is remembered: ``scratch`` drops what a block wrote and did not
keep, ``sweep`` all that is left, and so does the end of the process.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: Paths that this process gave out and has not dropped, in order.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one is set only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "graphloom-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that ``materialise`` wrote and that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _written:
        _written.remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (schema given, so no inference pass)."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.graphloom_path = path
    return out


def release(*tables: DataFrame) -> None:
    for df in tables:
        drop_path(df.sparkSession, df.graphloom_path)


class Scratch:
    """The tables of one block that outlive it."""

    def __init__(self) -> None:
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df.graphloom_path)
        return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Drop all tables that the block writes, but those it keeps: whatever is read after it must be kept."""
    before, scope = set(_written), Scratch()
    try:
        yield scope
    finally:
        for path in [p for p in _written if p not in before and p not in scope.kept]:
            drop_path(spark, path)


def sweep(spark: SparkSession) -> None:
    """Drop every table that this process has written; results that are still lazy can no longer be read."""
    for path in list(_written):
        drop_path(spark, path)


@atexit.register
def _at_exit() -> None:
    with suppress(Exception):  # the JVM may have gone before
        spark = SparkSession.getActiveSession() if _written else None
        if spark is not None:
            sweep(spark)
