"""Session defaults: adaptive plans, UTC, Arrow; a cluster's own settings win."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Folder that holds this package.
HOME = str(Path(__file__).resolve().parents[1])

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with DEFAULTS, overridden by ``conf`` (dots written as double underscores)."""
    builder = SparkSession.builder.master(master).appName("graphloom")
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return importable(builder.getOrCreate())


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, whatever folder they start in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in paths and HOME not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([*paths, HOME])
    return spark
