"""Run artifacts: checkpoint metadata, selection and retention, configurations, ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.config import RECORDED
from graphloom.sources.tables import require

#: Metadata layouts a checkpoint table may have.
LAYOUTS = {"full": {"model_state", "optimizer_state"}, "weights": {"weights"}}
#: Names tried in this order before the newest periodic checkpoint (fixed values).
PRIORITY = ("best_model.pt", "best_model_ema.pt", "final_model.pt")
PERIODIC = "checkpoint_epoch_"


def layout(df: DataFrame) -> str:
    """'full' or 'weights'; anything else is an error."""
    return require(df, LAYOUTS)


def resume(df: DataFrame) -> DataFrame:
    """epoch, step and best loss of a checkpoint, with the defaults 0, 0 and +infinity."""
    def value(name: str, kind: str, default: float) -> Column:
        found = F.col(name) if name in df.columns else F.lit(None)
        return F.coalesce(found.cast(kind), F.lit(default).cast(kind)).alias(name)

    return df.select(value("epoch", "int", 0), value("global_step", "long", 0), value("best_val_loss", "double", float("inf")))


def select_checkpoint(files: DataFrame) -> DataFrame:
    """The file to load of (name, mtime): first of PRIORITY, else the newest periodic one; no row if there is neither."""
    rank = F.coalesce(*[F.when(F.col("name") == n, F.lit(i)) for i, n in enumerate(PRIORITY)], F.when(F.col("name").startswith(PERIODIC), F.lit(len(PRIORITY))))
    return files.withColumn("priority", rank).filter("priority IS NOT NULL").orderBy("priority", F.desc("mtime"), "name").limit(1)


def expired(files: DataFrame, keep: int) -> DataFrame:
    """Files to delete: all but the newest ``keep`` of each prefix.  ``keep`` = 0 deletes nothing, as in a slice up to minus zero."""
    newest = Window.partitionBy("prefix").orderBy(F.desc("mtime"), F.desc("name"))
    return files.withColumn("age", F.row_number().over(newest)).filter((F.col("age") > keep) & F.lit(keep > 0))


def run_config(spark: SparkSession, values: dict[str, str], keys: tuple[str, ...] = RECORDED) -> DataFrame:
    """One row: the whitelisted part of ``values`` and all of it as JSON."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])
    kept = F.map_filter(pairs, lambda k, _: k.isin(*keys))
    return spark.range(1).select(kept.alias("config"), F.to_json(pairs).alias("args"))


def write_json(df: DataFrame, path: str, k: int, order: list[Column]) -> None:
    """The first ``k`` rows by ``order`` as JSON lines, committed whole or not at all."""
    if k < 0:
        raise ValueError("k must not be negative")
    df.orderBy(*order).limit(k).write.mode("overwrite").json(path)
