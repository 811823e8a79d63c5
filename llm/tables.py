"""Reading tables and cutting lineage, shared by the operators of this package."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from canvass.session import ensure_checkpoint_dir

__all__ = ["cut", "ensure_checkpoint_dir", "release", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder; it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects its garbage, which may be half an hour later; until then the shuffles of steps
    whose results are cut stay on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
