"""Cutting lineage in iterative plans, and reading tables by name."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, which ``spark.checkpoint.dir`` names.

    Where it is unset, a local master gets a folder of its machine; on a cluster that is an error, as executors share no such folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "sparkloom-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made, so a lost executor costs one read.

    The shuffle files it was made of go at once, as nothing reads them again; else they would stay until the driver happens to collect
    its garbage. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes what no plan refers to any more.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan takes the setting
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def forget(spark: SparkSession) -> None:
    """Has the checkpoints removed whose plans are gone, where the next steps need the room."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
