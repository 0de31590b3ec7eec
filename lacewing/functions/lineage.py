"""Cutting the lineage of intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints, shared by driver and executors.

    It is the session's spark.checkpoint.dir; where that is unset, a temporary folder is taken if all runs on this machine, and else there is none.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return folder or sc.getCheckpointDir()


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffles, broadcasts and checkpoints of tables that nothing refers to any more.

    It does so only when the driver's garbage is collected, which between two steps of an operator may be long after; their files stay on disk, and what Spark
    keeps of them in the driver's memory, until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Write a (narrow) intermediate table to the shared folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same for larger intermediate tables: as compressed Parquet below the shared folder.

    Each is in a folder of its own, named after the application, and may go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
