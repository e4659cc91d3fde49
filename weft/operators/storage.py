"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Used in local mode if no folder is named (tests on one machine).
LOCAL = "/tmp/checkpoints/weft"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. On a cluster it must be named: no other is known to be shared."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or LOCAL


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor takes nothing along."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
