"""Cutting of lineage in loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: spark.checkpoint.dir. Where the session
    names none, a single machine takes a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut, kept in the shared folder. spark.cleaner.referenceTracking.cleanCheckpoints
    lets Spark remove it once nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
