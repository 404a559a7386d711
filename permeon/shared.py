"""The folder that all executors share, and tables in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where all runs in one process (as in tests), one of our own will do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or "/tmp/permeon-shared"


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/permeon-{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now, in their partitions and order, checkpointed: what is computed from them twice agrees."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
