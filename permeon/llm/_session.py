"""What the operators need of the session: shared scratch tables and bounded Arrow batches."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes in one Arrow batch (a longer document is a batch of its own), which bounds a worker's memory.
ARROW_BYTES = "4m"
#: Row groups of scratch tables, which bound what a reader of large binary cells holds.
ROW_GROUP = 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, and set a checkpoint folder only where the cluster names none (as in tests)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; where all runs in one process (as in tests), one of our own will do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or "/tmp/permeon-checkpoints"


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/permeon-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, buckets: tuple[str, int] | None = None) -> DataFrame:
    """Cut lineage: write to a table in the shared folder and read it back. buckets: a column and a number, which then need a name
    in the catalog."""
    spark = df.sparkSession
    prepare(spark)
    path = scratch_path(spark, what)
    writer, name = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP), None
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # once a table is written, nothing needs its shuffles
    try:
        if buckets:
            name = os.path.basename(path).replace("-", "_")
            writer.bucketBy(buckets[1], buckets[0]).option("path", path).saveAsTable(name)
        else:
            writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.table(name) if name else spark.read.schema(df.schema).parquet(path)
    table.scratch = path, name
    return table


#: So many rows of a few numbers are broadcast (some 30 MB); beyond, both sides of a join are shuffled.
FEW = 1_000_000


def few(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if its size allows it."""
    return F.broadcast(table) if table.count() <= FEW else table


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables (as written() returned them) that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        place, name = df.scratch
        if name:
            spark.sql(f"drop table if exists {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What modules remember from task to task of a worker.
MEMOS: list[dict] = []


def lean() -> None:
    """At the start of a task that needs much memory: give up what tasks of other stages have left in this worker."""
    import ctypes

    import pyarrow as pa

    for memo in MEMOS:
        memo.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema(spec: str) -> T.StructType:
    """'doc_id long, n int' as a StructType."""
    return T.StructType.fromDDL(spec)


def parts_for(bytes_total: float, each: float, least: int = 1, most: int = 1 << 20) -> int:
    return max(least, min(most, math.ceil(bytes_total / each)))
