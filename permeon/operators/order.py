"""Places in a global order, without one task that sees all rows: ranges, counts of them, and offsets."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import settled


def offset(rows: DataFrame, part: str, at: str, name: str) -> DataFrame:
    """rows with `name`: the number of rows in earlier parts, and of rows before it in its own. Within a part `at` goes up by one from row to
    row. A part is a partition or a piece of a file: the driver sees two numbers of each."""
    held = rows.groupBy(part).agg(F.min(at).alias("first"), F.count("*").alias("n")).orderBy(part).collect()
    before = accumulate((r["n"] for r in held), initial=0)
    shape = T.StructType([T.StructField(part, rows.schema[part].dataType), T.StructField("_before", T.LongType())])
    starts = rows.sparkSession.createDataFrame([(r[part], b - r["first"]) for r, b in zip(held, before)], shape)
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(at) + F.col("_before")).drop(part, at, "_before")


def numbered(rows: DataFrame, *by, name: str = "place", partitions: int | None = None) -> DataFrame:
    """rows with their place, from 0, in the order of `by`, which is to be total. The sorted rows are settled first, so that both looks
    at them see the same ranges."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = settled(rows.repartitionByRange(n, *by).sortWithinPartitions(*by))
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id())
    return offset(ordered.withColumn("_part", F.shiftright("_at", 33)), "_part", "_at", name)
