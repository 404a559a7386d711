"""Vectors from array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def vectors(df: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>), ok."""
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.withColumn("ok", F.coalesce(usable("embedding"), F.lit(False)) & F.col("vec_id").isNotNull())


def matrix(column) -> np.ndarray:
    """Rows of equally long vectors."""
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.empty((0, 0))


def sample(df: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors, by a hash of vec_id: the same ones however the table is cut."""
    rows = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("embedding").toPandas()
    return matrix(rows["embedding"])
