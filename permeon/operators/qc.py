"""Checks of inputs before an analysis, as small aggregate queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import pearson


def describe(df: DataFrame) -> DataFrame:
    """column, n, n_null, n_nan, n_distinct, in one pass."""
    each = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nan = F.count_if(F.isnan(c)) if f.dataType.typeName() in ("double", "float") else F.lit(0)
        each.append(F.struct(F.lit(f.name).alias("column"), F.count("*").alias("n"), F.count_if(c.isNull()).alias("n_null"), nan.cast("long").alias("n_nan"), F.count_distinct(c).alias("n_distinct")))
    return df.agg(F.array(*each).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def design_summary(design: DataFrame, columns: list[str], categorical: int = 10, outlier: float = 3.0) -> DataFrame:
    """column, n, n_distinct, is_categorical, mean, sd, n_outliers (beyond `outlier` standard deviations)."""
    long = design.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")).select("s.*")
    stats = long.groupBy("column").agg(F.count("v").alias("n"), F.count_distinct("v").alias("n_distinct"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    out = long.join(F.broadcast(stats.select("column", "mean", "sd")), "column").groupBy("column").agg(F.count_if(F.abs(F.col("v") - F.col("mean")) > outlier * F.col("sd")).alias("n_outliers"))
    return stats.join(out, "column").select("column", "n", "n_distinct", (F.col("n_distinct") <= categorical).alias("is_categorical"), "mean", "sd", "n_outliers")


def collinearity(design: DataFrame, columns: list[str], above: float = 0.8) -> DataFrame:
    """a, b, r, flagged, for pairs of design columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a, b in pairs]
    rows = design.agg(F.array(*cells).alias("rows")).select(F.explode("rows").alias("s")).select("s.*")
    return rows.withColumn("flagged", F.abs("r") > above)


def block_collinearity(design: DataFrame, block: str, columns: list[str], above: float = 0.99) -> DataFrame:
    """column, r2 (share of its variance between blocks), flagged: blocks that determine a regressor leave nothing to permute."""
    long = design.select(F.col(block).alias("block"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")).select("block", "s.*")
    by = long.groupBy("column", "block").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    return by.groupBy("column").agg(F.coalesce(between / F.nullif(q - s * s / n, F.lit(0.0)), F.lit(0.0)).alias("r2")).withColumn("flagged", F.col("r2") > above)


def overlap(items: DataFrame) -> DataFrame:
    """a, b, n_shared: items that two datasets share. items: ds, item."""
    d = items.select("ds", "item").distinct()
    return d.select(F.col("ds").alias("a"), "item").join(d.select(F.col("ds").alias("b"), "item"), "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def contrast_summary(contrast: np.ndarray, names: list[str]) -> pd.DataFrame:
    """A line for each contrast row: which regressors it weighs, and whether it compares (sums to 0)."""
    rows = [(f"c{i + 1}", " ".join(f"{w:+g}*{n}" for w, n in zip(row, names) if w), bool(abs(row.sum()) < 1e-12)) for i, row in enumerate(np.atleast_2d(contrast))]
    return pd.DataFrame(rows, columns=["contrast", "terms", "compares"])
