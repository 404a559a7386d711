"""A mask from the images themselves: what is bright in their mean, opened, and of that the largest connected part.

The threshold is Otsu's, from a histogram of BINS counts. Erosion and dilation count face neighbours by shifted copies of the voxels.
Components: slabs of SLAB planes are labelled each in a task, and labels that meet at a border are merged by handing the smallest one on
and following where it leads, so no task holds more than a slab and the rounds grow with the logarithm of the number of slabs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settled
from .tfce import edges

BINS, SLAB = 256, 16
AXES = ["i", "j", "k"]
#: Face neighbours of a voxel, and itself.
STEPS = [(0, 0, 0), *(tuple(s if a == axis else 0 for a in range(3)) for axis in range(3) for s in (1, -1))]


def otsu(counts: np.ndarray) -> int:
    """The first bin of the upper class: the cut with the largest variance between both classes (of equal ones, the lowest)."""
    at = np.arange(len(counts))
    below, total = np.cumsum(counts)[:-1], counts.sum()
    mean_below = np.cumsum(counts * at)[:-1] / np.maximum(below, 1)
    mean_above = ((counts * at).sum() - np.cumsum(counts * at)[:-1]) / np.maximum(total - below, 1)
    between = below * (total - below) * (mean_below - mean_above) ** 2
    return int(np.argmax(between)) + 1


def bright(voxels: DataFrame) -> DataFrame:
    """(i, j, k) above the threshold of the mean image; NaN and infinities don't count."""
    usable = ~F.isnan("value") & (F.abs("value") < float("inf"))
    mean = settled(voxels.where(usable).groupBy(*AXES).agg(F.avg("value").alias("value")))
    ends = mean.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return mean.select(*AXES).limit(0)
    place = F.least(F.floor((F.col("value") - ends["lo"]) / (ends["hi"] - ends["lo"]) * BINS), F.lit(BINS - 1)).cast("int")
    binned = mean.withColumn("bin", place)
    counts = np.zeros(BINS, np.int64)
    for r in binned.groupBy("bin").count().collect():  # BINS rows at most
        counts[r["bin"]] = r["count"]
    return binned.where(F.col("bin") >= otsu(counts)).select(*AXES)


def spread(voxels: DataFrame) -> DataFrame:
    """Each voxel and its face neighbours, with the number of voxels that they are next to or equal."""
    moved = F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(AXES, step))) for step in STEPS))
    return voxels.select(F.explode(moved).alias("v")).groupBy(*(F.col(f"v.{c}").alias(c) for c in AXES)).agg(F.count("*").alias("n"))


def opened(voxels: DataFrame, times: int = 1) -> DataFrame:
    """What an erosion and a dilation leave."""
    for _ in range(times):
        voxels = spread(voxels).where(F.col("n") == len(STEPS)).select(*AXES)
    for _ in range(times):
        voxels = spread(voxels).select(*AXES)
    return voxels


def _slab(f: pd.DataFrame) -> pd.DataFrame:
    """Voxels of a slab with their component there, named by its slab and number."""
    pairs, label = edges(f[AXES].to_numpy()), np.arange(len(f))
    while True:
        before = label.copy()
        np.minimum.at(label, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(label, pairs[:, 1], label[pairs[:, 0]])
        label = label[label]
        if np.array_equal(before, label):
            return f.assign(label=f["slab"].to_numpy(np.int64) << 40 | label)


def labelled(voxels: DataFrame) -> DataFrame:
    """(i, j, k, component): the same number for voxels that face neighbours lead to."""
    parts = voxels.select(*AXES, F.floor(F.col("k") / SLAB).alias("slab")).groupBy("slab").applyInPandas(_slab, "i int, j int, k int, slab long, label long")
    parts = settled(parts)
    top = parts.where(F.pmod("k", F.lit(SLAB)) == SLAB - 1).select("i", "j", (F.col("k") + 1).alias("k"), F.col("label").alias("a"))
    meet = top.join(parts.select(*AXES, F.col("label").alias("b")), AXES).select("a", "b").distinct()
    meet = settled(meet.union(meet.select("b", "a")))
    root = settled(parts.select(F.col("label").alias("a"), F.col("label").alias("root")).distinct())
    while True:
        # the smallest root among a label's neighbours, and where that root has got to
        seen = meet.join(root.withColumnsRenamed({"a": "b", "root": "other"}), "b").groupBy("a").agg(F.min("other").alias("other"))
        new = root.join(seen, "a", "left").select("a", F.least("root", F.coalesce("other", "root")).alias("root"))
        onto = new.groupBy(F.col("a").alias("root")).agg(F.min("root").alias("next"))
        new = settled(new.join(onto, "root", "left").select("a", F.least("root", F.coalesce("next", "root")).alias("root")))
        moved = new.join(root.withColumnRenamed("root", "before"), "a").where("root < before").limit(1).count()
        root = new
        if not moved:
            return parts.join(root.withColumnsRenamed({"a": "label", "root": "component"}), "label").select(*AXES, "component")


def largest(voxels: DataFrame) -> DataFrame:
    """The voxels of the largest component; of equal ones, that of the smallest number."""
    parts = labelled(voxels)
    best = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return parts.join(F.broadcast(best.select("component")), "component").select(*AXES)


def automatic(voxels: DataFrame, opening: int = 1) -> DataFrame:
    """(i, j, k) of a mask for images (.., i, j, k, value)."""
    return largest(opened(bright(voxels), opening))
