"""Threshold-free cluster enhancement on lattices.

score(v) = dh * sum over h = dh, 2 dh, .. <= max of extent_h(v)**E * h**H, where extent_h(v) is the size of v's connected component
of {x >= h}. Two-sided: the same on the negated map with a negative sign; dh = max / STEPS, of absolute values if two-sided.

One-dimensional lattices are gaps and islands in windows. Others go through a tree of components, made once a map: voxels join as the
level falls, so a component's parent is the one that it becomes part of. A voxel's score is the sum of its component's up to the level of
its parent, plus the parent's; so it is handed down the tree, level by level, instead of being added up threshold by threshold. What is
distributed are maps, i.e. permutations: they travel packed, block of features by block, and a task gets MAPS of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .infer import tied, with_double

E, H, STEPS = 0.5, 2.0, 100
#: Permuted maps of a task.
MAPS = 4


def auto_dh(values: np.ndarray, two_tailed: bool = True) -> float:
    """The step; 0 where there is nothing to enhance."""
    v = np.abs(values) if two_tailed else np.asarray(values)
    v = v[~np.isnan(v)]
    top = v.max() if v.size else 0.0
    return float(top / STEPS) if np.isfinite(top) and top > 0 else 0.0


def edges(lattice: np.ndarray) -> np.ndarray:
    """For voxels (rows of integer coordinates) the pairs of face neighbours, by their numbers."""
    lattice = np.asarray(lattice, np.int64)
    if not len(lattice):
        return np.empty((0, 2), np.int64)
    at = lattice - lattice.min(0)
    shape = at.max(0) + 2  # a free layer behind each axis, so that steps don't wrap
    place = np.ravel_multi_index(tuple(at.T), tuple(shape))
    order = np.argsort(place)
    known, out = place[order], []
    for axis in range(lattice.shape[1]):
        wanted = place + int(np.prod(shape[axis + 1 :]))
        found = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        hit = known[found] == wanted
        out.append(np.stack((np.flatnonzero(hit), order[found[hit]]), 1))
    return np.concatenate(out)


def tree(level: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component tree of voxels with a level above 0: each voxel's parent (itself at a root, -1 for others), and how many voxels are
    in the subtree of each."""
    order = np.argsort(-level, kind="stable")
    order = order[level[order] > 0]
    rank = np.full(len(level), len(level))
    rank[order] = np.arange(len(order))
    a, b = pairs[:, 0], pairs[:, 1]
    both = (level[a] > 0) & (level[b] > 0)
    a, b = a[both], b[both]
    later, earlier = np.where(rank[a] > rank[b], (a, b), (b, a))
    by = np.argsort(rank[later], kind="stable")
    parent, top, size = list(range(len(level))), list(range(len(level))), [1] * len(level)
    for v, r in zip(later[by].tolist(), earlier[by].tolist()):
        while top[r] != r:  # the lowest voxel so far of what r is part of
            top[r] = top[top[r]]
            r = top[r]
        if r != v:
            parent[r] = top[r] = v
            size[v] += size[r]
    parent = np.array(parent)
    parent[level <= 0] = -1
    return parent, np.array(size)


def one_sided(x: np.ndarray, pairs: np.ndarray, dh: float) -> np.ndarray:
    """Scores of positive values."""
    level = np.floor(np.maximum(x, 0) / dh + 1e-9).astype(np.int64)
    parent, size = tree(level, pairs)
    on = np.flatnonzero(level > 0)
    if not len(on):
        return np.zeros(len(x))
    # a component is named by its last voxel: the highest of a voxel's ancestors on the same level
    name = np.where(level == level[parent], parent, np.arange(len(x)))
    while not np.array_equal(name, again := name[name]):
        name = again
    heights = np.concatenate(([0.0], np.cumsum((np.arange(1, level.max() + 1) * dh) ** H)))
    out = np.zeros(len(x))
    heads = on[name[on] == on]
    for heads_of in np.split(heads[np.argsort(level[heads], kind="stable")], np.flatnonzero(np.diff(np.sort(level[heads]))) + 1):
        up = name[parent[heads_of]]
        root = parent[heads_of] == heads_of
        below = np.where(root, 0, level[up])
        out[heads_of] = size[heads_of] ** E * (heights[level[heads_of]] - heights[below]) + np.where(root, 0.0, out[up])
    out[on] = out[name[on]]
    return out * dh


def enhance(x: np.ndarray, pairs: np.ndarray, two_tailed: bool = True) -> np.ndarray:
    """The enhanced map; NaN counts as 0. pairs: the lattice's edges."""
    x = np.where(np.isnan(x), 0.0, x)
    dh = auto_dh(x, two_tailed)
    if dh == 0:
        return np.zeros(len(x))
    return one_sided(x, pairs, dh) - (one_sided(-x, pairs, dh) if two_tailed else 0)


def shared_lattice(lattice: DataFrame):
    """A broadcast of voxels' numbers and edges: of the size of a few maps, of which a task holds MAPS anyway."""
    shape = lattice.orderBy("feature_id").toPandas()
    ids = shape["feature_id"].to_numpy()
    return lattice.sparkSession.sparkContext.broadcast((ids, edges(shape.drop(columns="feature_id").to_numpy())))


def enhance_maps(maps: DataFrame, lattice: DataFrame, two_tailed: bool = True, by: tuple[str, ...] = ("contrast", "perm_id")) -> DataFrame:
    """maps (*by, feature_id, stat) with the enhanced value. lattice: feature_id and integer coordinates of a mask's voxels."""
    held = shared_lattice(lattice)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, pairs = held.value
        x = np.zeros(len(ids))
        place = np.searchsorted(ids, f["feature_id"])
        x[place] = f["stat"].to_numpy()
        return f.assign(tfce=enhance(x, pairs, two_tailed)[place])

    return maps.groupBy(*by).applyInPandas(run, with_double(maps.schema, "tfce"))


def enhance_1d(maps: DataFrame, by: tuple[str, ...] = ("map_id",), two_tailed: bool = True) -> DataFrame:
    """maps (*by, feature_id, stat) on the line of feature ids, in windows only."""
    level = F.abs("stat") if two_tailed else F.col("stat")
    top = maps.groupBy(*by).agg((F.max(F.when(~F.isnan("stat"), level)) / STEPS).alias("dh"))
    sides = F.array(F.struct(F.lit(1).alias("s"), F.col("stat").alias("x")), F.struct(F.lit(-1).alias("s"), (-F.col("stat")).alias("x")))
    rows = maps.join(top, list(by)).where("dh > 0").withColumn("side", F.explode(sides if two_tailed else F.slice(sides, 1, 1)))
    rows = rows.select(*by, "feature_id", "dh", F.col("side.s").alias("s"), F.col("side.x").alias("x")).where("x > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("x") / F.col("dh") + 1e-9).cast("int")))).where("k > 0")
    level = Window.partitionBy(*by, "s", "k")
    rows = rows.withColumn("island", F.col("feature_id") - F.row_number().over(level.orderBy("feature_id")))
    rows = rows.withColumn("extent", F.count("*").over(Window.partitionBy(*by, "s", "k", "island")))
    h = F.col("k") * F.col("dh")
    score = rows.groupBy(*by, "feature_id").agg(F.sum(F.col("s") * F.pow("extent", F.lit(E)) * F.pow(h, F.lit(H)) * F.col("dh")).alias("tfce"))
    return maps.join(score, [*by, "feature_id"], "left").withColumn("tfce", F.coalesce("tfce", F.lit(0.0)))


def tfce_analysis(features: DataFrame, spec, lattice: DataFrame):
    """A Result of enhanced maps: contrast, feature_id, stat (enhanced), exceed and the p-values that the spec asks for, across contrasts
    and with fitted tails too. F-like labels are enhanced on one side."""
    from ..plans import analysis

    tasks = analysis.contrasts(spec)
    count, tails = len(tasks[0].orders), {t.label: t.two_tailed for t in tasks}
    held = shared_lattice(lattice)
    blocks = analysis.permuted_blocks(features, spec, rest=True)
    # the observed map goes to every group of permuted ones
    groups = -(-count // MAPS)
    part = F.when(F.col("perm_id") < 0, F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(F.array(F.floor(F.col("perm_id") / MAPS).cast("int")))
    blocks = blocks.withColumn("part", F.explode(part))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        label, number = key
        ids, pairs = held.value
        fold = np.abs if tails[label] else (lambda x: x)
        maps = {}
        for p, of, stats in zip(f["perm_id"], f["feature_ids"], f["stats"]):
            maps.setdefault(int(p), np.zeros(len(ids)))[np.searchsorted(ids, of)] = stats
        done = {p: enhance(x, pairs, tails[label]) for p, x in maps.items()}
        seen = done.pop(-1)
        level = tied(fold(seen), np.abs(seen).max(initial=0.0))
        exceed = sum(((fold(x) >= level).astype(np.int64) for x in done.values()), np.zeros(len(ids), np.int64))
        perms = sorted(done)
        return pd.DataFrame({
            "kind": ["feature"] * len(ids) + ["max"] * len(perms), "contrast": label, "id": np.concatenate((ids, perms)),
            "stat": np.concatenate((seen, [fold(done[p]).max(initial=0.0) for p in perms])), "exceed": np.concatenate((exceed, np.zeros(len(perms), np.int64))),
        })

    partials = blocks.groupBy("contrast", "part").applyInPandas(run, analysis.PARTIALS).persist()
    counts = partials.where("kind = 'feature'").groupBy("contrast", F.col("id").alias("feature_id")).agg(F.first("stat").alias("stat"), F.sum("exceed").alias("exceed"))
    maxima = analysis.maxima_of(partials)
    tags = {k: f"tfce_{tag}" for k, tag in analysis.tags_of(tasks, spec).items()}
    return analysis.Result(analysis.corrected(counts, maxima, tails, spec, count), maxima, tags, tfce=True, kept=partials)
