"""Spatially autocorrelated null maps on a lattice, and the correlation of two maps against them. Experimental.

A null map is noise in a mask, blurred narrowly at the mask's centre and widely at its edge, and standardised. BLOCK maps share a row of
voxels as an array. A blur goes axis by axis: a task gets SIDE x SIDE lines of a segment of the axis, with a halo of the kernel's reach from
the segments next to it, so no task holds a map however large the lattice is. Beyond its ends the lattice is mirrored (d c b a | a b c d),
as often as the kernel reaches; mirror images are made in the tasks and don't travel. Noise is a function of a key, the map and the feature, so a lost task makes the same again.

Two maps are correlated against nulls whose weights are fitted to each and shuffled. All that takes is the cross products of the null maps
and both maps, which blocks of features add up in one pass; each shuffle is then arithmetic on (maps x maps) numbers, made in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..exchange import Orders
from . import infer, similarity

AXES = ["i", "j", "k"]
#: The blurs at the centre and at the edge, in voxels; kernels end at TRUNCATE standard deviations.
CENTRE, EDGE, TRUNCATE = 3.0, 7.0, 4.0
#: Places of a segment, and lines a side of what a task gets; maps in an array; sums in a row of cross products.
SEGMENT, SIDE, BLOCK, SLICE = 128, 16, 16, 64
#: Null maps a side in a correlation: their cross products go through the driver, 34 MB at most.
MOST_MAPS = 1024


def kernel(sigma: float, reach: int | None = None) -> np.ndarray:
    """Gaussian weights that sum to 1, with zeros up to `reach` on both sides."""
    own = max(1, int(TRUNCATE * sigma + 0.5))
    w = np.exp(-0.5 * (np.arange(-own, own + 1) / sigma) ** 2)
    return np.pad(w / w.sum(), max(0, (own if reach is None else reach) - own))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """An array column as rows of `width` numbers."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if column.num_chunks else np.zeros(0)
    if len(flat) != len(column) * width:
        raise ValueError("a feature is missing from a map, or there twice")
    return flat.reshape(len(column), width)


def _along(rows: DataFrame, axis: str, n: int, sigmas: tuple[float, ...], by: list[str], split: bool) -> DataFrame:
    """One axis of the blur. split: `values` already hold an array for each sigma, one after the other."""
    reach = max(len(kernel(s)) for s in sigmas) // 2
    weights = [kernel(s, reach) for s in sigmas]
    long = max(SEGMENT, 2 * reach)
    across = [a for a in AXES if a != axis]
    # a row goes once to each segment that it reaches; its mirror images reach no others, and are made there
    at = F.col(axis)
    first, last = F.greatest(F.floor((at - reach) / long), F.lit(0)), F.least(F.floor((at + reach) / long), F.lit((n - 1) // long))
    rows = rows.select(*by, *AXES, "values", (F.explode(F.sequence(first, last)) if n > long else F.lit(0).cast("long")).alias("segment"))
    rows = rows.withColumns({f"tile_{a}": F.floor(F.col(a) / SIDE) for a in across})

    def run(t: pa.Table) -> pa.Table:
        segment, at = t["segment"][0].as_py(), t[axis].to_numpy()
        width = len(t["values"][0])
        sides = np.stack([t[a].to_numpy() for a in across], 1)
        lines, line = np.unique(sides, axis=0, return_inverse=True)
        targets = min(long, n - segment * long)
        seen = (np.arange(targets + 2 * reach) + segment * long - reach) % (2 * n)
        places, of = np.unique(np.where(seen < n, seen, 2 * n - 1 - seen), return_inverse=True)  # of the lattice, seen by the kernel
        dense = np.zeros((len(lines), len(places), width))
        dense[line.ravel(), np.searchsorted(places, at)] = matrix(t["values"], width)
        steps = np.arange(targets)[:, None], of.ravel()[np.arange(targets)[:, None] + np.arange(2 * reach + 1)]
        out = []
        for s, w in enumerate(weights):
            spread = np.zeros((targets, len(places)))
            np.add.at(spread, steps, w)
            own = slice(s * width // len(weights), (s + 1) * width // len(weights)) if split else slice(None)
            out.append(spread @ dense[:, :, own])
        out = np.concatenate(out, 2).reshape(len(lines) * targets, -1)
        offsets = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        columns = {c: pa.array([t[c][0].as_py()] * len(out), pa.int64()) for c in by}
        columns |= {a: pa.array(np.repeat(lines[:, i], targets), pa.int64()) for i, a in enumerate(across)}
        columns[axis] = pa.array(np.tile(np.arange(targets) + segment * long, len(lines)), pa.int64())
        columns["values"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))
        return pa.table({c: columns[c] for c in (*by, *AXES, "values")})

    shape = ", ".join([*(f"{c} long" for c in (*by, *AXES)), "values array<double>"])
    return rows.groupBy(*by, "segment", *(f"tile_{a}" for a in across)).applyInArrow(run, shape)


def smoothed(rows: DataFrame, shape: tuple[int, int, int], sigmas: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """rows (*by, i, j, k, values: arrays) blurred by each sigma; the arrays of the results stand one after the other. Voxels that
    rows don't have count as 0; those that no line of a blur has are 0 and not returned."""
    rows = rows.select(*(F.col(c).cast("long").alias(c) for c in (*by, *AXES)), "values")
    for step, (axis, n) in enumerate(zip(AXES, shape)):
        rows = _along(rows, axis, n, sigmas, list(by), step > 0)
    return rows


def noise(key: Column) -> Column:
    """A standard normal number from a key, by its md5 and the Box-Muller formula."""
    digest = F.md5(key)
    part = lambda lo: (F.conv(F.substring(digest, lo, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    return F.sqrt(F.lit(-2.0) * F.log(part(1))) * F.cos(part(9) * (2 * math.pi))


def null_blocks(mask: DataFrame, shape: tuple[int, int, int], count: int, seed: int = 0, centre: float = CENTRE, edge: float = EDGE) -> DataFrame:
    """(block, feature_id, values): maps BLOCK * block and on, standardised in the mask. mask: feature_id, i, j, k inside the shape. A map that is
    constant is 0. An empty mask gives no rows."""
    mask = mask.select("feature_id", *(F.col(a).cast("long").alias(a) for a in AXES))
    middle = mask.agg(*(F.avg(a).alias(a) for a in AXES)).first()
    away = F.sqrt(sum((F.pow(F.col(a) - F.lit(middle[a]), 2) for a in AXES), F.lit(0.0)))
    ends = mask.agg(F.min(away).alias("least"), F.max(away).alias("most")).first()
    wide = (ends["most"] or 0.0) - (ends["least"] or 0.0)
    share = (away - F.lit(ends["least"])) / F.lit(wide) if wide > 0 else F.lit(0.0)

    blocks = mask.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((count - 1) // BLOCK).cast("long"))))
    own = F.sequence(F.col("block") * BLOCK, F.least(F.col("block") * BLOCK + BLOCK, F.lit(count)) - 1)
    rows = blocks.select("block", *AXES, F.transform(own, lambda m: noise(F.concat_ws(":", F.lit(seed), m, "feature_id"))).alias("values"))
    half = (F.size("values") / 2).cast("int")
    mixed = F.zip_with(F.slice("values", F.lit(1), half), F.slice("values", half + 1, half), lambda a, b: (1 - F.col("share")) * a + F.col("share") * b)
    # mixed before the join, so that half as much meets the mask
    blurred = smoothed(rows, shape, (centre, edge), ("block",)).withColumn("share", share).select("block", *AXES, mixed.alias("values"))
    maps = blurred.join(mask, AXES).select("block", "feature_id", "values")

    each = lambda f: F.array(*(f(F.get("values", F.lit(m))) for m in range(BLOCK)))
    moments = maps.groupBy("block").agg(each(F.avg).alias("mean"), each(F.stddev_pop).alias("sd"))  # a row a block
    scaled = F.transform("values", lambda v, m: F.coalesce((v - F.get("mean", m)) / F.nullif(F.get("sd", m), F.lit(0.0)), F.lit(0.0)))
    return maps.join(F.broadcast(moments), "block").select("block", "feature_id", scaled.alias("values"))


def null_maps(mask: DataFrame, shape: tuple[int, int, int], count: int, seed: int = 0, centre: float = CENTRE, edge: float = EDGE) -> DataFrame:
    """(map_id, feature_id, value); joined with the mask's places it is what the image sinks write, 0 outside the mask."""
    blocks = null_blocks(mask, shape, count, seed, centre, edge)
    long = blocks.select("block", "feature_id", F.posexplode("values").alias("m", "value"))
    return long.select((F.col("block") * BLOCK + F.col("m")).alias("map_id"), "feature_id", "value")


def cross_products(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of z z' over rows (z: array of `width` numbers): a task adds up its own, and columns of a row of them meet in sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            z = matrix(pa.chunked_array([b.column(0)]), width)
            total += z.T @ z
        padded = np.pad(total, ((0, 0), (0, -width % SLICE)))
        for i in range(width if total.any() else 0):
            parts = range(i // SLICE, padded.shape[1] // SLICE)  # it is symmetric
            values = pa.array([padded[i, p * SLICE : (p + 1) * SLICE].tolist() for p in parts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.int32()), pa.array(parts, pa.int32()), values], names=["i", "part", "values"])

    sums = rows.select("z").mapInArrow(run, "i int, part int, values array<double>")
    sums = sums.groupBy("i", "part").agg(F.array(*(F.sum(F.get("values", F.lit(k))) for k in range(SLICE))).alias("values"))
    out = np.zeros((width, width + -width % SLICE))
    for r in sums.collect():  # width squared numbers, whatever the number of features
        out[r["i"], r["part"] * SLICE : (r["part"] + 1) * SLICE] = r["values"]
    out = np.triu(out[:, :width])
    return out + np.triu(out, 1).T


def fitted_weights(gram: np.ndarray, meets: np.ndarray, alpha: float = 0.01) -> np.ndarray:
    """Weights that sum to 1, drawn to uniform by alpha, for which null maps come closest to a target. gram: products of the null maps with
    each other; meets: with the target."""
    k = len(gram)
    system = np.ones((k + 1, k + 1))
    system[:k, :k] = gram + alpha * np.eye(k)
    system[k, k] = 0
    return np.linalg.solve(system, np.append(meets + alpha / k, 1.0))[:k]


def correlate(maps: DataFrame, mask: DataFrame, shape: tuple[int, int, int], permutations: int, nulls: int = 1000, seed: int = 0, two_tailed: bool = True, compare: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """((r, p), (perm_id, r)): the similarity of two maps, and that of null maps under shuffled weights. maps: feature_id, x, y; features outside
    the mask take no part, one that a map lacks is an error. compare: f(vector, vector) instead of Pearson's r; it gets whole maps, a
    permutation at a time."""
    if not 1 <= nulls <= MOST_MAPS:
        raise ValueError(f"from 1 to {MOST_MAPS} null maps a side")
    spark = maps.sparkSession
    own = maps.join(mask.select("feature_id"), "feature_id", "left_semi").select("feature_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    # maps 0.. belong to x, maps nulls.. to y; then x and y themselves, and 1 for the sums
    last = own.select("feature_id", F.lit(2 * nulls).cast("long").alias("block"), F.array("x", "y", F.lit(1.0)).alias("values"))
    rows = null_blocks(mask, shape, 2 * nulls, seed).select("feature_id", "block", "values").unionByName(last)
    rows = rows.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("block", "values"))).alias("parts"))
    rows = rows.select("feature_id", F.flatten(F.col("parts.values")).alias("z"))
    width = 2 * nulls + 3
    if compare is not None:
        rows = rows.persist()
    products = cross_products(rows, width)
    scale = 1.0  # of usual values, for ties
    n, sums = products[-1, -1], products[-1, :-1]
    centred = products[:-1, :-1] - np.outer(sums, sums) / max(n, 1.0)
    one, two, x, y = slice(0, nulls), slice(nulls, 2 * nulls), 2 * nulls, 2 * nulls + 1
    w = [fitted_weights(products[s, s], products[s, at]) for s, at in ((one, x), (two, y))]
    orders = [Orders(nulls, permutations, seed=seed, stream=s) for s in (1, 2)]

    if compare is None:
        r = centred[x, y] / math.sqrt(centred[x, x] * centred[y, y]) if centred[x, x] > 0 and centred[y, y] > 0 else 0.0
        held = spark.sparkContext.broadcast((w, centred[one, one], centred[one, two], centred[two, two]))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (wa, wb), aa, ab, bb = held.value
            for f in frames:
                out = []
                for p in f["id"]:
                    a, b = wa[orders[0][p]], wb[orders[1][p]]
                    size = math.sqrt(max((a @ aa @ a) * (b @ bb @ b), 0.0))
                    out.append((a @ ab @ b) / size if size > 0 else 0.0)
                yield pd.DataFrame({"perm_id": f["id"], "r": out})

        null = spark.range(permutations).mapInPandas(run, "perm_id long, r double")
    else:

        def moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                z = np.stack(f["z"].to_numpy()) if len(f) else np.zeros((0, width))
                for p in range(-1, permutations):  # -1: the maps themselves
                    sides = (z[:, x], z[:, y]) if p < 0 else [z[:, s] @ v[o[p]] for s, v, o in zip((one, two), w, orders)]
                    for ds, value in zip("xy", sides):
                        yield pd.DataFrame({"perm_id": p, "ds": ds, "feature_id": f["feature_id"], "value": value})

        shape_ = f"perm_id long, ds string, feature_id {maps.schema['feature_id'].dataType.simpleString()}, value double"
        found = similarity.pairs(rows.mapInPandas(moved, shape_), None, ("perm_id",), compare).select("perm_id", "r").toPandas()  # a number a permutation
        rows.unpersist()
        r, scale = float(found.loc[found["perm_id"] < 0, "r"].sum()), float(found["r"].abs().max() if len(found) else 0.0)
        null = spark.createDataFrame(found[found["perm_id"] >= 0], "perm_id long, r double")

    reach = float(infer.tied(np.array([abs(r) if two_tailed else r]), scale)[0])
    result = null.agg((F.count_if((F.abs("r") if two_tailed else F.col("r")) >= reach) + 1).alias("hits")).select(F.lit(float(r)).alias("r"), (F.col("hits") / (permutations + 1.0)).alias("p"))
    return result, null
