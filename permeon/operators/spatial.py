"""Spatial tools: variograms, spins, rotations, space-filling orders, weighted maps. Experimental."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered


def variogram(values: DataFrame, pairs: DataFrame, bins: int, longest: float | None = None) -> DataFrame:
    """(bin, n, distance, gamma): half the mean squared difference by distance. values: feature_id, value, x, y, z; pairs: a, b,
    a sample drawn by the caller (see hashed_pairs)."""
    v = lambda s: values.select(F.col("feature_id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("value", "x", "y", "z")))
    j = pairs.join(v("a"), "a").join(v("b"), "b")
    j = j.select(F.sqrt(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in "xyz"), F.lit(0.0))).alias("d"), (F.pow(F.col("a_value") - F.col("b_value"), 2) / 2).alias("g"))
    top = longest if longest is not None else j.agg(F.max("d")).first()[0] or 1.0
    j = j.withColumn("bin", F.least(F.floor(F.col("d") / F.lit(top) * bins), F.lit(bins - 1)).cast("int"))
    return j.groupBy("bin").agg(F.count("*").alias("n"), F.avg("d").alias("distance"), F.avg("g").alias("gamma"))


def hashed_pairs(features: DataFrame, each: int) -> DataFrame:
    """(a, b): for every feature `each` partners at hashed offsets; as many rows as features times each, no join of all with all."""
    n = features.count()
    partner = lambda k: F.pmod(F.xxhash64(F.col("feature_id"), k), F.lit(max(n, 1)))
    places = numbered(features.select("feature_id"), "feature_id", name="i")
    drawn = features.select(F.col("feature_id").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(each)), partner)).alias("i"))
    return drawn.join(places.select("i", F.col("feature_id").alias("b")), "i").where("a <> b").select("a", "b")


def variogram_rmse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Root of the mean squared difference of two variograms over the bins that both have."""
    j = a.select("bin", F.col("gamma").alias("g")).join(b.select("bin", F.col("gamma").alias("h")), "bin")
    return j.agg(F.sqrt(F.avg(F.pow(F.col("g") - F.col("h"), 2))).alias("rmse"))


def circular_spin(values: DataFrame, shift: int, n: int) -> DataFrame:
    """feature_id, value moved by `shift` places around a circle of n."""
    return values.select(F.pmod(F.col("feature_id") + shift, F.lit(n)).alias("feature_id"), "value")


def random_rotation(seed: int | None = None) -> np.ndarray:
    """A uniform rotation of space."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, ::-1]


def rotated(coords: DataFrame, rotation: np.ndarray) -> DataFrame:
    """coords (feature_id, x, y, z) turned."""
    rows = [sum((F.col(c) * float(rotation[i, k]) for k, c in enumerate("xyz")), F.lit(0.0)).alias("xyz"[i]) for i in range(3)]
    return coords.select("feature_id", *rows)


def world(lattice: DataFrame, affine: np.ndarray) -> DataFrame:
    """lattice (feature_id, i, j, k) with world coordinates x, y, z."""
    rows = [(sum((F.col(c) * float(affine[r, k]) for k, c in enumerate("ijk")), F.lit(float(affine[r, 3])))).alias("xyz"[r]) for r in range(3)]
    return lattice.select("*", *rows)


def axial_rotation(affine: np.ndarray, degrees_clockwise: float) -> np.ndarray:
    """The affine of an image that is turned about the third axis through the origin of the world."""
    a = -math.radians(degrees_clockwise)
    turn = np.eye(4)
    turn[:2, :2] = [[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]
    return turn @ affine


def exp_decay(distances: DataFrame, by: str) -> DataFrame:
    """weight = exp(-d / the row's largest d); 1 where that is 0."""
    top = distances.groupBy(by).agg(F.max("d").alias("_top"))
    return distances.join(top, by).withColumn("weight", F.exp(-F.coalesce(F.col("d") / F.nullif(F.col("_top"), F.lit(0.0)), F.lit(0.0)))).drop("_top")


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (Skilling's transform), axis by axis in parallel for all points."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def hilbert_col(x: Column, y: Column, z: Column, bits: int) -> Column:
    """The same position as a column: the transform is a fold over the bits, highest first, so its expression doesn't grow with them."""
    powers = F.array(*(F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)))
    above = F.slice(powers, 1, max(bits - 1, 1)) if bits > 1 else F.array().cast("array<bigint>")
    on = lambda v, q: v.bitwiseAND(q) != 0
    xor = lambda a, b: a.bitwiseXOR(b)

    def turn(acc: Column, q: Column) -> Column:
        p = q - 1
        first, out = F.when(on(acc["x"], q), xor(acc["x"], p)).otherwise(acc["x"]), {}
        for name in "yz":
            swap = F.when(on(acc[name], q), F.lit(0).cast("long")).otherwise(xor(first, acc[name]).bitwiseAND(p))
            first = F.when(on(acc[name], q), xor(first, p)).otherwise(xor(first, swap))
            out[name] = xor(acc[name], swap)
        return F.struct(first.alias("x"), out["y"].alias("y"), out["z"].alias("z"))

    def gray(s: Column) -> Column:
        y = xor(s["x"], s["y"])
        z = xor(y, s["z"])
        flip = F.aggregate(above, F.lit(0).cast("long"), lambda t, q: F.when(on(z, q), xor(t, q - 1)).otherwise(t))
        bit = lambda v, q: F.when(on(xor(v, flip), q), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.aggregate(powers, F.lit(0).cast("long"), lambda t, q: t * 8 + bit(s["x"], q) * 4 + bit(y, q) * 2 + bit(z, q))

    return F.aggregate(above, F.struct(*(c.cast("long").alias(n) for c, n in zip((x, y, z), "xyz"))), turn, gray)


def on_curve(coords: DataFrame, bits: int) -> DataFrame:
    """coords (.., x, y, z) with `hilbert`, after scaling to the curve's cube: six numbers go through the driver."""
    ends = coords.agg(*(f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz")).first()
    lo = {c: ends[f"lo{c}"] or 0.0 for c in "xyz"}
    span, top = max(*((ends[f"hi{c}"] or 0.0) - lo[c] for c in "xyz"), 1e-300), (1 << bits) - 1
    grid = lambda c: F.greatest(F.lit(0), F.least(F.lit(top), F.floor((F.col(c) - lo[c]) / span * top + 0.5)))
    return coords.withColumn("hilbert", hilbert_col(*(grid(c) for c in "xyz"), bits))


def hilbert_order(coords: DataFrame, bits: int = 10) -> DataFrame:
    """feature_id, hilbert (position on the curve) and place (rank). coords: feature_id, x, y, z."""
    return numbered(on_curve(coords, bits).select("feature_id", "hilbert"), "hilbert", "feature_id")


def unravel(atlas: DataFrame, bits: int = 10, background: int = 0) -> DataFrame:
    """atlas (feature_id, parcel, x, y, z) in Hilbert order of parcel centroids, then inside parcels."""
    own = atlas.where(F.col("parcel") != background)
    centres = own.groupBy("parcel").agg(*(F.round(F.avg(c)).alias(c) for c in "xyz"))
    outer = on_curve(centres, bits).select("parcel", F.col("hilbert").alias("outer"))
    ranked = on_curve(own, bits).select("feature_id", "parcel", "hilbert").join(outer, "parcel")
    return numbered(ranked, "outer", "parcel", "hilbert", "feature_id").select("feature_id", "parcel", "place")


def weighted_maps(null: DataFrame, weights: DataFrame) -> DataFrame:
    """(perm_id, feature_id, value): sums of null maps under each row of weights. null: map_id, feature_id, value; weights: perm_id,
    map_id, w."""
    return null.join(weights, "map_id").groupBy("perm_id", "feature_id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def distance(a: str, b: str) -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2) for c in "xyz"), F.lit(0.0)))
