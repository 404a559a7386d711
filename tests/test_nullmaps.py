"""Null maps and correlations against them, held against NumPy over whole lattices."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from permeon.exchange import Orders
from permeon.operators import nullmaps


def blurred(a, sigma):
    """Each place sums the kernel over the lattice as mirrors repeat it."""
    w = nullmaps.kernel(sigma)
    for axis, n in enumerate(a.shape):
        at = np.arange(n)[:, None] + np.arange(-(len(w) // 2), len(w) // 2 + 1)
        at %= 2 * n
        at = np.where(at < n, at, 2 * n - 1 - at)
        a = np.moveaxis((np.moveaxis(a, axis, -1)[..., at] * w).sum(-1), -1, axis)
    return a


def noise(seed, m, feature):
    h = hashlib.md5(f"{seed}:{m}:{feature}".encode()).hexdigest()
    a, b = ((int(h[lo : lo + 8], 16) + 0.5) / 2**32 for lo in (0, 8))
    return math.sqrt(-2 * math.log(a)) * math.cos(2 * math.pi * b)


def null_matrix(mask, count, seed):
    """maps x features, features being places in the flat lattice."""
    at = np.argwhere(mask)
    d = np.sqrt(((at - at.mean(0)) ** 2).sum(1))
    share = (d - d.min()) / max(d.max() - d.min(), 1e-300)
    out = []
    for m in range(count):
        a = np.zeros(mask.shape)
        a[mask] = [noise(seed, m, f) for f in np.flatnonzero(mask)]
        v = (1 - share) * blurred(a, nullmaps.CENTRE)[mask] + share * blurred(a, nullmaps.EDGE)[mask]
        out.append((v - v.mean()) / v.std() if v.std() else v * 0)
    return np.array(out)


def table_of(spark, mask):
    places = [(int(f), *map(int, p)) for f, p in zip(np.flatnonzero(mask), np.argwhere(mask))]
    return spark.createDataFrame(places, "feature_id long, i int, j int, k int")


def matrix_of(df, mask, count):
    rows = df.toPandas().sort_values(["map_id", "feature_id"])
    assert rows["feature_id"].tolist() == np.flatnonzero(mask).tolist() * count
    return rows["value"].to_numpy().reshape(count, -1)


@pytest.mark.parametrize("shape", [(3, 150, 2), (21, 17, 5), (1, 1, 130)])
def test_smoothed(spark, shape):
    """Lattices shorter than a kernel's reach, and longer than a segment with its halo."""
    a = np.random.default_rng(1).standard_normal(shape)
    a[0, 0, 0] = 0
    rows = [(5, *map(int, p), [float(a[tuple(p)]), 0.0]) for p in np.argwhere(a)]
    df = spark.createDataFrame(rows, "m long, i long, j long, k long, values array<double>")
    got = nullmaps.smoothed(df, shape, (1.0, 4.0), ("m",)).collect()
    assert len(got) == a.size and {r["m"] for r in got} == {5}
    narrow, wide = np.full(shape, np.nan), np.full(shape, np.nan)
    for r in got:
        assert len(r["values"]) == 4 and r["values"][1] == r["values"][3] == 0
        narrow[r["i"], r["j"], r["k"]], wide[r["i"], r["j"], r["k"]] = r["values"][0], r["values"][2]
    assert narrow == pytest.approx(blurred(a, 1.0), abs=1e-12) and wide == pytest.approx(blurred(a, 4.0), abs=1e-12)
    assert not spark.createDataFrame([], df.schema).transform(lambda e: nullmaps.smoothed(e, shape, (1.0,), ("m",))).collect()


def test_null_maps(spark):
    """More maps than share a row, a mask with holes; then the same again, one voxel, and none."""
    mask = np.random.default_rng(2).random((7, 6, 5)) < 0.7
    count = nullmaps.BLOCK + 2
    maps = nullmaps.null_maps(table_of(spark, mask), mask.shape, count, seed=3)
    got = matrix_of(maps, mask, count)
    assert got == pytest.approx(null_matrix(mask, count, 3), abs=1e-9)
    assert np.allclose(got.mean(1), 0) and np.allclose(got.std(1), 1)
    assert np.abs(np.corrcoef(got) - np.eye(count)).max() < 1
    again = table_of(spark, mask).repartition(3, "k").withColumns({"values": F.lit("x"), "block": F.lit(1), "at": F.lit(0)})
    assert matrix_of(nullmaps.null_maps(again, mask.shape, count, seed=3), mask, count) == pytest.approx(got, abs=1e-12)
    one = table_of(spark, np.ones((1, 1, 1), bool))
    assert [r["value"] for r in nullmaps.null_maps(one, (1, 1, 1), 2).collect()] == [0, 0]
    assert not nullmaps.null_maps(one.limit(0), (1, 1, 1), 2).collect()


def brute_weights(target, null, alpha=0.01):
    """The least of |target - w null|^2 + alpha |w - uniform|^2 among weights that sum to 1: along w = uniform + a basis of those that sum to 0."""
    k = len(null)
    basis = np.linalg.svd(np.ones((1, k)))[2][1:]
    a = np.concatenate([(basis @ null).T, math.sqrt(alpha) * basis.T])
    b = np.concatenate([target - null.mean(0), np.zeros(k)])
    return 1 / k + np.linalg.lstsq(a, b, rcond=None)[0] @ basis


@pytest.mark.parametrize("two_tailed", [True, False])
def test_correlate(spark, two_tailed):
    rng = np.random.default_rng(4)
    mask = rng.random((6, 5, 4)) < 0.8
    features, k, p = np.flatnonzero(mask), 5, 30
    x = rng.standard_normal(len(features))
    y = 0.3 * x + rng.standard_normal(len(features))
    rows = [(int(f), float(a), float(b)) for f, a, b in zip(features, x, y)]
    maps = spark.createDataFrame([*rows, (10_000, 1.0, 2.0)], "feature_id long, x double, y double")
    null = null_matrix(mask, 2 * k, 7)
    one, two = null[:k], null[k:]
    w = brute_weights(x, one), brute_weights(y, two)
    assert w[0].sum() == pytest.approx(1)
    orders = [Orders(k, p, seed=7, stream=s) for s in (1, 2)]
    expected = [np.corrcoef(w[0][orders[0][i]] @ one, w[1][orders[1][i]] @ two)[0, 1] for i in range(p)]
    r = np.corrcoef(x, y)[0, 1]
    hits = sum(abs(e) >= abs(r) if two_tailed else e >= r for e in expected)
    for compare in (None, lambda a, b: np.corrcoef(a, b)[0, 1]):
        result, found = nullmaps.correlate(maps, table_of(spark, mask), mask.shape, p, k, 7, two_tailed, compare)
        got = [row["r"] for row in found.orderBy("perm_id").collect()]
        assert got == pytest.approx(expected, abs=1e-9)
        row = result.first()
        assert row["r"] == pytest.approx(r, abs=1e-12) and row["p"] == pytest.approx((hits + 1) / (p + 1))


def test_correlate_errors(spark):
    mask = table_of(spark, np.ones((2, 2, 2), bool))
    maps = mask.select("feature_id", F.col("i").alias("x"), F.col("j").alias("y"))
    with pytest.raises(ValueError):
        nullmaps.correlate(maps, mask, (2, 2, 2), 5, nullmaps.MOST_MAPS + 1)
    with pytest.raises(Exception, match="missing from a map"):
        nullmaps.correlate(maps.where("feature_id > 0"), mask, (2, 2, 2), 5, 3)
    none = nullmaps.correlate(maps.limit(0), mask.limit(0), (2, 2, 2), 5, 3)[0].first()
    assert (none["r"], none["p"]) == (0, 1)
    constant = nullmaps.correlate(maps.withColumn("x", F.lit(2.0)), mask, (2, 2, 2), 5, 3)[0].first()
    assert (constant["r"], constant["p"]) == (0, 1)


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_mirror_images_do_not_travel(spark, axis):
    """In an axis of one segment a voxel travels once, however often the kernel meets its mirror images; a constant stays constant."""
    shape = [2, 2, 2]
    shape[axis] = 5
    rows = spark.createDataFrame([(i, j, k, [1.0]) for i in range(shape[0]) for j in range(shape[1]) for k in range(shape[2])], "i long, j long, k long, values array<double>")
    plan = nullmaps._along(rows, nullmaps.AXES[axis], shape[axis], (3.0, 7.0), [], False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    blurred = nullmaps.smoothed(rows, tuple(shape), (3.0,)).collect()
    assert len(blurred) == 20 and all(abs(r["values"][0] - 1) < 1e-12 for r in blurred)
