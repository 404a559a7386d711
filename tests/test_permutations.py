"""Orders that tasks make by themselves, ties, ranges that can be continued, streams that restart, and enhanced maps."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from permeon import exchange
from permeon.operators import infer, similarity, tfce
from permeon.plans import analysis, ranges
from permeon.shared import scratch_path
from permeon.sources.sinks import put
from permeon.spec import AnalysisSpec
from permeon.streaming import online

RNG = np.random.default_rng(8)


def features_of(spark, y):
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(y.T)], "feature_id long, y array<double>").repartition(3)


def two_groups(n):
    return np.column_stack((np.ones(n), np.arange(n) % 2))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(0, 2**70), st.integers(1, 4))
def test_orders_are_bijections_of_their_own(n, seed, blocks):
    eb = np.arange(n) % blocks + 1
    for orders in (exchange.Orders(n, 5, seed=seed), exchange.Orders(n, 5, eb, within=True, whole=False, seed=seed)):
        assert all(sorted(o) == list(range(n)) for o in orders)
        assert np.array_equal(orders[3], cloudpickle.loads(cloudpickle.dumps(orders))[3])  # whoever makes it, in whatever order
    assert all((eb[o] == eb).all() for o in orders)
    signs = exchange.Signs(n, 4, eb, seed)
    assert all(set(s) <= {-1, 1} and all(len(set(s[eb == b])) == 1 for b in set(eb)) for s in signs)
    with pytest.raises(IndexError):
        orders[5]


def test_orders_are_uniform():
    seen = np.array(list(exchange.Orders(4, 6000, seed=1)))
    _, n = np.unique(seen, axis=0, return_counts=True)
    assert len(n) == 24 and np.abs(n - 250).max() < 6 * 250**0.5
    assert not np.array_equal(seen[:50], np.array(list(exchange.Orders(4, 50, seed=1, stream=1))))


@pytest.mark.parametrize("mode", ["free", "within", "whole", "both"])
def test_hash_orders_are_those_of_spark(spark, mode):
    ids, blocks = np.array([3, 5, 8, 9, 20, 31, 40, 41]), np.array([2, 1, 2, 1, 3, 3, 4, 4])
    samples = spark.createDataFrame(list(zip(ids.tolist(), blocks.tolist())), "sample_id long, block int")
    got = {(r["perm_id"], r["pos"]): r["src"] for r in exchange.hash_permutations(samples, 6, mode).collect()}
    orders = exchange.HashOrders(ids, 6, mode, blocks)
    assert got == {(p, int(ids[i])): int(ids[s]) for p in range(6) for i, s in enumerate(orders[p])}


def test_closures_hold_no_permutations(spark):
    sizes = []
    for n, p in ((20, 20), (20_000, 20), (20, 100_000)):
        spec = AnalysisSpec(np.column_stack((np.ones(n), np.arange(n) % 2, np.arange(n) % 7)), np.array([[0, 1.0, 0], [0, 0, 1]]), permutations=p, flip_signs=True)
        tasks = analysis.plan(spec)
        held = analysis.shared(spark, tasks, spec)
        sizes.append(len(cloudpickle.dumps(analysis.block_partials(held))))
        assert len(cloudpickle.dumps(tasks)) < 10 << 20
    assert max(sizes) - min(sizes) < 100 and max(sizes) < 10_000


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e9])
def test_p_values_have_no_scale(spark, scale):
    """Statistics with a unit: the tie rule has no absolute floor."""
    y = np.random.default_rng(3).standard_normal((24, 40))
    y[:, :5] += 2 * (np.arange(24) % 2)[:, None]

    def difference(y, m, c, groups=None):
        own = m[:, 0] > 0
        return y[own].mean(0) - y[~own].mean(0), 1, 1

    spec = AnalysisSpec(two_groups(24), np.array([0, 1.0]), permutations=99, stat=difference)
    one, other = (analysis.permutation_analysis(features_of(spark, y * s), spec).features.orderBy("feature_id").toPandas() for s in (1.0, scale))
    for c in ("exceed", "uncp", "fdrp", "fwep"):
        assert one[c].tolist() == other[c].tolist()
    assert one["uncp"].min() == 0.01


def test_ties_near_zero():
    null = np.array([-3.0, 1e-16, 2.0])
    assert (null >= infer.tied(np.array(3e-16), 3.0)).sum() == 2 and (null >= infer.tied(np.array(3e-16))).sum() == 1
    assert np.isnan(infer.tied(np.array([np.nan]))[0]) and infer.tied(np.array([np.inf]))[0] == np.inf


@pytest.mark.parametrize("compare", [None, lambda a, b: float(a @ b)])
def test_the_identity_order_reaches_every_similarity(spark, compare):
    n, v, r = 36, 60, 300 if compare is None else 20
    rng = np.random.default_rng(12)
    x = np.column_stack((np.ones(n), rng.standard_normal((n, 2))))
    spec = AnalysisSpec(x, np.array([0, 1.0, 0]), permutations=1, orders=np.arange(n)[None])
    y = rng.standard_normal((n, v))
    refs = spark.createDataFrame([(f"r{k}", i, float(a)) for k, m in enumerate(rng.standard_normal((r, v))) for i, a in enumerate(m)], "ref_id string, feature_id long, value double")
    out = similarity.similarity_analysis({"d": (features_of(spark, y), spec)}, refs, compare=compare)
    got = out["ds_ref"].collect()
    assert len(got) == r and {g["p"] for g in got} == {1.0}
    assert out["null_ds_ref"].count() == r


def test_similarity_by_blocks_equals_whole_maps(spark):
    rng = np.random.default_rng(2)
    n, v = 16, 50
    ds = {k: (features_of(spark, rng.standard_normal((n, v))), AnalysisSpec(two_groups(n), np.array([0, 1.0]), permutations=11, seed=i)) for i, k in enumerate(("b", "a", "c"))}
    rows = [("r0", i, float(a)) for i, a in enumerate(rng.standard_normal(v))]
    refs = spark.createDataFrame(rows, "ref_id string, feature_id long, value double")
    got = similarity.similarity_analysis(ds, refs, accel_tail=False)
    whole = similarity.similarity_analysis(ds, refs, compare=lambda a, b: float(np.corrcoef(a, b)[0, 1]))
    for name in ("ds_ds", "ds_ref"):
        one, other = ({(r["a"], r["b"]): (r["r"], r["p"]) for r in out[name].collect()} for out in (got, whole))
        assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k]) for k in one)
    assert {(r["a"], r["b"]) for r in got["ds_ds"].collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    tails = similarity.similarity_analysis({k: (f, AnalysisSpec(s.design, s.contrast, permutations=150, seed=4)) for k, (f, s) in ds.items()}, accel_tail=True)["ds_ds"].collect()
    assert len(tails) == 3 and all(0 < r["p"] <= 1 for r in tails)


def spec_for_ranges(**more):
    return AnalysisSpec(two_groups(20), np.array([0, 1.0]), permutations=41, seed=9, **more)


def test_a_stopped_run_goes_on(spark):
    y = np.random.default_rng(1).standard_normal((20, 30))
    features, spec, folder = features_of(spark, y), spec_for_ranges(), scratch_path(spark, "ranges")
    want = analysis.permutation_analysis(features, spec).features.orderBy("feature_id").toPandas()
    calls = []

    def stop(interim):
        calls.append(interim.agg(F.max("done")).first()[0])
        if len(calls) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ranges.resumable_analysis(features, spec, folder, 4, save_fn=stop)
    store = ranges.Partials(spark, folder, spec)
    assert len(store.names()) == 2 and calls == [10, 20]
    # a range whose writer died has no marker, and is written again
    put(spark, f"{store.path('000000020-000000031')}/part-0.parquet", b"broken")
    seen = []
    out = ranges.resumable_analysis(features, spec, folder, 4, permute_fn=lambda cube: seen.append({r[0] for r in cube.select("perm_id").distinct().collect()}))
    got = out.features.orderBy("feature_id").toPandas()
    assert got.equals(want[got.columns.tolist()]) and seen == [set(range(20, 31)), set(range(31, 41))]
    again = []
    ranges.resumable_analysis(features, spec, folder, 4, save_fn=again.append)
    assert again == []
    with pytest.raises(ValueError, match="another analysis"):
        ranges.resumable_analysis(features, spec_for_ranges(two_tailed=False), folder, 4)


def test_a_stream_that_restarts(spark):
    y = np.random.default_rng(5).standard_normal((20, 12))
    features, spec, folder = features_of(spark, y), spec_for_ranges(), scratch_path(spark, "stream")

    def run():
        writer, store = online.counting(online.permutation_stream(spark, f"{folder}/in", 1), features, spec, folder)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return store

    put(spark, f"{folder}/in/0.json", b"".join(b'{"perm_id": %d}\n' % p for p in range(0, 17)))
    first = run().p_values().toPandas()
    assert set(first["done"]) == {17}
    # numbers that came before, of no permutation, and none
    put(spark, f"{folder}/in/1.json", b"".join(b'{"perm_id": %d}\n' % p for p in [*range(10, 41), 99, -1]) + b"{}\n")
    got = run().p_values().orderBy("feature_id").toPandas()
    want = analysis.permutation_analysis(features, spec).features.orderBy("feature_id").toPandas()
    assert set(got["done"]) == {41} and got["uncp"].tolist() == pytest.approx(want["uncp"].tolist()) and got["exceed"].tolist() == want["exceed"].tolist()
    # a batch that runs again writes the same place
    store = run()
    assert store.names() == ["batch-000000000", "batch-000000001"]


def brute_tfce(x, pairs, dh):
    out, last = np.zeros(len(x)), int(np.floor(np.abs(x).max() / dh + 1e-9))
    for sign in (1, -1):
        for k in range(1, last + 1):
            on, label = sign * x >= k * dh * (1 - 1e-9), np.arange(len(x))
            links = pairs[on[pairs].all(1)]
            while True:
                before = label.copy()
                np.minimum.at(label, links[:, 0], label[links[:, 1]])
                np.minimum.at(label, links[:, 1], label[links[:, 0]])
                if np.array_equal(before, label):
                    break
            size = np.bincount(label[on], minlength=len(x))
            out[on] += sign * size[label[on]] ** 0.5 * (k * dh) ** 2 * dh
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 3))
def test_enhanced_maps_of_random_lattices(seed, dims):
    rng = np.random.default_rng(seed)
    grid = np.argwhere(rng.random(tuple(rng.integers(1, 7, dims))) < 0.8) * 1 - 3
    pairs = tfce.edges(grid)
    want = {frozenset((i, j)) for i in range(len(grid)) for j in range(i) if np.abs(grid[i] - grid[j]).sum() == 1}
    assert {frozenset(p) for p in pairs.tolist()} == want and len(pairs) == len(want)
    x = np.round(rng.standard_normal(len(grid)), int(rng.integers(0, 3)))  # with many ties
    dh = tfce.auto_dh(x)
    assert tfce.enhance(x, pairs) == pytest.approx(brute_tfce(x, pairs, dh) if dh else np.zeros(len(x)))
    if len(x):
        x[0] = np.nan
        assert np.isfinite(tfce.enhance(x, pairs)).all()


def test_a_large_map_is_quick():
    grid = np.argwhere(np.ones((50, 40, 25), bool))
    pairs, rng = tfce.edges(grid), np.random.default_rng(0)
    smooth = rng.standard_normal((50, 40, 25))
    for axis in range(3):
        smooth = smooth + np.roll(smooth, 1, axis) + np.roll(smooth, -1, axis)
    start = time.process_time()
    tfce.enhance(smooth.ravel(), pairs)
    assert time.process_time() - start < 1.5


def test_enhanced_p_values(spark):
    grid = np.argwhere(np.ones((4, 4, 3), bool))
    lattice = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(grid)], "feature_id long, i int, j int, k int")
    rng = np.random.default_rng(4)
    y = rng.standard_normal((18, 48)) + 1.5 * (np.arange(18) % 2)[:, None] * (grid[:, 0] < 2)
    x = np.column_stack((two_groups(18), rng.standard_normal(18)))
    spec = AnalysisSpec(x, np.eye(3)[1:], f_contrast=np.array([True, True]), permutations=23, across_contrasts=True, accel_tail=True)
    got = tfce.tfce_analysis(features_of(spark, y), spec, lattice)
    assert got.tags == {"c1": "tfce_tstat", "c2": "tfce_tstat", "f": "tfce_fstat"}
    f, m = got.features.toPandas(), got.maxima.toPandas()
    pairs, cube = tfce.edges(grid), analysis.permuted_statistics(features_of(spark, y), spec).toPandas()
    for task in analysis.plan(spec):
        fold = np.abs if task.two_tailed else (lambda v: v)
        seen = tfce.enhance(task.at_rest(y), pairs, task.two_tailed)
        own = f[f["contrast"] == task.label].sort_values("feature_id")
        maps = [tfce.enhance(g.sort_values("feature_id")["stat"].to_numpy(), pairs, task.two_tailed) for _, g in cube[cube["contrast"] == task.label].groupby("perm_id")]
        exceed = sum(fold(z) >= fold(seen) * (1 - 1e-9) for z in maps)
        assert own["stat"].to_numpy() == pytest.approx(seen) and own["exceed"].tolist() == exceed.tolist()
        assert sorted(m[m["contrast"] == task.label]["max_stat"]) == pytest.approx(sorted(fold(z).max() for z in maps))
    assert (f["cfwep"] >= f["fwep"] - 1e-12).all() and f[["uncp", "fdrp", "fwep", "cfdrp", "cfwep"]].stack().between(0, 1).all()
    got.release()
