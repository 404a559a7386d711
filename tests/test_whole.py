"""Queries do all of their job, and their operators what fixtures say."""

import numpy as np
import pytest

from permeon.plans import analysis
from permeon.queries import P, QUERIES, table


def test_freedman_lane(spark, sf):
    rng = np.random.default_rng(4)
    y, z = rng.standard_normal((12, 5)), np.column_stack((np.ones(12), rng.standard_normal((12, 2))))
    orders = np.stack([rng.permutation(12) for _ in range(7)])
    features = spark.createDataFrame([(i, y[:, i].tolist()) for i in range(5)], "feature_id long, y array<double>")
    perms = spark.createDataFrame([(p, 10 * i, 10 * int(o)) for p, order in enumerate(orders) for i, o in enumerate(order)], "perm_id int, pos long, src long")
    got = {(r["perm_id"], r["feature_id"]): r["y"] for r in analysis.freedman_lane(features, z, perms).collect()}
    fitted = z @ np.linalg.pinv(z) @ y
    assert len(got) == 35
    for (p, i), found in got.items():
        assert np.allclose(found, (y - fitted)[orders[p], i] + fitted[:, i])
    assert QUERIES["freedman_lane_data"](spark, sf).count() == P * 64 * table(spark, sf, "embeddings").count()


def test_all_rows_and_references(spark, sf):
    assert QUERIES["exp_decay"](spark, sf).count() == 64 * 64
    for name in ("sim_ds_ref", "sim_custom_dot"):
        assert {r["b"] for r in QUERIES[name](spark, sf).select("b").collect()} == {f"label{i}" for i in range(10)}


def test_pivot_has_the_means_of_all_types(spark, sf):
    got = {(r["user_id"], t): r[t] for r in QUERIES["scan_pivot_matrix"](spark, sf).collect() for t in ("click", "error", "purchase", "signup", "view")}
    want = {}
    for r in table(spark, sf, "events").collect():
        want.setdefault((r["user_id"], r["event_type"]), []).append(r["value"])
    assert {k for k, v in got.items() if v is not None} == {k for k, v in want.items() if any(x is not None for x in v)}
    for k, v in got.items():
        assert v is None or abs(v - np.mean([x for x in want[k] if x is not None])) < 1e-5


def test_ties_count(spark):
    """Few distinct orders of a design: the observed order, and all that only swap equal rows, reach the statistic of every feature."""
    from permeon.spec import AnalysisSpec

    rng = np.random.default_rng(6)
    for n, x in ((12, np.column_stack((np.ones(12), np.arange(12) % 2))), (36, np.column_stack((np.ones(36), np.arange(36) % 2, rng.standard_normal(36))))):
        y = rng.standard_normal((n, 2000))
        features = spark.createDataFrame([(i, y[:, i].tolist()) for i in range(2000)], "feature_id long, y array<double>")
        swapped = np.arange(n)
        swapped[[0, 2]] = [2, 0]
        orders = np.stack([np.arange(n), swapped if x.shape[1] == 2 else np.arange(n)])
        for stat in ("auto", lambda y, m, c, g=None: (np.abs(y).sum(0), None)) if n == 12 else ("auto",):
            spec = AnalysisSpec(x, np.eye(x.shape[1])[1], permutations=2, orders=orders, **({} if stat == "auto" else {"stat": stat}))
            got = analysis.permutation_analysis(features, spec).features.select("exceed", "uncp", "fwep").distinct().collect()
            assert {(r["exceed"], r["uncp"]) for r in got} == {(2, 1.0)}
            assert max(r["fwep"] for r in got) == 1.0


def test_references_of_another_length(spark, sf):
    from permeon.operators.similarity import similarity_analysis
    from permeon.queries import halves, reference_maps

    with pytest.raises(ValueError, match="features"):
        similarity_analysis(halves(spark, sf), reference_maps(spark, sf).where("feature_id < 60"))
