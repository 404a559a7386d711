"""Statistics, special functions and p-values against dense arithmetic."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from permeon import design, exchange
from permeon.functions import special
from permeon.operators import glm, infer, logistic, spatial, tfce
from permeon.spec import AnalysisSpec

RNG = np.random.default_rng(42)
Y, X = RNG.standard_normal((36, 25)), np.column_stack((np.ones(36), RNG.standard_normal((36, 2))))


def test_special_functions():
    assert special.norm_ppf(np.array([0.975, 0.5, 1e-10, 0, 1])) == pytest.approx([1.959963984540054, 0, -6.361340902404056, -np.inf, np.inf])
    assert special.t_cdf(2.0, 10) == pytest.approx(0.9633059826146299)
    assert special.f_cdf(3.0, 2, 10) == pytest.approx(0.9046325683593750, abs=1e-12)
    assert special.betainc(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    assert special.norm_sf(np.array([1.96])) == pytest.approx([0.0249978951482204])
    assert special.z_of_t(np.array([2.0, -2.0, 0.0]), 1e6) == pytest.approx([2, -2, 0], abs=1e-5)
    assert special.gpd_sf(np.array([0.5]), 1.0, 0.0) == pytest.approx([math.exp(-0.5)])


def test_statistics_agree_with_each_other():
    c = np.array([0, 1.0, 0])
    t, _, df = glm.t(Y, X, c)
    f, df1, df2 = glm.f(Y, X, c)
    r, _, _ = glm.pearson_r(Y, X, c)
    r2, _, _ = glm.r_squared(Y, X, c)
    assert (df, df1, df2) == (33, 1, 33)
    assert f == pytest.approx(t**2) and r2 == pytest.approx(r**2) and r == pytest.approx(t / np.sqrt(t**2 + df))
    groups = np.repeat([1, 2], 18)
    v, _, d = glm.v(Y, X, c, groups)
    g, _, e = glm.g(Y, X, c, groups)
    assert g == pytest.approx(v**2) and d == pytest.approx(e)
    assert glm.as_z(glm.pearson_r, "r")(Y, X, c)[0] == pytest.approx(np.arctanh(r))


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 1000))
def test_partition_leaves_t_and_f(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((20, 4)), rng.standard_normal((20, 3))
    for c, stat in ((rng.standard_normal((1, 4)), glm.t), (rng.standard_normal((2, 4)), glm.f)):
        a, z, e = design.partition(x, c)
        assert np.abs(a.T @ z).max() < 1e-8
        assert stat(y, np.hstack((a, z)), e)[0] == pytest.approx(stat(y, x, c)[0])


@pytest.mark.parametrize(("name", "stat", "c"), [("t", glm.t, [[0, 1, 0]]), ("f", glm.f, [[0, 1, 0], [0, 0, 1]]), ("pearson_r", glm.pearson_r, [[0, 1, 0]]), ("r_squared", glm.r_squared, [[0, 1, 0], [0, 0, 1]])])
def test_permuted_weights_equal_permuted_data(name, stat, c):
    a, z, e = design.partition(X, np.array(c, float))
    orders = np.stack(list(exchange.permutations(36, 7, seed=1)))
    flips = np.stack(list(exchange.signs(36, 7, seed=2)))
    residual, fitted = design.residualise(Y, z)
    fast = glm.Permuted(name, a, z, orders, flips)(residual, slice(0, 7))
    for i in range(7):
        slow = stat((residual * flips[i][:, None])[orders[i]] + fitted, np.hstack((a, z)), e)[0]
        assert fast[i] == pytest.approx(slow)


def test_demean():
    x, c, mask = design.demean(np.column_stack((np.ones(4), [0, 0, 1, 1], [1.0, 2, 3, 6])), [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [True, True, True])
    assert x[:, 0].tolist() == [0, 0, 1, 1] and x[:, 1].sum() == 0 and len(c) == 2 and mask.tolist() == [True, True]


def test_tail_fit():
    null = np.sort(np.random.default_rng(0).standard_exponential(2000))
    fit = infer.fit_tail(null, seed=1)
    assert fit is not None
    p = infer.tail_p(np.array([0.1, 12.0, np.nan]), null, fit)
    assert p[0] > 0.5 and p[1] < 1 / 2001 and p[2] == pytest.approx(1 / 2001, abs=1)
    assert infer.gpd_likelihood(null)[0] == pytest.approx(1, abs=0.1)


def test_logistic_and_auc():
    y = (X[:, 1] + RNG.standard_normal(36) > 0).astype(float)
    b, cov = logistic.irls(y, X)
    mu = special.expit(X @ b)
    assert np.abs(X.T @ (y - mu)).max() < 1e-6 and cov is not None
    assert logistic.auc(np.array([0, 1, 1, 0.0]), np.array([1, 2, 2, 2.0])) == pytest.approx(0.75)
    assert logistic.auc(np.ones(3), np.arange(3.0)) == 0.5


def test_tfce_against_brute_force():
    grid = np.argwhere(np.ones((3, 3, 3)))
    pairs, x = tfce.edges(grid), np.random.default_rng(3).standard_normal(27)
    dh, out = np.abs(x).max() / 100, np.zeros(27)
    for sign in (1, -1):
        for k in range(1, 101):
            on, label = sign * x >= k * dh - 1e-12, np.arange(27)
            for _ in range(27):
                for i, j in pairs:
                    if on[i] and on[j]:
                        label[i] = label[j] = min(label[i], label[j])
            for i in np.flatnonzero(on):
                out[i] += sign * (on & (label == label[i])).sum() ** 0.5 * (k * dh) ** 2 * dh
    assert tfce.enhance(x, pairs) == pytest.approx(out)
    assert tfce.enhance(np.zeros(27), pairs).tolist() == [0] * 27


def test_spatial():
    pts = np.argwhere(np.ones((4, 4, 4)))
    h = spatial.hilbert(pts, 2)
    assert sorted(h) == list(range(64))
    assert (np.abs(np.diff(pts[np.argsort(h)], axis=0)).sum(1) == 1).all()
    q = spatial.random_rotation(1)
    assert q @ q.T == pytest.approx(np.eye(3)) and np.linalg.det(q) == pytest.approx(1)


def test_spec_errors():
    x, c = np.ones((4, 2)), np.array([0, 1.0])
    for bad in ({"contrast": np.ones(3)}, {"exchangeability": np.ones(3, int)}, {"permutations": 0}, {"one_minus_p": True, "neg_log10_p": True}, {"f_only": True}):
        with pytest.raises(ValueError):
            AnalysisSpec(**({"design": x, "contrast": c} | bad))
    s = AnalysisSpec(x, np.eye(2), f_contrast=np.array([0, 1]), permutations=5)
    assert list(s.labels()) == ["c1", "c2", "f"]
    assert AnalysisSpec.from_json(s.to_json()).permutations == 5


def test_axial_rotation():
    affine = np.diag([2.0, 2, 3, 1])
    affine[:3, 3] = 5, 6, 7
    turned = spatial.axial_rotation(affine, 90)
    point = np.array([1.0, 2, 3, 1])
    x, y, z, _ = affine @ point
    assert turned @ point == pytest.approx([y, -x, z, 1])  # a quarter clockwise, seen from above
    assert spatial.axial_rotation(spatial.axial_rotation(affine, 33), -33) == pytest.approx(affine)
    assert spatial.axial_rotation(affine, 360) == pytest.approx(affine)


def test_autocorrelation_compared(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "bin int, gamma double")
    b = spark.createDataFrame([(0, 2.0), (1, 0.0), (5, 9.0)], "bin int, gamma double")
    assert spatial.variogram_rmse(a, b).first()["rmse"] == pytest.approx(((1 + 4) / 2) ** 0.5)
    assert spatial.variogram_rmse(a, a).first()["rmse"] == 0
