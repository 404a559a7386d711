"""Distribution functions without SciPy, as NumPy kernels and as Spark columns.

Columns use only arithmetic, so they stay inside code generation; kernels serve Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Wichura's algorithm AS 241 (PPND16), numerators and denominators of its three ranges.
PPND = {
    "mid": (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    "near": (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    "far": (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
}


def _poly(c: tuple[float, ...], x):
    out = c[-1]
    for a in c[-2::-1]:
        out = out * x + a
    return out


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Standard normal quantiles; 0 and 1 give infinities, anything outside NaN."""
    p = np.asarray(p, np.float64)
    q = p - 0.5
    with np.errstate(all="ignore"):
        r = 0.180625 - q * q
        mid = q * _poly(PPND["mid"][0], r) / _poly(PPND["mid"][1], r)
        s = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        near = _poly(PPND["near"][0], s - 1.6) / _poly(PPND["near"][1], s - 1.6)
        far = _poly(PPND["far"][0], s - 5) / _poly(PPND["far"][1], s - 5)
        tail = np.copysign(np.where(s <= 5, near, far), q)
        out = np.where(np.abs(q) <= 0.425, mid, tail)
    out = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, out))
    return np.where((p < 0) | (p > 1) | np.isnan(p), np.nan, out)


def norm_ppf_col(p: Column) -> Column:
    """The same as a column; null outside (0, 1)."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    s = F.sqrt(-F.log(F.least(p, 1 - p)))
    ratio = lambda name, x: _poly(tuple(map(F.lit, PPND[name][0])), x) / _poly(tuple(map(F.lit, PPND[name][1])), x)
    tail = F.signum(q) * F.when(s <= 5, ratio("near", s - 1.6)).otherwise(ratio("far", s - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio("mid", r)).otherwise(tail))


def norm_ppf_sql(p: str) -> str:
    """The same as SQL text, for any engine."""
    poly = lambda c, x: f"({c[0]!r}::double)" if len(c) == 1 else f"({c[0]!r}::double + ({x}) * {poly(c[1:], x)})"
    ratio = lambda name, x: f"({poly(PPND[name][0], x)} / {poly(PPND[name][1], x)})"
    q, s = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return (
        f"(case when abs({q}) <= 0.425 then {q} * {ratio('mid', f'0.180625::double - {q} * {q}')} "
        f"else sign({q}) * (case when {s} <= 5 then {ratio('near', f'{s} - 1.6')} else {ratio('far', f'{s} - 5')} end) end)"
    )


def norm_sf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.ravel(z)]).reshape(np.shape(z))


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (a, b, x)))
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x))
        turn = x < (a + 1) / (a + b + 2)
        p, q, y = np.where(turn, a, b), np.where(turn, b, a), np.where(turn, x, 1 - x)
        value = front * _lentz(p, q, y) / p
        out = np.where(turn, value, 1 - value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _lentz(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    floor = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / floor(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / floor(1 + term * d)
            c = floor(1 + term / c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


#: Terms of the continued fraction as a column; it needs some 5 + sqrt(a + b) at the most.
TERMS = 100


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def lgamma_col(x: Column) -> Column:
    """log Gamma for positive arguments: Stirling's series, eight steps up, where it is exact to some 1e-13."""
    up = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda acc, i: acc + F.log(x + i))
    y = x + 8
    y2 = 1 / (y * y)
    series = (F.lit(1 / 12) - y2 * (F.lit(1 / 360) - y2 * (F.lit(1 / 1260) - y2 * F.lit(1 / 1680)))) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - up


def betainc_col(a: Column, b: Column, x: Column, terms: int = TERMS) -> Column:
    """The incomplete beta function as a column, for real a and b: Lentz's fraction as a fold over a fixed sequence, which stays as it
    is once a step changes nothing."""
    turn = x < (a + 1) / (a + b + 2)
    side = F.struct(F.when(turn, a).otherwise(b).alias("a"), F.when(turn, b).otherwise(a).alias("b"), F.when(turn, x).otherwise(1 - x).alias("x"))
    floor = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def start(s: Column) -> Column:
        d = 1 / floor(1 - (s["a"] + s["b"]) * s["x"] / (s["a"] + 1))
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), s["x"].alias("x"), F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

    def step(s: Column, n: Column) -> Column:
        """One of the two terms of each round, in turn: n = 2, 3, 4, .. is m = n div 2."""
        m = F.floor(n / 2).cast("double")
        even = m * (s["b"] - m) * s["x"] / ((s["a"] + 2 * m - 1) * (s["a"] + 2 * m))
        odd = -(s["a"] + m) * (s["a"] + s["b"] + m) * s["x"] / ((s["a"] + 2 * m) * (s["a"] + 2 * m + 1))
        term = F.when(n % 2 == 0, even).otherwise(odd)
        ends = bound(term, lambda t: F.struct(floor(1 + t / s["c"]).alias("c"), (1 / floor(1 + t * s["d"])).alias("d")))
        return bound(ends, lambda e: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["x"].alias("x"), e["c"].alias("c"), e["d"].alias("d"), (s["h"] * e["c"] * e["d"]).alias("h")))

    fraction = F.aggregate(F.sequence(F.lit(2), F.lit(2 * terms + 1)), bound(side, start), step, lambda s: s["h"] / s["a"])
    front = F.exp(lgamma_col(a + b) - lgamma_col(a) - lgamma_col(b) + a * F.log(x) + b * F.log1p(-x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(bound(front * fraction, lambda v: F.when(turn, v).otherwise(1 - v)))


def z_of_t_col(t: Column, df: Column, eps: float | None = None) -> Column:
    """A t statistic's z-score, with real degrees of freedom, through the smaller tail."""
    low = F.greatest(F.least(betainc_col(df / 2, F.lit(0.5), df / (df + t * t)) / 2, F.lit(0.5)), F.lit(EPS if eps is None else eps))
    return F.signum(t) * F.abs(bound(low, norm_ppf_col))


def z_of_f_col(f: Column, df1: Column, df2: Column, eps: float | None = None) -> Column:
    least = EPS if eps is None else eps
    p = betainc_col(df1 / 2, df2 / 2, df1 * f / (df2 + df1 * f))
    return bound(F.greatest(F.least(p, F.lit(1 - least)), F.lit(least)), norm_ppf_col)


def t_cdf(t, df) -> np.ndarray:
    t, df = np.asarray(t, np.float64), np.asarray(df, np.float64)
    tail = betainc(df / 2, 0.5, df / (df + t * t)) / 2
    return np.where(t > 0, 1 - tail, tail)


def f_cdf(f, df1, df2) -> np.ndarray:
    f = np.maximum(np.asarray(f, np.float64), 0)
    return betainc(np.asarray(df1) / 2, np.asarray(df2) / 2, df1 * f / (df2 + df1 * f))


EPS = float(np.finfo(np.float64).eps)


def z_of_t(t, df, eps: float = EPS) -> np.ndarray:
    """Through the smaller tail, so large statistics keep their precision up to the clip."""
    t = np.asarray(t, np.float64)
    low = np.clip(t_cdf(-np.abs(t), df), eps, 0.5)
    return np.copysign(norm_ppf(low), t)


def z_of_f(f, df1, df2, eps: float = EPS) -> np.ndarray:
    return norm_ppf(np.clip(f_cdf(f, df1, df2), eps, 1 - eps))


def t_within_col(t: Column, df: int) -> Column:
    """P(|T| <= t) for integer degrees of freedom, as a finite sum (Abramowitz and Stegun 26.7.3-4)."""
    theta = F.atan(F.abs(t) / math.sqrt(df))
    c2 = F.pow(F.cos(theta), 2)
    if df == 1:
        return 2 * theta / math.pi
    first = 1 if df % 2 else 0  # odd: terms 2j/(2j+1) of cos^(2j+1); even: (2j-1)/2j of cos^2j
    last = (df - 3) // 2 if df % 2 else (df - 2) // 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        ratio = 2 * j / (2 * j + 1) if first else (2 * j - 1) / (2 * j)
        term = acc["term"] * ratio * c2
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(max(last, 1))), start, step)["sum"] if last >= 1 else F.lit(1.0)
    if df % 2:
        return 2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * total)
    return F.sin(theta) * total


def gpd_sf(x, scale: float, shape: float) -> np.ndarray:
    """Survival of a generalised Pareto excess in Hosking and Wallis's sign: a positive shape bounds the tail."""
    x = np.maximum(np.asarray(x, np.float64), 0)
    if abs(shape) < np.finfo(np.float64).eps:
        return np.exp(-x / scale)
    return np.power(np.maximum(1 - shape * x / scale, 0), 1 / shape)


def gpd_sf_col(x: Column, scale: Column, shape: Column) -> Column:
    x = F.greatest(x, F.lit(0.0))
    return F.when(F.abs(shape) < EPS, F.exp(-x / scale)).otherwise(F.pow(F.greatest(1 - shape * x / scale, F.lit(0.0)), 1 / shape))


def expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))
