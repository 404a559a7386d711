"""P-values from exceedance counts and null maxima.

Uncorrected: (exceedances + 1) / (permutations + 1). FDR: Benjamini and Hochberg's step-up on them, with the least possible p taken
as 0. A p-value is a function of an integer count, so there are at most permutations + 1 of them: ranks come from a histogram of
counts, and no window ever orders the features. FWE: how many null maxima reach the statistic, by binary search in the sorted
maxima (one number a permutation), or by a generalised Pareto fit of their tail.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special


#: Statistics of the same data in another order differ by rounding: within TIE of themselves, or NEAR_ZERO of the null's scale, they tie.
TIE, NEAR_ZERO = 1e-9, 1e-12


def tied(x: np.ndarray, scale: np.ndarray | float = 0.0) -> np.ndarray:
    """The least value that counts as reaching x. scale: the size of usual values (of the null), for x near 0."""
    x = np.asarray(x, float)
    scale = np.where(np.isfinite(scale), scale, 0.0)
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(x), x - np.maximum(TIE * np.abs(x), NEAR_ZERO * scale), x)


def uncorrected(exceed: Column, permutations: int) -> Column:
    return (exceed + 1) / F.lit(permutations + 1.0)


def fdr(counts: DataFrame, permutations: int, by: list[str], zero_least: bool = True, alias: str = "fdrp") -> DataFrame:
    """counts (.., exceed) with the step-up p-value added. by: the columns inside which features are ranked; none: over all."""
    held = counts.groupBy(*by, "exceed").agg(F.count("*").alias("held"))
    within = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    p = uncorrected(F.col("exceed"), permutations)
    p = F.when(F.col("exceed") == 0, 0.0).otherwise(p) if zero_least else p
    upto = F.sum("held").over(within.orderBy("exceed"))
    held = held.withColumn("rank", upto).withColumn("raw", p * F.sum("held").over(within) / F.col("rank"))
    held = held.withColumn(alias, F.least(F.lit(1.0), F.min("raw").over(within.orderBy(F.desc("exceed")))))
    return counts.join(F.broadcast(held.select(*by, "exceed", alias)), [*by, "exceed"])  # permutations + 1 rows a key at most


def sorted_maxima(maxima: DataFrame, by: str = "contrast") -> dict[str, np.ndarray]:
    """The null maxima of each label, ascending: one number a permutation."""
    rows = maxima.toPandas()
    return {k: np.sort(g["max_stat"].to_numpy()) for k, g in rows.groupby(by)}


def fwe(stats: DataFrame, null: dict[str, np.ndarray], two_tailed: dict[str, bool], tail: str | None = None, alias: str = "fwep", seed: int = 0) -> DataFrame:
    """stats (contrast, .., stat) with the family-wise p-value added. tail: None, 'MOM' or 'MLE' to fit the null's tail."""
    fits = {k: fit_tail(v, tail, seed=seed) if tail else None for k, v in null.items()}
    shape = with_double(stats.schema, alias)

    def run(frames):
        for f in frames:
            out = np.ones(len(f))
            for k, i in f.groupby("contrast").indices.items():
                x = f["stat"].to_numpy()[i]
                out[i] = tail_p(np.abs(x) if two_tailed[k] else x, null[k], fits[k])
            yield f.assign(**{alias: out})

    return stats.mapInPandas(run, shape)


def empirical(x: np.ndarray, null: np.ndarray) -> np.ndarray:
    """(null values that reach x, plus 1) / (null values + 1). null is sorted; a NaN statistic is reached by none."""
    scale = np.abs(null[np.isfinite(null)]).max(initial=0.0)
    reach = len(null) - np.searchsorted(null, tied(x, scale), side="left")
    return (np.where(np.isnan(x), 0, reach) + 1) / (len(null) + 1)


def gpd_moments(excess: np.ndarray) -> tuple[float, float]:
    """(scale, shape) by the method of moments, in Hosking and Wallis's sign."""
    m, var = excess.mean(), excess.var()
    return m * (m * m / var + 1) / 2, (m * m / var - 1) / 2


def gpd_likelihood(excess: np.ndarray) -> tuple[float, float]:
    """(scale, shape) by maximum likelihood: the profile over theta = shape / scale on a grid that is refined twice."""
    top = excess.max()

    def fitted(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = np.array([-np.log1p(-th * excess).mean() for th in theta])
        with np.errstate(all="ignore"):
            return shape, np.log(theta / shape) + shape - 1

    lo, hi = -10 / excess.mean(), (1 - 1e-6) / top
    for _ in range(3):
        grid = np.linspace(lo, hi, 400)
        grid = grid[np.abs(grid) > 1e-12]
        shape, value = fitted(grid)
        best = int(np.nanargmax(np.where(np.isfinite(value), value, -np.inf)))
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    return float(shape[best] / grid[best]), float(shape[best])


def anderson_darling(u: np.ndarray) -> float:
    """A-squared of values that should be uniform."""
    u = np.clip(np.sort(u), 1e-12, 1 - 1e-12)
    n = len(u)
    i = np.arange(1, n + 1)
    return float(-n - ((2 * i - 1) * (np.log(u) + np.log1p(-u[::-1]))).sum() / n)


def fits_well(excess: np.ndarray, scale: float, shape: float, rng: np.random.Generator, samples: int = 5000) -> bool:
    """Goodness of fit at level 0.05, parameters taken as known: the statistic against that of simulated uniform samples."""
    seen = anderson_darling(1 - special.gpd_sf(excess, scale, shape))
    u = np.clip(np.sort(rng.random((samples, len(excess))), axis=1), 1e-12, 1 - 1e-12)
    i = np.arange(1, len(excess) + 1)
    null = -len(excess) - ((2 * i - 1) * (np.log(u) + np.log1p(-u[:, ::-1]))).sum(1) / len(excess)
    return (np.count_nonzero(null >= seen) + 1) / (samples + 1) > 0.05


def fit_tail(null: np.ndarray, method: str = "MOM", start: float = 0.75, least: int = 20, seed: int = 0, samples: int = 5000):
    """(threshold, tail share, scale, shape) of the first tail that a generalised Pareto fits, or None."""
    rng = np.random.default_rng(seed)
    for q in np.arange(start, 0.992, 0.01):
        threshold = np.percentile(null, q * 100)
        tail = null[null >= threshold]
        if len(tail) < least:
            return None
        excess = tail - threshold
        if excess.var() <= 0:
            continue
        scale, shape = gpd_moments(excess) if method == "MOM" else gpd_likelihood(excess)
        if scale > 0 and fits_well(excess, scale, shape, rng, samples):
            return threshold, len(tail) / len(null), scale, shape
    return None


def tail_p(x: np.ndarray, null: np.ndarray, fit=None, below: float = 0.1) -> np.ndarray:
    """Empirical p-values; where they are at most `below` and a tail is fitted, the fit's if that is smaller."""
    p = empirical(x, null)
    if fit is None or not (p <= below).any():
        return p
    threshold, share, scale, shape = fit
    deep = (p <= below) & (x >= threshold)
    p[deep] = np.minimum(p[deep], np.maximum(share * special.gpd_sf(x[deep] - threshold, scale, shape), np.finfo(float).tiny))
    return p


def transformed(p: Column, one_minus: bool = False, neg_log10: bool = False) -> Column:
    """p, 1 - p or -log10 p (infinite at 0)."""
    if one_minus and neg_log10:
        raise ValueError("choose one of 1 - p and -log10 p")
    if neg_log10:
        return F.when(p == 0, float("inf")).otherwise(-F.log10(p))
    return 1 - p if one_minus else p


def restored(p: Column, one_minus: bool = False, neg_log10: bool = False) -> Column:
    """p from its transform."""
    if one_minus and neg_log10:
        raise ValueError("choose one of 1 - p and -log10 p")
    return F.pow(F.lit(10.0), -p) if neg_log10 else 1 - p if one_minus else p


def with_double(shape: T.StructType, name: str) -> T.StructType:
    """A copy of the schema with one more column."""
    return T.StructType([*shape.fields, T.StructField(name, T.DoubleType())])
