"""Mass-univariate logistic regression and AUC, a block of outcomes at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..design import contrast_rows
from ..functions.special import expit, norm_sf


def wald(y: np.ndarray, x: np.ndarray, c, groups=None, l2: float = 1e-4, rounds: int = 15):
    """(z, 1, None) of a ridge logistic regression of each outcome; a statistic like those of operators.glm."""
    c, k = contrast_rows(c)[0], x.shape[1]
    b = np.zeros((y.shape[1], k))
    ridge = l2 * np.eye(k)
    hessian = lambda mu: np.einsum("ni,vn,nj->vij", x, np.clip(mu * (1 - mu), 1e-5, 1.0), x) + ridge
    for _ in range(rounds):
        mu = expit(b @ x.T)
        b = b + np.linalg.solve(hessian(mu), ((y.T - mu) @ x - l2 * b)[:, :, None])[:, :, 0]
    inverse = np.linalg.inv(hessian(expit(b @ x.T)))
    z = b @ c / np.sqrt(np.einsum("i,vij,j->v", c, inverse, c))
    return np.nan_to_num(z), 1, None


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, of, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[of]


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Mann-Whitney; 0.5 if a class is empty."""
    pos = float(y.sum())
    neg = len(y) - pos
    return 0.5 if pos <= 0 or neg <= 0 else float(((average_ranks(score) * y).sum() - pos * (pos + 1) / 2) / (pos * neg))


def irls(y: np.ndarray, x: np.ndarray, rounds: int = 100, tol: float = 1e-7, ridge: float = 1e-8, eps: float = 1e-9):
    """(coefficients, covariance or None) of one outcome."""
    b = np.zeros(x.shape[1])
    eye = ridge * np.eye(x.shape[1])
    information = lambda mu: x.T @ (x * np.maximum(mu * (1 - mu), eps)[:, None]) + eye
    for _ in range(rounds):
        mu = expit(x @ b)
        step = np.linalg.solve(information(mu), x.T @ (y - mu))
        if not np.isfinite(step).all():
            return b, None
        b = b + step
        if np.abs(step).sum() <= tol:
            break
    h = information(expit(x @ b))
    if not (np.isfinite(h).all() and (np.linalg.eigvalsh(h) > eps).all()):
        return b, None
    return b, np.linalg.inv(h)


def regression(outcomes: DataFrame, design: np.ndarray, contrast, calculate_auc: bool = True, **settings) -> DataFrame:
    """feature_id, contrast (c1, ..), zstat, pval[, auc]; NaN where a fit fails. outcomes: feature_id, y array of 0 and 1.
    The AUC is that of the columns that the contrast row uses."""
    rows = contrast_rows(contrast)

    def run(frames):
        for f in frames:
            out = []
            for i, y in zip(f["feature_id"], f["y"]):
                y = np.asarray(y, np.float64)
                b, cov = irls(y, design, **settings)
                for j, c in enumerate(rows):
                    z = c @ b / np.sqrt(c @ cov @ c) if cov is not None and c @ cov @ c > 0 else np.nan
                    p = 2 * float(norm_sf(np.abs(z))) if np.isfinite(z) else np.nan
                    area = auc(y, expit(design @ np.where(c != 0, b, 0))) if calculate_auc and cov is not None else np.nan
                    out.append((i, f"c{j + 1}", float(z), p, area))
            yield pd.DataFrame(out, columns=["feature_id", "contrast", "zstat", "pval", "auc"])

    return outcomes.select("feature_id", "y").mapInPandas(run, "feature_id bigint, contrast string, zstat double, pval double, auc double")


def auc_by_rank(scores: DataFrame, by: list[str]) -> DataFrame:
    """(*by, auc) natively. scores: *by, y (0 or 1), score."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy("score")) + (F.count("*").over(Window.partitionBy(*by, "score")) - 1) / F.lit(2.0)
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    area = (F.sum(F.col("rank") * F.col("y")) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))
    return scores.withColumn("rank", rank).groupBy(*by).agg(F.coalesce(area, F.lit(0.5)).alias("auc"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(*by, rho): Pearson's r of average ranks."""
    from .similarity import pearson

    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / F.lit(2.0)
    return df.withColumn("rx", rank(x)).withColumn("ry", rank(y)).groupBy(*by).agg(pearson(F.col("rx"), F.col("ry")).alias("rho"))


def zscore(df: DataFrame, value: str, by: list[str], alias: str = "z") -> DataFrame:
    """Standardised by population deviation; 0 where it is 0."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(stats, by).withColumn(alias, F.coalesce((F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0))).drop("_m", "_s")


def cohen_d(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """(*by, d): difference of the means of group 1 and 0 in pooled standard deviations."""
    m = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    n1, n0, v1, v0 = m(1, F.count), m(0, F.count), m(1, F.var_samp), m(0, F.var_samp)
    pooled = F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / F.nullif(n1 + n0 - 2, F.lit(0)))
    return df.groupBy(*by).agg(F.coalesce((m(1, F.avg) - m(0, F.avg)) / F.nullif(pooled, F.lit(0.0)), F.lit(0.0)).alias("d"))
