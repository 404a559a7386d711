"""Small linear algebra on the driver: everything here is samples x regressors or smaller, never feature data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinv_gram(x: np.ndarray) -> np.ndarray:
    """(X'X)+"""
    return np.linalg.pinv(x.T @ x)


def contrast_rows(contrast) -> np.ndarray:
    """A contrast as rows; one vector is one row."""
    c = np.atleast_2d(np.asarray(contrast, np.float64))
    if c.ndim > 2:
        raise ValueError("a contrast has one or two dimensions")
    return c


def partition_maps(gram: np.ndarray, contrast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beckmann's partition from X'X: the matrices that take X to its part of interest and to the nuisance, and the effective contrast."""
    c = contrast_rows(contrast).T
    u, s, _ = np.linalg.svd(c)
    rank = int((s > max(c.shape) * np.finfo(float).eps * (s[0] if len(s) else 0)).sum())
    rest = u[:, rank:]
    d = np.linalg.pinv(gram)
    k = np.linalg.pinv(c.T @ d @ c)
    rest = rest - c @ k @ c.T @ d @ rest
    nuisance = d @ rest @ np.linalg.pinv(rest.T @ d @ rest) if rest.shape[1] else np.empty((len(gram), 0))
    q = c.shape[1]
    return d @ c @ k, nuisance, np.hstack((np.eye(q), np.zeros((q, nuisance.shape[1]))))


def partition(x: np.ndarray, contrast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beckmann's partition: (X of interest, nuisance Z orthogonal to it, the effective contrast on [X | Z])."""
    of_interest, nuisance, effective = partition_maps(x.T @ x, contrast)
    return x @ of_interest, x @ nuisance, effective


def gram_of(design: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X of a design that is a table; only regressors x regressors numbers come to the driver."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = design.agg(*(F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs)).first()
    out = np.empty((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = sums[f"s{i}_{j}"] or 0.0
    return out


def pinv_gram_of(design: DataFrame, columns: list[str]) -> np.ndarray:
    """(X'X)+ of a design that is a table."""
    return np.linalg.pinv(gram_of(design, columns))


def combined(columns: list[str], weights: np.ndarray) -> list[Column]:
    """X times a matrix, column by column."""
    return [sum((F.col(c) * float(a) for c, a in zip(columns, w)), F.lit(0.0)) for w in weights.T]


def partitioned(design: DataFrame, columns: list[str], contrast) -> DataFrame:
    """The table with interest_0, .. and nuisance_0, .. of its design columns."""
    of_interest, nuisance, _ = partition_maps(gram_of(design, columns), contrast)
    named = [(f"{kind}_{i}", c) for kind, w in (("interest", of_interest), ("nuisance", nuisance)) for i, c in enumerate(combined(columns, w))]
    return design.select("*", *(c.alias(n) for n, c in named))


def demeaned(design: DataFrame, columns: list[str]) -> DataFrame:
    """The table's design columns without constant ones, those of more than two values centred; others stay."""
    told = design.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg)))).first()
    kept = [c for c in columns if told[f"lo_{c}"] != told[f"hi_{c}"]]
    third = design.agg(*(F.max((F.col(c) != told[f"lo_{c}"]) & (F.col(c) != told[f"hi_{c}"])).alias(c) for c in kept)).first() if kept else {}
    new = {c: (F.col(c) - told[f"mean_{c}"]).alias(c) if third[c] else F.col(c) for c in kept}
    return design.select(*(new.get(c, F.col(c)) for c in design.columns if c in new or c not in columns))


def trimmed(contrasts: DataFrame, design: DataFrame, columns: list[str]) -> DataFrame:
    """Contrast rows (label, regressor, weight) without constant regressors, and without rows that have no other weight left."""
    told = design.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))).first()
    kept = contrasts.where(F.col("regressor").isin([c for c in columns if told[f"lo_{c}"] != told[f"hi_{c}"]]))
    alive = kept.where("weight <> 0").select("label").distinct()
    return kept.join(alive, "label")


def hat(z: np.ndarray) -> np.ndarray:
    """Projection onto the columns of Z."""
    return z @ np.linalg.pinv(z) if z.shape[1] else np.zeros((len(z), len(z)))


def residualise(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, fitted values) of least squares on Z."""
    fitted = z @ np.linalg.lstsq(z, y, rcond=None)[0] if z.shape[1] else np.zeros_like(y)
    return y - fitted, fitted


def demean(x: np.ndarray, contrast, f_mask=None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Design, contrast and F mask after demeaning: constant columns go with their contrast entries, columns of more than two
    values are centred, contrast rows that are left without entries go; a mask of fewer than two rows is none."""
    x, c = np.asarray(x, np.float64), contrast_rows(contrast)
    keep = np.ptp(x, axis=0) != 0
    x, c = x[:, keep].copy(), c[:, keep]
    for j in range(x.shape[1]):
        if len(np.unique(x[:, j])) > 2:
            x[:, j] -= x[:, j].mean()
    alive = ~(c == 0).all(1)
    if f_mask is not None:
        f_mask = np.asarray(f_mask, bool)[alive]
        f_mask = f_mask if f_mask.sum() >= 2 else None
    return x, c[alive], f_mask
