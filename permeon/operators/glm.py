"""Mass-univariate statistics.

Two forms. Kernels take a block of features (samples x features) and serve Arrow batches; a user's callable has the same
signature: f(Y, M, C, groups) -> (statistic, df1, df2). Relational forms take long tables and stay in code generation.

For statistics with one variance, permuting and flipping leaves the residual sum of squares of the data and (M'M)+ as they are, so
all permutations of a block are one matrix product: permute the few weights, never the data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..design import contrast_rows, pinv_gram
from ..functions import special

TINY = float(np.finfo(np.float64).tiny)
FLOOR = 1e-12
Statistic = Callable[..., tuple[np.ndarray, object, object]]


def clean(x: np.ndarray) -> np.ndarray:
    """NaN to 0; infinities stay."""
    return np.where(np.isnan(x), 0.0, x)


def _ols(y: np.ndarray, m: np.ndarray, c: np.ndarray):
    p = pinv_gram(m)
    b = p @ (m.T @ y)
    rss = ((y - m @ b) ** 2).sum(0)
    return p, c @ b, rss


def t(y, m, c, groups=None):
    """Contrast t with n - k degrees of freedom."""
    c = contrast_rows(c)[:1]
    p, effect, rss = _ols(y, m, c)
    df = len(m) - m.shape[1]
    return clean(effect[0] / np.sqrt(max((c @ p @ c.T).item(), 0.0) * np.maximum(rss / df, TINY))), 1, df


def _explained(p: np.ndarray, c: np.ndarray, effect: np.ndarray) -> np.ndarray:
    return (effect * (np.linalg.pinv(c @ p @ c.T) @ effect)).sum(0)


def f(y, m, c, groups=None):
    """F of all contrast rows together; df1 is their rank, df2 is n - rank of the design."""
    c = contrast_rows(c)
    p, effect, rss = _ols(y, m, c)
    df1, df2 = int(np.linalg.matrix_rank(c)), len(m) - int(np.linalg.matrix_rank(m))
    return clean(_explained(p, c, effect) / df1 / np.maximum(rss / df2, TINY)), df1, df2


def pearson_r(y, m, c, groups=None):
    """Partial correlation."""
    c = contrast_rows(c)[:1]
    p, effect, rss = _ols(y, m, c)
    df = len(m) - m.shape[1]
    scale = df * max((c @ p @ c.T).item(), 0.0) * np.maximum(rss / df, TINY)
    with np.errstate(all="ignore"):
        return clean(effect[0] / np.sqrt(effect[0] ** 2 + scale)), 1, df


def r_squared(y, m, c, groups=None):
    """Partial coefficient of determination."""
    c = contrast_rows(c)
    p, effect, rss = _ols(y, m, c)
    df = len(m) - int(np.linalg.matrix_rank(m))
    ss = _explained(p, c, effect)
    with np.errstate(all="ignore"):
        out = ss / (ss + df * np.maximum(rss / df, TINY))
    return np.nan_to_num(out, nan=0.0, posinf=1.0, neginf=0.0), int(np.linalg.matrix_rank(c)), df


def _by_group(y: np.ndarray, m: np.ndarray, groups: np.ndarray):
    """Residual weights of each variance group (groups x features), their degrees of freedom, and sum W X'X by feature."""
    p = pinv_gram(m)
    b = p @ (m.T @ y)
    leverage = np.einsum("ij,jk,ik->i", m, p, m)
    r2 = (y - m @ b) ** 2
    d, rss, n, gram = [], [], [], []
    for g in np.unique(groups):
        own = groups == g
        d.append(max((1 - leverage[own]).sum(), FLOOR))
        rss.append(np.maximum(r2[own].sum(0), FLOOR))
        n.append(int(own.sum()))
        gram.append(m[own].T @ m[own])
    d, n = np.array(d), np.array(n)
    w = d[:, None] / np.stack(rss)
    a = np.einsum("gv,gij->vij", w, np.stack(gram))
    df2 = w.sum(0) ** 2 / (w**2 / d[:, None]).sum(0)
    return b, w, d, n, np.linalg.pinv(a), df2


def v(y, m, c, groups):
    """Aspin and Welch's v: a t with a variance for each group; degrees of freedom by feature."""
    c = contrast_rows(c)[0]
    b, _, _, _, inverse, df2 = _by_group(y, m, groups)
    return clean(c @ b / np.sqrt(np.maximum(np.einsum("i,vij,j->v", c, inverse, c), FLOOR))), 1, df2


def g(y, m, c, groups):
    """Welch's F for several contrast rows, a variance for each group."""
    c = contrast_rows(c)
    b, w, d, n, inverse, df2 = _by_group(y, m, groups)
    rank = int(np.linalg.matrix_rank(c))
    effect = (c @ b).T
    middle = np.linalg.pinv(np.einsum("ai,vij,bj->vab", c, inverse, c))
    num = np.einsum("va,vab,vb->v", effect, middle, effect)
    wf = w * n[:, None]
    spread = ((1 - wf / wf.sum(0)) ** 2 / d[:, None]).sum(0) / (rank * (rank + 2))
    return clean(num / rank / np.maximum(1 + 2 * (rank - 1) * spread, FLOOR)), rank, df2


def as_z(statistic: Statistic, kind: str, eps: float = special.EPS) -> Statistic:
    """The statistic as a z-score. kind: t, f, r or r2."""

    def z(y, m, c, groups=None):
        value, df1, df2 = statistic(y, m, c, groups)
        with np.errstate(all="ignore"):
            if kind == "t":
                return special.z_of_t(value, df2, eps), df1, df2
            if kind == "f":
                return special.z_of_f(value, df1, df2, eps), df1, df2
            return (np.arctanh(value) if kind == "r" else special.norm_ppf(value)), df1, df2

    return z


#: name to (statistic for one row, without and with variance groups; for an F-contrast; tags for output names; kinds for z)
REGISTRY = {
    "auto": {"t": (t, "tstat", "t"), "v": (v, "vstat", "t"), "f": (f, "fstat", "f"), "g": (g, "gstat", "f")},
    "pearson": {"t": (pearson_r, "rstat", "r"), "v": (pearson_r, "rstat", "r"), "f": (r_squared, "rsqstat", "r2"), "g": (r_squared, "rsqstat", "r2")},
}


def select(stat: str | Statistic, f_contrast: bool, groups: bool, zstat: bool = False) -> tuple[Statistic, str]:
    """The statistic and its tag."""
    if callable(stat):
        return stat, f"{getattr(stat, '__name__', 'x')}stat"
    if stat not in REGISTRY:
        raise ValueError(f"unknown statistic: {stat!r}")
    fn, tag, kind = REGISTRY[stat]["fg"[groups] if f_contrast else "tv"[groups]]
    return (as_z(fn, kind), "z" + tag) if zstat else (fn, tag)


class Permuted:
    """All permutations of a one-variance statistic on the partitioned model, one product a block of features.

    orders, flips: sequences of orders and of signs (applied before the order), or None. Their weights are made where they are used, and kept
    for the next block if all together take HELD bytes at most."""

    HELD = 64 << 20

    def __init__(self, name: str, of_interest: np.ndarray, nuisance: np.ndarray, orders, flips=None) -> None:
        self.m = np.hstack((of_interest, nuisance))
        self.name, self.p, self.q, self.k = name, pinv_gram(self.m), of_interest.shape[1], self.m.shape[1]
        self.n, self.rank = len(self.m), int(np.linalg.matrix_rank(self.m))
        self.orders, self.flips = orders, flips
        self.held: dict[tuple, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def weights(self, which: np.ndarray) -> np.ndarray:
        """Permutations x regressors x samples: what each sample meets after it is moved."""
        key = tuple(which.tolist())
        if (found := self.held.get(key)) is not None:
            return found
        out = np.empty((len(which), self.k, self.n))
        for w, p in zip(out, which.tolist()):
            w[:, self.orders[p]] = self.m.T
            if self.flips is not None:
                w *= self.flips[p]
        if len(self.orders) * self.k * self.n * 8 <= self.HELD:
            self.held[key] = out
        return out

    def at_rest(self, y: np.ndarray) -> np.ndarray:
        """Statistics of the data as they are, by the same arithmetic."""
        return self.of(y, self.m.T[None])[0]

    def __call__(self, y: np.ndarray, which: slice | np.ndarray) -> np.ndarray:
        """Statistics (permutations x features) of some permutations. y: residuals of the nuisance model."""
        which = np.arange(len(self.orders))[which] if isinstance(which, slice) else np.asarray(which)
        return self.of(y, self.weights(which))

    def of(self, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.of_products((weights.reshape(-1, self.n) @ y).reshape(len(weights), self.k, -1), (y * y).sum(0))

    def part(self, y: np.ndarray, places: np.ndarray, signs: np.ndarray | None = None) -> np.ndarray:
        """Products (permutations x regressors x features) over some of the samples, to be added up. y: their residuals; places: where each permutation
        puts them (permutations x samples); signs: theirs."""
        moved = self.m.T[:, places]  # regressors x permutations x samples
        if signs is not None:
            moved = moved * signs
        return (moved.reshape(-1, len(y)) @ y).reshape(*moved.shape[:2], -1).transpose(1, 0, 2)

    def of_products(self, my: np.ndarray, yy: np.ndarray) -> np.ndarray:
        """Statistics from the products of weights and data over all samples, and the data's sums of squares."""
        b = np.einsum("ij,pjv->piv", self.p, my)
        rss = np.maximum(yy - (b * my).sum(1), 0)
        effect, top = b[:, : self.q], self.p[: self.q, : self.q]
        if self.name in ("t", "pearson_r"):
            df = self.n - self.k
            scale = max(top[0, 0], 0.0) * np.maximum(rss / df, TINY)
            with np.errstate(all="ignore"):
                return clean(effect[:, 0] / np.sqrt(scale if self.name == "t" else effect[:, 0] ** 2 + df * scale))
        df1, df2 = self.q, self.n - self.rank
        ss = np.einsum("pav,ab,pbv->pv", effect, np.linalg.pinv(top), effect)
        mse = np.maximum(rss / df2, TINY)
        with np.errstate(all="ignore"):
            return clean(ss / df1 / mse) if self.name == "f" else np.nan_to_num(ss / (ss + df2 * mse), nan=0.0, posinf=1.0, neginf=0.0)


# Relational forms: long tables, code-generated. weights: sample_id and one column a regressor, from the driver.


def sums(obs: DataFrame, design: DataFrame, regressors: list[str], by: list[str]) -> DataFrame:
    """Cross-products X'y, X'X and y'y by key. The design is small: it is broadcast by its size."""
    j = obs.join(design, "sample_id")
    each = [F.sum(F.col("y") * F.col(x)).alias(f"{x}_y") for x in regressors]
    return j.groupBy(*by).agg(*each, F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("n"))


def t_from_correlation(df: DataFrame, n: str, sx: str, sxx: str, sy: str, syy: str, sxy: str, alias: str = "t") -> DataFrame:
    """t of a slope with an intercept, from plain sums; 0 where either side is constant."""
    cov = F.col(sxy) - F.col(sx) * F.col(sy) / F.col(n)
    vx, vy = F.col(sxx) - F.col(sx) * F.col(sx) / F.col(n), F.col(syy) - F.col(sy) * F.col(sy) / F.col(n)
    rss = F.greatest(vy - cov * cov / F.nullif(vx, F.lit(0.0)), F.lit(0.0))
    mse = F.greatest(rss / (F.col(n) - 2), F.lit(TINY))
    return df.withColumn(alias, F.coalesce(cov / F.nullif(vx, F.lit(0.0)) / F.nullif(F.sqrt(mse / F.nullif(vx, F.lit(0.0))), F.lit(0.0)), F.lit(0.0)))
