"""Similarity of statistic maps, with p-values from permuted maps.

Datasets are joined by feature once; each block of features then makes the permuted maps of all of them and returns the sums that a
correlation needs, for each permutation and pair, so maps are never shuffled. A caller's comparison needs whole vectors: for that the maps
meet by permutation. Observed maps come from the same arithmetic as permuted ones, so permutations that move nothing count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import infer
from .infer import with_double

SUMS = ("n", "sx", "sxx", "sy", "syy", "sxy")


def from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r; 0 where a side is constant."""
    scale = F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * syy - sy * sy, F.lit(0.0)))
    return F.coalesce((n * sxy - sx * sy) / F.nullif(scale, F.lit(0.0)), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate."""
    return from_sums(F.count("*"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))


def pairs(maps: DataFrame, refs: DataFrame | None = None, by: tuple[str, ...] = (), compare: Callable | None = None) -> DataFrame:
    """(*by, a, b, r) for datasets a < b, or datasets a and references b. maps: *by, ds, feature_id, value; refs: ref_id,
    feature_id, value. compare: f(vector, vector) -> float instead of Pearson's r; taken as symmetric."""
    left = maps.select(*by, F.col("ds").alias("a"), "feature_id", F.col("value").alias("x"))
    if refs is None:
        right = maps.select(*by, F.col("ds").alias("b"), "feature_id", F.col("value").alias("y"))
        joined = left.join(right, [*by, "feature_id"]).where("a < b")
    else:
        joined = left.join(refs.select(F.col("ref_id").alias("b"), "feature_id", F.col("value").alias("y")), "feature_id")
    if compare is None:
        return joined.groupBy(*by, "a", "b").agg(pearson(F.col("x"), F.col("y")).alias("r"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("feature_id")
        r = float(compare(f["x"].to_numpy(), f["y"].to_numpy()))
        return f.iloc[:1][[*by, "a", "b"]].assign(r=0.0 if np.isnan(r) else r)

    shape = with_double(joined.select(*by, "a", "b").schema, "r")
    return joined.select(*by, "a", "b", "feature_id", "x", "y").groupBy(*by, "a", "b").applyInPandas(run, shape)


def with_p(found: DataFrame, two_tailed: bool = True, tail: str | None = None) -> DataFrame:
    """(a, b, r, p). found: perm_id (-1: observed), a, b, r. tail: fit the null's tail, pair by pair, where its values are: one number a
    permutation."""
    held = found.groupBy("a", "b").agg(F.max(F.when(F.col("perm_id") < 0, F.col("r"))).alias("r"), F.collect_list(F.when(F.col("perm_id") >= 0, F.col("r"))).alias("null"))

    def run(frames):
        for f in frames:
            p = []
            for r, null in zip(f["r"], f["null"]):
                null = np.sort(np.abs(null) if two_tailed else np.asarray(null, float))
                p.append(infer.tail_p(np.array([abs(r) if two_tailed else r]), null, infer.fit_tail(null, tail) if tail else None)[0])
            yield f[["a", "b", "r"]].assign(p=p)

    return held.mapInPandas(run, with_double(found.select("a", "b", "r").schema, "p"))


def block_sums(datasets: list[tuple[str, object]], count: int, label: str | None):
    """For each permutation (-1: as they are) and pair, the sums over a block's features. datasets: name, broadcast tasks."""

    def frame(perm: np.ndarray, names: tuple[str, str], x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        """x: permutations x features; y the same, or one map for all."""
        y = np.broadcast_to(y, x.shape)
        return pd.DataFrame({"perm_id": perm, "a": names[0], "b": names[1], "n": float(x.shape[1]), "sx": x.sum(1), "sxx": (x * x).sum(1), "sy": y.sum(1), "syy": (y * y).sum(1), "sxy": (x * y).sum(1)})

    def run(frames):
        from ..plans.analysis import prepared

        for f in frames:
            if not len(f):
                continue
            refs = {}
            if "refs" in f:
                refs = {r["ref_id"]: np.array([row[i]["value"] for row in f["refs"]]) for i, r in enumerate(f["refs"].iloc[0])}
            moving = []
            for i, (_, held) in enumerate(datasets):
                tasks, demean = held.value
                task = tasks[0] if label is None else next(t for t in tasks if t.label == label)
                y = prepared(demean, f[f"y{i}"])
                moving.append((task.at_rest(y), task.null(y, np.arange(count))))
            yield from compared(np.array([-1]), [x[None] for x, _ in moving], refs)
            for chunk in zip(*(null for _, null in moving)):
                yield from compared(chunk[0][0], [x for _, x in chunk], refs)

    def compared(perm: np.ndarray, maps: list[np.ndarray], refs: dict[str, np.ndarray]):
        for i, (name, _) in enumerate(datasets):
            for j in range(len(datasets)):
                if name < datasets[j][0]:
                    yield frame(perm, (name, datasets[j][0]), maps[i], maps[j]).assign(kind="ds")
            for ref, value in refs.items():
                yield frame(perm, (name, ref), maps[i], value[None]).assign(kind="ref")

    return run


def similarity_analysis(datasets: dict[str, tuple[DataFrame, object]], refs: DataFrame | None = None, two_tailed: bool = True, compare: Callable | None = None, accel_tail: bool = False, contrast: str | None = None) -> dict[str, DataFrame | None]:
    """datasets: name to (features, AnalysisSpec). Returns ds_ds and ds_ref (a, b, r, p) and their nulls (perm_id, a, b, r); None
    where there is nothing to compare. Each dataset is permuted by itself; as many permutations count as the least dataset has."""
    from ..plans.analysis import permuted_blocks, plan, shared

    if not datasets:
        raise ValueError("similarity needs a dataset")
    sizes = {k: f.count() for k, (f, _) in datasets.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"datasets differ in their number of features: {sizes}")
    if refs is not None:
        size = next(iter(sizes.values()))
        held = refs.groupBy("ref_id").agg(F.count("*").alias("n"), F.countDistinct("feature_id").alias("d"))
        odd = held.where((F.col("n") != size) | (F.col("d") != size)).limit(5).collect()
        if odd:
            raise ValueError(f"references that don't have the datasets' {size} features: { {r['ref_id']: r['n'] for r in odd} }")
    count = min(s.permutations for _, s in datasets.values())
    tail = "MOM" if accel_tail else None
    if compare is None:
        rows = None
        for i, (features, _) in enumerate(datasets.values()):
            own = features.select("feature_id", F.col("y").alias(f"y{i}"))
            rows = own if rows is None else rows.join(own, "feature_id")
        if refs is not None:
            of = refs.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("ref_id", F.col("value").cast("double").alias("value")))).alias("refs"))
            rows = rows.join(of, "feature_id")
        spark = rows.sparkSession
        held = [(name, shared(spark, plan(s), s)) for name, (_, s) in datasets.items()]
        sums = rows.mapInPandas(block_sums(held, count, contrast), "perm_id int, a string, b string, n double, sx double, sxx double, sy double, syy double, sxy double, kind string")
        sums = sums.groupBy("kind", "perm_id", "a", "b").agg(*(F.sum(c).alias(c) for c in SUMS))
        found = sums.select("kind", "perm_id", "a", "b", from_sums(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).alias("r"))
        kinds = {k: found.where(F.col("kind") == k).drop("kind") for k in ("ds", "ref")}
    else:
        maps = None
        for name, (features, spec) in datasets.items():
            label = contrast or next(iter(spec.labels()))
            own = permuted_blocks(features, spec, rest=True).where((F.col("contrast") == label) & (F.col("perm_id") < count))
            own = own.select("perm_id", F.lit(name).alias("ds"), F.explode(F.arrays_zip("feature_ids", "stats")).alias("s"))
            own = own.select("perm_id", "ds", F.col("s.feature_ids").alias("feature_id"), F.col("s.stats").alias("value"))
            maps = own if maps is None else maps.unionByName(own)
        kinds = {"ds": pairs(maps, None, ("perm_id",), compare), "ref": None if refs is None else pairs(maps, refs, ("perm_id",), compare)}
    out: dict[str, DataFrame | None] = dict.fromkeys(("ds_ds", "ds_ref", "null_ds_ds", "null_ds_ref"))
    for name, kind, wanted in (("ds_ds", "ds", len(datasets) > 1), ("ds_ref", "ref", refs is not None)):
        if wanted:
            out[name], out[f"null_{name}"] = with_p(kinds[kind], two_tailed, tail), kinds[kind].where("perm_id >= 0")
    return out


def matrix(found: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(r with a diagonal of 1, p with a diagonal of NaN) of dataset pairs."""
    r, p = np.eye(len(names)), np.full((len(names), len(names)), np.nan)
    for row in found.collect():
        i, j = names.index(row["a"]), names.index(row["b"])
        r[i, j] = r[j, i] = row["r"]
        p[i, j] = p[j, i] = row["p"]
    return r, p
