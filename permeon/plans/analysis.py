"""Permutation analysis of a samples x features table, in one pass over the features.

The driver plans: partitions of the model, and the keys from which any task makes any order and its signs by itself, so what travels is
samples x regressors numbers however many permutations there are (as a broadcast; a row of features holds as many samples). Features
come as rows with their samples as an array; each Arrow batch is a block of features. A block returns its observed statistics and
exceedance counts, and for every permutation its largest statistic; maxima meet in a grouped maximum of permutations x blocks rows. Nothing
else is shuffled, and no feature data reach the driver.

A table with more than TALL samples, and no fewer than features, is cut along its samples too: each order is made once, by one task, and its
parts meet the same samples' residuals, whose products with the permuted model are then added up (tall_partials).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import design as algebra
from .. import exchange
from ..operators import glm, infer
from ..spec import AnalysisSpec

#: Permutations that are held at once as permutations x features of a block.
CHUNK = 64
#: Bytes of data, and of weights, that a block works on at a time.
HELD = 8 << 20
#: Samples above which a table is cut along them; samples of a part (fewer if there are very many permutations) and features of a group.
TALL, PART, GROUP = 16_384, 8_192, 128
PARTIALS = "kind string, contrast string, id bigint, stat double, exceed bigint"


@dataclass
class Task:
    """What a block of features needs for one contrast."""

    label: str
    model: np.ndarray
    contrast: np.ndarray
    nuisance: np.ndarray
    statistic: glm.Statistic
    groups: np.ndarray | None
    two_tailed: bool
    orders: object
    flips: object
    permuted: glm.Permuted | None

    def fold(self, x: np.ndarray) -> np.ndarray:
        return np.abs(x) if self.two_tailed else x

    def observed(self, y: np.ndarray) -> np.ndarray:
        return np.ravel(self.statistic(y, self.model, self.contrast, self.groups)[0])

    def at_rest(self, y: np.ndarray) -> np.ndarray:
        """The observed statistics, by the same arithmetic as the null where there is one."""
        return self.observed(y) if self.permuted is None else self.permuted.at_rest(algebra.residualise(y, self.nuisance)[0])

    def null(self, y: np.ndarray, only: np.ndarray | None = None):
        """(permutation numbers, statistics) by chunks; only: of these permutations."""
        residual, fitted = algebra.residualise(y, self.nuisance)
        every = np.arange(len(self.orders)) if only is None else only
        step = max(1, min(CHUNK, HELD // (8 * self.model.size)))
        for lo in range(0, len(every), step):
            which = every[lo : lo + step]
            if self.permuted is not None:
                yield which, self.permuted(residual, which)
                continue
            rows = []
            for i in which.tolist():
                e = residual if self.flips is None else residual * self.flips[i][:, None]
                rows.append(self.observed(e[self.orders[i]] + fitted))
            yield which, np.stack(rows)

    def counted(self, y: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Exceedances of each feature, and the largest statistic of each permutation."""
        return self.reached(self.fold(self.at_rest(y)), (values for _, values in self.null(y, only)))

    def reached(self, seen: np.ndarray, null) -> tuple[np.ndarray, np.ndarray]:
        """The same of folded observed statistics and chunks of the null's."""
        count, level, maxima = np.zeros(len(seen), np.int64), None, []
        for values in null:
            values = self.fold(values)
            bare = np.where(np.isnan(values), -np.inf, values)
            if level is None:
                level = infer.tied(seen, np.where(np.isfinite(bare), np.abs(bare), 0).max(0))
            count += (bare >= level).sum(0)
            maxima.append(bare.max(1))
        return count, np.concatenate(maxima) if maxima else np.empty(0)


def plan(spec: AnalysisSpec) -> list[Task]:
    x, rows, groups = spec.design, spec.labels(), spec.groups()
    if spec.demean:
        rows = {k: algebra.demean(x, c)[1] for k, c in rows.items()}
        x = algebra.demean(x, spec.contrast)[0]
        rows = {k: c for k, c in rows.items() if len(c) and not (k == "f" and len(c) < 2)}
    out = []
    for i, (label, c) in enumerate(rows.items()):
        of_interest, nuisance, effective = algebra.partition(x, c)
        is_f = label == "f"
        statistic, _ = glm.select(spec.f_stat if is_f else spec.stat, is_f, groups is not None, spec.zstat)
        n = len(x)
        orders = spec.orders if spec.orders is not None else exchange.Orders(n, spec.permutations, spec.exchangeability, spec.within, spec.whole, spec.seed, stream=2 * i)
        flips = None
        if spec.flip_signs:
            by = np.abs(spec.exchangeability if np.ndim(spec.exchangeability) == 1 else spec.exchangeability[:, 0]) if spec.whole and spec.exchangeability is not None else None
            flips = exchange.Signs(n, len(orders), by, spec.seed, stream=2 * i + 1)
        name = {glm.t: "t", glm.f: "f", glm.pearson_r: "pearson_r", glm.r_squared: "r_squared"}.get(statistic)
        permuted = glm.Permuted(name, of_interest, nuisance, orders, flips) if name else None
        out.append(Task(label, np.hstack((of_interest, nuisance)), effective, nuisance, statistic, groups, spec.two_tailed and not is_f, orders, flips, permuted))
    return out


def prepared(demean: bool, y) -> np.ndarray:
    """Samples x features of an Arrow batch's column of arrays."""
    y = np.stack(y.to_numpy()).T.astype(np.float64, copy=False)
    return y - y.mean(0) if demean else y


def feature_blocks(frames, demean: bool):
    """(feature_id, samples x features) of Arrow batches, HELD bytes or one feature at a time."""
    for f in frames:
        each = max(1, HELD // (8 * max(1, len(f["y"].iloc[0])))) if len(f) else 1
        for lo in range(0, len(f), each):
            own = f.iloc[lo : lo + each]
            yield own["feature_id"].to_numpy(), prepared(demean, own["y"])


class Shared:
    """Something for all tasks, functions of the caller's included, so that closures hold no more than a reference."""

    loaded: dict[int, object] = {}

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.pickled = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.number = uuid.uuid4().int

    @property
    def value(self):
        """Unpickled once a worker; the last few are kept."""
        if self.number not in self.loaded:
            while len(self.loaded) >= 4:
                self.loaded.pop(next(iter(self.loaded)))
            self.loaded[self.number] = cloudpickle.loads(self.pickled.value)
        return self.loaded[self.number]


def shared(spark: SparkSession, tasks: list[Task], spec: AnalysisSpec) -> Shared:
    return Shared(spark, (tasks, spec.demean))


def block_partials(held: Shared, only: tuple[int, ...] | range | None = None):
    """Exceedances and maxima of a block; only: of these permutations."""

    def run(frames):
        tasks, demean = held.value
        for ids, y in feature_blocks(frames, demean):
            for task in tasks:
                which = np.arange(len(task.orders)) if only is None else np.array(only, np.int64)
                count, maxima = task.counted(y, which)
                yield pd.DataFrame({"kind": "feature", "contrast": task.label, "id": ids, "stat": task.observed(y), "exceed": count})
                yield pd.DataFrame({"kind": "max", "contrast": task.label, "id": which, "stat": maxima, "exceed": 0})

    return run


def tall_partials(features: DataFrame, tasks: list[Task], held: Shared, only: tuple[int, ...] | range | None, width: int) -> DataFrame:
    """The same for one-variance statistics of tables with many samples. A task fits whole features and cuts their residuals into parts of the
    samples; another makes a permutation's order and cuts it likewise. Where both meet, GROUP features or so and one part of the samples are
    multiplied for all permutations; the products are added up over the parts, CHUNK permutations at a time. width: the number of features."""
    spark, which = features.sparkSession, range(len(tasks[0].orders)) if only is None else only
    n, groups = len(tasks[0].model), -(-width // GROUP)
    size = min(PART, max(512, (1 << 23) // max(1, len(which))))
    parts = range(-(-n // size))

    def fits(frames):
        tasks, demean = held.value
        for f in frames:
            for group, own in f.groupby("group"):
                for ids, y in feature_blocks([own], demean):
                    for at, task in enumerate(tasks):
                        e = algebra.residualise(y, task.nuisance)[0]
                        seen = np.stack((task.observed(y), task.permuted.at_rest(e), (e * e).sum(0))).tobytes()
                        for part in parts:
                            yield pd.DataFrame({"task": at, "group": group, "part": part, "ids": [ids.astype("<i8").tobytes()], "e": [e[part * size : (part + 1) * size].tobytes()], "seen": [seen]})

    def drawn(frames):
        tasks = held.value[0]
        for f in frames:
            for i in f["id"].tolist():
                for at, task in enumerate(tasks):
                    places = np.empty(n, np.int32)
                    places[task.orders[which[i]]] = np.arange(n, dtype=np.int32)
                    signs = None if task.flips is None else task.flips[which[i]].astype(np.int8)
                    cut = lambda x: [None if x is None else x[p * size : (p + 1) * size].tobytes() for p in parts]
                    yield pd.DataFrame({"task": at, "part": parts, "at": i, "places": cut(places), "signs": cut(signs)})

    def products(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"task": [], "group": [], "part": [], "chunk": [], "ids": [], "seen": [], "my": []})
        task, ids = held.value[0][key[0]], [np.frombuffer(b, "<i8") for b in left["ids"]]
        y = np.concatenate([np.frombuffer(b).reshape(-1, len(i)) for i, b in zip(ids, left["e"])], 1)
        seen = np.concatenate([np.frombuffer(b).reshape(3, -1) for b in left["seen"]], 1)
        ids = np.concatenate(ids)
        by = np.argsort(ids)
        y, right = np.ascontiguousarray(y[:, by]), right.sort_values("at")
        step, out = max(1, min(CHUNK, HELD // (8 * len(y) * task.permuted.k))), []
        for chunk, own in right.groupby(right["at"] // CHUNK):
            my = []
            for lo in range(0, len(own), step):
                places = np.stack([np.frombuffer(b, np.int32) for b in own["places"].iloc[lo : lo + step]])
                signs = None if task.flips is None else np.stack([np.frombuffer(b, np.int8) for b in own["signs"].iloc[lo : lo + step]])
                my.append(task.permuted.part(y, places, signs))
            out.append((*key, chunk, ids[by].tobytes(), seen[:, by].tobytes(), np.concatenate(my).tobytes()))
        return pd.DataFrame(out, columns=["task", "group", "part", "chunk", "ids", "seen", "my"])

    def counted(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        task, f = held.value[0][key[0]], f.sort_values("part")
        ids, seen = np.frombuffer(f["ids"].iloc[0], "<i8"), np.frombuffer(f["seen"].iloc[0]).reshape(3, -1)
        my = sum(np.frombuffer(b) for b in f["my"]).reshape(-1, task.permuted.k, len(ids))
        count, maxima = task.reached(task.fold(seen[1]), [task.permuted.of_products(my, seen[2])])
        perms = [which[i] for i in range(key[2] * CHUNK, key[2] * CHUNK + len(my))]
        found = pd.DataFrame({"kind": "feature", "contrast": task.label, "id": ids, "stat": seen[0], "exceed": count})
        return pd.concat((found, pd.DataFrame({"kind": "max", "contrast": task.label, "id": perms, "stat": maxima, "exceed": 0})))

    grouped = features.select(F.pmod(F.xxhash64("feature_id"), F.lit(groups)).cast("int").alias("group"), "feature_id", "y")
    residuals = grouped.mapInPandas(fits, "task int, group int, part int, ids binary, e binary, seen binary")
    orders = spark.range(len(which)).mapInPandas(drawn, "task int, part int, at int, places binary, signs binary")
    orders = orders.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["task", "group", "part"]
    met = residuals.groupBy(*keys).cogroup(orders.groupBy(*keys)).applyInPandas(products, "task int, group int, part int, chunk int, ids binary, seen binary, my binary")
    found = met.groupBy("task", "group", "chunk").applyInPandas(counted, PARTIALS)
    return found.groupBy("kind", "contrast", "id").agg(F.max("stat").alias("stat"), F.sum("exceed").alias("exceed"))


def partials_of(features: DataFrame, tasks: list[Task], held: Shared, only: tuple[int, ...] | range | None = None) -> DataFrame:
    """Observed statistics and exceedances of each feature, and the largest statistic of each permutation and block."""
    features, n = features.select("feature_id", "y"), len(tasks[0].model)
    if n > TALL and all(t.permuted is not None for t in tasks) and 0 < (width := features.count()) <= n:
        return tall_partials(features, tasks, held, only, width)
    return features.mapInPandas(block_partials(held, only), PARTIALS)


@dataclass
class Result:
    """features: contrast, feature_id, stat, exceed, uncp, fdrp, fwep[, cfdrp, cfwep]. maxima: contrast, perm_id, max_stat. tfce: is this
    of enhanced maps. release() gives up what the executors keep for it."""

    features: DataFrame
    maxima: DataFrame
    tags: dict[str, str]
    tfce: bool = False
    kept: DataFrame | None = None

    def release(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()

    def measures(self) -> DataFrame:
        """Long form: contrast, measure, feature_id, value."""
        names = [c for c in self.features.columns if c not in ("contrast", "feature_id", "exceed")]
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in names)))
        return self.features.select("contrast", "feature_id", pairs.alias("m")).select("contrast", "m.measure", "feature_id", "m.value")


def to_features(obs: DataFrame) -> DataFrame:
    """obs (sample_id, feature_id, y) to (feature_id, y array in sample order)."""
    pairs = F.array_sort(F.collect_list(F.struct("sample_id", "y")))
    return obs.groupBy("feature_id").agg(pairs.alias("p")).select("feature_id", F.transform("p", lambda s: s["y"].cast("double")).alias("y"))


def freedman_lane(features: DataFrame, nuisance: np.ndarray, perms: DataFrame) -> DataFrame:
    """Permuted data: residuals of the nuisance model in each order, on its fitted values. perms: (perm_id, pos, src) of samples.
    (perm_id, feature_id, pos array, y array), both in sample order. Orders are broadcast: samples x permutations numbers."""

    def fits(frames):
        for f in frames:
            residual, fitted = algebra.residualise(np.stack(f["y"].to_numpy()).T, nuisance)
            yield pd.DataFrame({"feature_id": f["feature_id"], "residual": list(residual.T), "fitted": list(fitted.T)})

    def places(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        pos = f["pos"].to_numpy()
        return pd.DataFrame({"perm_id": f["perm_id"].iloc[:1], "pos": [pos], "src": [np.searchsorted(pos, f["src"].to_numpy())]})

    models = features.select("feature_id", "y").mapInPandas(fits, "feature_id long, residual array<double>, fitted array<double>")
    orders = perms.groupBy("perm_id").applyInPandas(places, "perm_id int, pos array<long>, src array<int>")
    moved = F.transform("src", lambda i: F.get("residual", i))
    return models.crossJoin(F.broadcast(orders)).select("perm_id", "feature_id", "pos", F.zip_with(moved, "fitted", lambda e, fit: e + fit).alias("y"))


def maxima_of(partials: DataFrame) -> DataFrame:
    """contrast, perm_id, max_stat."""
    return partials.where("kind = 'max'").groupBy("contrast", F.col("id").alias("perm_id")).agg(F.max("stat").alias("max_stat"))


def corrected(counts: DataFrame, maxima: DataFrame, two_tailed: dict[str, bool], spec: AnalysisSpec, count: int) -> DataFrame:
    """counts (contrast, feature_id, stat, exceed) with its p-values."""
    null = infer.sorted_maxima(maxima)
    out = infer.fdr(counts, count, ["contrast"]).withColumn("uncp", infer.uncorrected(F.col("exceed"), count))
    tail = spec.accel_method if spec.accel_tail else None
    out = infer.fwe(out, null, two_tailed, tail, seed=spec.seed or 0)
    names = ["uncp", "fdrp", "fwep"]
    if spec.across_contrasts:
        pooled = maxima.groupBy("perm_id").agg(F.max("max_stat").alias("max_stat")).withColumn("contrast", F.lit("all"))
        every = infer.sorted_maxima(pooled)["all"]
        out = infer.fdr(out, count, [], alias="cfdrp")
        out = infer.fwe(out, dict.fromkeys(two_tailed, every), two_tailed, tail, alias="cfwep", seed=spec.seed or 0)
        names += ["cfdrp", "cfwep"]
    p = [infer.transformed(F.col(c), spec.one_minus_p, spec.neg_log10_p).alias(c) for c in names]
    return out.select("contrast", "feature_id", "stat", "exceed", *p)


def tags_of(tasks: list[Task], spec: AnalysisSpec) -> dict[str, str]:
    groups = spec.groups() is not None
    return {t.label: glm.select(spec.f_stat if t.label == "f" else spec.stat, t.label == "f", groups, spec.zstat)[1] for t in tasks}


def contrasts(spec: AnalysisSpec) -> list[Task]:
    tasks = plan(spec)
    if not tasks:
        raise ValueError("no contrast is left")
    return tasks


def permutation_analysis(features: DataFrame, spec: AnalysisSpec) -> Result:
    """features: (feature_id, y array in the order of the design's rows)."""
    tasks = contrasts(spec)
    partials = partials_of(features, tasks, shared(features.sparkSession, tasks, spec)).persist()
    counts = partials.where("kind = 'feature'").select("contrast", F.col("id").alias("feature_id"), "stat", "exceed")
    maxima = maxima_of(partials)
    out = corrected(counts, maxima, {t.label: t.two_tailed for t in tasks}, spec, len(tasks[0].orders))
    return Result(out, maxima, tags_of(tasks, spec), kept=partials)


def observed_statistics(features: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """contrast, feature_id, stat of the data as they are: a map over the features."""
    held = shared(features.sparkSession, plan(replace(spec, permutations=1, orders=None)), spec)

    def run(frames):
        tasks, demean = held.value
        for ids, y in feature_blocks(frames, demean):
            for task in tasks:
                yield pd.DataFrame({"contrast": task.label, "feature_id": ids, "stat": task.observed(y)})

    return features.select("feature_id", "y").mapInPandas(run, "contrast string, feature_id bigint, stat double")


def permuted_blocks(features: DataFrame, spec: AnalysisSpec, rest: bool = False, only: range | None = None) -> DataFrame:
    """contrast, perm_id, feature_ids, stats: the whole cube, a row for each block of features and permutation. rest: and the statistics of
    the data as they are, as permutation -1. only: of these permutations."""
    held = shared(features.sparkSession, plan(spec), spec)

    def run(frames):
        tasks, demean = held.value
        for ids, y in feature_blocks(frames, demean):
            for task in tasks:
                if rest:
                    yield pd.DataFrame({"contrast": task.label, "perm_id": [-1], "feature_ids": [ids], "stats": [task.at_rest(y)]})
                for which, values in task.null(y, None if only is None else np.array(only, np.int64)):
                    yield pd.DataFrame({"contrast": task.label, "perm_id": which, "feature_ids": [ids] * len(which), "stats": list(values)})

    return features.select("feature_id", "y").mapInPandas(run, "contrast string, perm_id int, feature_ids array<bigint>, stats array<double>")


def permuted_statistics(features: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """contrast, perm_id, feature_id, stat: the whole cube in rows, for those who ask for it."""
    rows = permuted_blocks(features, spec).select("contrast", "perm_id", F.explode(F.arrays_zip("feature_ids", "stats")).alias("s"))
    return rows.select("contrast", "perm_id", F.col("s.feature_ids").alias("feature_id"), F.col("s.stats").alias("stat"))


def permuted_indices(spark: SparkSession, spec: AnalysisSpec) -> DataFrame:
    """contrast, perm_id, pos, src: the very orders that the analysis uses, each made in a task."""
    tasks = plan(spec)
    held = shared(spark, tasks, spec)

    def run(frames):
        for f in frames:
            for p in f["id"].tolist():
                for task in held.value[0]:
                    order = task.orders[p]
                    yield pd.DataFrame({"contrast": task.label, "perm_id": p, "pos": np.arange(len(order)), "src": order})

    return spark.range(len(tasks[0].orders) if tasks else 0).mapInPandas(run, "contrast string, perm_id int, pos int, src int")
