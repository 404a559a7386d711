"""Analyses that can be stopped and continued: partial results of ranges of permutations, each in a folder of its own.

A partial result is a count of exceedances for each feature and a maximum for each permutation; both merge by sums and unions, in any
order. A range is written by a Spark job and counts once its marker is there, so a job that was killed, or that runs twice, adds nothing:
a new one writes what is missing. A manifest says what analysis the folder belongs to.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import infer
from ..spec import AnalysisSpec
from . import analysis

MARKER = "_SUCCESS"


def fingerprint(spec: AnalysisSpec) -> str:
    """What makes analyses the same: settings, orders and functions by their names."""
    told = {}
    for name, value in vars(spec).items():
        if name == "orders" and value is not None:
            value = [np.asarray(value[p]).tolist() for p in range(min(len(value), 3))]
        told[name] = value.tolist() if isinstance(value, np.ndarray) else getattr(value, "__qualname__", value)
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


class Partials:
    """Partial results under a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str, spec: AnalysisSpec) -> None:
        from ..sources import loaders, sinks

        self.spark, self.folder = spark, folder
        self.files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        manifest, own = f"{folder}/manifest.json", fingerprint(spec)
        if self.there(manifest):
            if json.loads(loaders.read_bytes(spark, manifest))["analysis"] != own:
                raise ValueError(f"{folder} holds another analysis")
        else:
            sinks.put(spark, manifest, json.dumps({"analysis": own}).encode())

    def there(self, path: str) -> bool:
        return self.files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def path(self, name: str) -> str:
        return f"{self.folder}/part-{name}"

    def done(self, name: str) -> bool:
        return self.there(f"{self.path(name)}/{MARKER}")

    def names(self) -> list[str]:
        """What is complete."""
        if not self.there(self.folder):
            return []
        found = [s.getPath().getName() for s in self.files.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder))]
        return sorted(n.removeprefix("part-") for n in found if n.startswith("part-") and self.done(n.removeprefix("part-")))

    def put(self, name: str, partials: DataFrame) -> None:
        partials.write.mode("overwrite").parquet(self.path(name))

    def read(self, but: str | None = None) -> DataFrame:
        paths = [self.path(n) for n in self.names() if n != but]
        empty = self.spark.createDataFrame([], analysis.PARTIALS)
        return self.spark.read.schema(analysis.PARTIALS).parquet(*paths) if paths else empty

    def counts(self) -> DataFrame:
        """contrast, feature_id, stat, exceed over all that is complete."""
        rows = self.read().where("kind = 'feature'").groupBy("contrast", F.col("id").alias("feature_id"))
        return rows.agg(F.first("stat").alias("stat"), F.sum("exceed").alias("exceed"))

    def permutations(self, but: str | None = None) -> list[int]:
        """The numbers of the permutations that are counted."""
        return sorted(r[0] for r in self.read(but).where("kind = 'max'").select("id").distinct().collect())

    def p_values(self) -> DataFrame:
        """contrast, feature_id, done, exceed, uncp so far."""
        n = len(self.permutations())
        return self.counts().select("contrast", "feature_id", F.lit(n).cast("long").alias("done"), "exceed", infer.uncorrected(F.col("exceed"), n).alias("uncp"))


def ranges_of(count: int, ranges: int) -> list[range]:
    """About equal ranges that make up 0 .. count - 1."""
    ends = np.linspace(0, count, min(ranges, count) + 1).round().astype(int).tolist()
    return [range(a, b) for a, b in zip(ends, ends[1:])]


def resumable_analysis(features: DataFrame, spec: AnalysisSpec, folder: str, ranges: int = 10, save_fn: Callable | None = None, permute_fn: Callable | None = None) -> analysis.Result:
    """permutation_analysis in ranges of permutations under a folder. After each range that this run adds, save_fn(partial p-values) and
    permute_fn(the range's permuted statistics: contrast, perm_id, feature_ids, stats) are called; their errors stop the run, and the next
    one goes on behind that range."""
    spark = features.sparkSession
    tasks = analysis.contrasts(spec)
    held, store = analysis.shared(spark, tasks, spec), Partials(spark, folder, spec)
    for part in ranges_of(len(tasks[0].orders), ranges):
        name = f"{part.start:09d}-{part.stop:09d}"
        if store.done(name):
            continue
        if permute_fn:
            permute_fn(analysis.permuted_blocks(features, spec, only=part))
        store.put(name, analysis.partials_of(features, tasks, held, part))
        if save_fn:
            save_fn(store.p_values())
    maxima = analysis.maxima_of(store.read())
    out = analysis.corrected(store.counts(), maxima, {t.label: t.two_tailed for t in tasks}, spec, len(tasks[0].orders))
    return analysis.Result(out, maxima, analysis.tags_of(tasks, spec))


