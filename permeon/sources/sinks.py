"""Writing results: parquet by contrast and measure, and exports with the usual file names."""

from __future__ import annotations

import io
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analysis import Result
from .loaders import Volume, nifti_bytes


def key_name(measure: str, label: str, tag: str, contrasts: int, image: bool = False, tfce: bool = False) -> str:
    """A result's name: the statistic's tag, the measure, and the contrast if there is more than one."""
    base = tag if measure == "stat" else f"{tag}_{measure}"
    tail = "" if label == "f" or (label == "c1" and contrasts == 1) else f"_{label}"
    name = f"{'tfce_' if tfce else ''}{base}{tail}"
    return f"vox_{name}" if image and not tfce else name


def renamed(key: str, tag: str, contrasts: int) -> str:
    """An internal key, such as stat_fwep_c1, by the same rule."""
    key = re.sub(r"(?<![A-Za-z0-9])stat(?![A-Za-z0-9])", tag, key)
    return key.removesuffix("_c1") if contrasts == 1 else key


def save_parquet(result: Result, folder: str, mode: str = "ignore") -> None:
    """Long results by contrast and measure. mode 'ignore' leaves what is there, so a job may run again."""
    result.measures().write.mode(mode).partitionBy("contrast", "measure").parquet(f"{folder}/results")
    result.maxima.write.mode(mode).partitionBy("contrast").parquet(f"{folder}/max_stat_dist")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Bytes to a file of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def npy_bytes(a: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.save(buffer, a)
    return buffer.getvalue()


def export(spark: SparkSession, result: Result, prefix: str, mask: Volume | None = None, done: set[str] | None = None) -> list[str]:
    """One file a map, .nii.gz in the mask's space or .npy; a map at a time on the driver. Names in `done` are skipped."""
    done, out = set() if done is None else done, []
    contrasts = sum(label != "f" for label in result.tags)
    long = result.measures()
    for label, measure in sorted({(r["contrast"], r["measure"]) for r in long.select("contrast", "measure").distinct().collect()}):
        name = key_name(measure, label, result.tags[label], contrasts, image=mask is not None and not result.tfce)
        if name in done:
            continue
        rows = long.where((F.col("contrast") == label) & (F.col("measure") == measure)).orderBy("feature_id").toPandas()
        values = rows["value"].to_numpy()
        if mask is not None and len(values) == np.count_nonzero(mask.data):
            full = np.zeros(mask.data.shape)
            full[mask.data != 0] = values
            path, data = f"{prefix}_{name}.nii.gz", nifti_bytes(Volume(full, mask.affine))
        else:
            path, data = f"{prefix}_{name}.npy", npy_bytes(values)
        put(spark, path, data)
        done.add(name)
        out.append(path)
    return out


def save_permutations(cube: DataFrame, folder: str) -> None:
    """The cube of permuted statistics by contrast and permutation."""
    cube.write.mode("ignore").partitionBy("contrast", "perm_id").parquet(f"{folder}/permutations")


def save_indices(indices: DataFrame, prefix: str) -> list[str]:
    """Row orders as headerless CSV, a line for each permutation, a file for each contrast."""
    out = []
    for label in [r[0] for r in indices.select("contrast").distinct().orderBy("contrast").collect()]:
        rows = indices.where(F.col("contrast") == label).orderBy("perm_id", "pos").toPandas()
        lines = [",".join(map(str, g["src"])) for _, g in rows.groupby("perm_id")]
        path = f"{prefix}_permuted_indices_{label}.csv"
        put(indices.sparkSession, path, ("\n".join(lines) + "\n").encode())
        out.append(path)
    return out


def save_similarity(spark: SparkSession, found: dict[str, DataFrame | None], folder: str) -> None:
    """Similarity tables and null distributions, those that there are."""
    for name, df in found.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
