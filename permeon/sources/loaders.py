"""Reading matrices: headerless text tables, NumPy arrays, FSL matrices and NIfTI volumes.

Tables come back as (sample_id, x array): row order is what holds data, design and labels together, so rows are numbered as they
stand in the file. Design-sized inputs have a driver form (read_matrix); data go through Spark.
"""

from __future__ import annotations

import gzip
import io
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered, offset
from . import arrays

SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}
SQUEEZED = (".csv", ".tsv")


def suffix_of(path: str) -> str:
    low = path.lower()
    return ".nii.gz" if low.endswith(".nii.gz") else low[low.rfind(".") :] if "." in low.rsplit("/", 1)[-1] else ""


def is_image(path) -> bool:
    """A path to a NIfTI image, or a non-empty sequence of such."""
    if isinstance(path, str):
        return suffix_of(path) in (".nii", ".nii.gz")
    if isinstance(path, (list, tuple, np.ndarray)):
        return len(path) > 0 and all(is_image(p) if not isinstance(p, np.generic) else is_image(str(p)) for p in path)
    return isinstance(path, Volume)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def parse_fsl(text: str) -> np.ndarray:
    """The numbers after an FSL header's /Matrix line."""
    head, found, body = text.partition("/Matrix")
    if not found:
        raise ValueError("no /Matrix line")
    return np.array([[float(x) for x in line.split()] for line in body.splitlines() if line.strip()])


def parse_matrix(path: str, data: bytes) -> np.ndarray:
    kind = suffix_of(path)
    if kind in SEPARATORS:
        table = pd.read_csv(io.BytesIO(data), sep=SEPARATORS[kind], header=None, float_precision="round_trip").to_numpy()
        return table[:, 0] if table.shape[1] == 1 and kind in SQUEEZED else table
    if kind == ".npy":
        return np.load(io.BytesIO(data), allow_pickle=False)
    if kind in (".con", ".mat"):
        return parse_fsl(data.decode())
    raise ValueError(f"unsupported file type: {path}")


def read_matrix(spark: SparkSession, source) -> np.ndarray:
    """A small matrix (design, contrast, labels) on the driver: an array, a sequence, or a path."""
    if not isinstance(source, str):
        return np.asarray(source)
    return parse_matrix(source, read_bytes(spark, source))


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(sample_id, x array<double>) of a text table or .npy file of any length, or of a folder of text parts (kind says of which). sample_id
    follows the order of the file, and of the parts' names: lines are numbered inside the pieces that Spark cuts a text into, and an array's
    rows by their place. A vector in an .npy file is one row."""
    kind = kind or suffix_of(path)
    if kind == ".npy":
        return arrays.read_npy(spark, path)
    if kind in SEPARATORS:
        lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("piece")).where(F.trim("value") != "")
        numbers = offset(lines.withColumn("at", F.monotonically_increasing_id()), "piece", "at", "sample_id")
        return numbers.select("sample_id", F.transform(F.split("value", SEPARATORS[kind]), lambda s: s.cast("double")).alias("x"))
    m = np.atleast_2d(read_matrix(spark, path))  # FSL matrices are designs, of samples x regressors
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "sample_id long, x array<double>")


def to_observations(table: DataFrame) -> DataFrame:
    """(sample_id, feature_id, y) of (sample_id, x array)."""
    return table.select("sample_id", F.posexplode("x").alias("feature_id", "y")).withColumn("feature_id", F.col("feature_id").cast("long"))


@dataclass
class Volume:
    """An image: its array (i, j, k[, t]) and its affine."""

    data: np.ndarray
    affine: np.ndarray


def parse_nifti(raw: bytes) -> Volume:
    """A NIfTI-1 single file, gzipped or not; of the size of a mask or a map, not of data."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head = arrays.header(raw)
    count = int(np.prod(head.shape))
    data = head.values(raw[head.offset : head.offset + count * np.dtype(head.dtype).itemsize]).reshape(head.shape, order="F")
    return Volume(data[..., 0] if head.shape[3] == 1 else data, np.array(head.affine))


def nifti_bytes(volume: Volume, compress: bool = True) -> bytes:
    """A NIfTI-1 single file of doubles."""
    data = np.asarray(volume.data, "<f8")
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1, *np.sqrt((volume.affine[:3, :3] ** 2).sum(0)), *[1] * 4)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 2)
    struct.pack_into("<12f", head, 280, *volume.affine[:3].ravel())
    head[344:348] = b"n+1\0"
    raw = bytes(head) + data.tobytes(order="F")
    return gzip.compress(raw, mtime=0) if compress else raw


def read_volume(spark: SparkSession, source) -> Volume:
    if isinstance(source, Volume):
        return source
    if not is_image(source):
        raise ValueError(f"not an image: {source!r}")
    return parse_nifti(read_bytes(spark, source))


def read_voxels(spark: SparkSession, paths: list[str], lattice: DataFrame | None = None) -> DataFrame:
    """(image_id, path, t, i, j, k, value) of images; image_id is the place in the list, whatever the names are. lattice: of a mask, of
    which the box is read and no more."""
    if lattice is None:
        return arrays.read_images(spark, paths)
    ends = lattice.agg(*(f(c).alias(f"{n}_{c}") for c in "ijk" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    box = [[0, 0]] * 3 if ends["lo_i"] is None else [[ends[f"lo_{c}"], ends[f"hi_{c}"] + 1] for c in "ijk"]
    return arrays.read_images(spark, paths, box)


def lattice_of(spark: SparkSession, mask: Volume | str) -> DataFrame:
    """(feature_id, i, j, k) of a mask's voxels, numbered in C order. A mask's file is read, and its voxels are numbered, in tasks."""
    if isinstance(mask, str):
        inside = arrays.read_images(spark, [mask]).where("t = 0 and value <> 0").select("i", "j", "k")
        return numbered(inside, "i", "j", "k", name="feature_id").select("feature_id", "i", "j", "k")
    rows = [(n, *map(int, p)) for n, p in enumerate(np.argwhere(mask.data != 0))]
    return spark.createDataFrame(rows, "feature_id long, i int, j int, k int")


def mask_voxels(voxels: DataFrame, lattice: DataFrame) -> DataFrame:
    """Voxels in the mask, with feature_id."""
    return voxels.join(lattice, ["i", "j", "k"])


def unmask(values: DataFrame, grid: DataFrame, lattice: DataFrame, value: str = "value", fill: float = 0.0) -> DataFrame:
    """(i, j, k, value) for a whole grid; `fill` outside the mask."""
    inside = lattice.join(values, "feature_id").select("i", "j", "k", value)
    return grid.join(inside, ["i", "j", "k"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))
