"""The library's front door: datasets with their settings, from arrays, tables or files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks, similarity, tfce
from ..operators.order import numbered
from ..shared import settled
from ..sources import arrays, loaders, sinks
from ..spec import AnalysisSpec
from . import analysis
from .ranges import resumable_analysis


#: Settings that may be paths of matrices.
MATRICES = ("design", "contrast", "f_contrast", "exchangeability", "variance_groups")


def plain(value: object) -> object:
    """Arrays as lists, for JSON."""
    if hasattr(value, "tolist"):
        return value.tolist()
    raise TypeError(f"not for JSON: {type(value).__name__}")


@dataclass
class Dataset:
    """data: an array (samples x features), a DataFrame (sample_id, feature_id, y), a table file, or images with `mask` (without one, an automatic mask). Other
    settings are AnalysisSpec's; its matrices may be paths. A one-dimensional array is one sample; with a mask, one feature."""

    data: object
    settings: dict = field(default_factory=dict)
    mask: object = None
    output_prefix: str | None = None
    name: str = "dataset"
    _own: DataFrame | None = field(default=None, init=False, repr=False, compare=False)

    def spec(self, spark: SparkSession) -> AnalysisSpec:
        known = {f.name for f in fields(AnalysisSpec)}
        unknown = set(self.settings) - known
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return AnalysisSpec(**{k: loaders.read_matrix(spark, v) if k in MATRICES and v is not None else v for k, v in self.settings.items()})

    def paths(self) -> list[str]:
        """Of the images, if the data are images."""
        if not loaders.is_image(self.data) or isinstance(self.data, loaders.Volume):
            return []
        return [self.data] if isinstance(self.data, str) else [str(p) for p in self.data]

    def lattice(self, spark: SparkSession) -> DataFrame:
        """The mask's voxels; of images without one, an automatic mask's."""
        if self.mask is None:
            if self._own is None:
                inside = masks.automatic(loaders.read_voxels(spark, self.paths()))
                self._own = settled(numbered(inside, "i", "j", "k", name="feature_id").select("feature_id", "i", "j", "k"))
            return self._own
        return loaders.lattice_of(spark, self.mask if isinstance(self.mask, str) else self.volume(spark))

    def volume(self, spark: SparkSession) -> loaders.Volume | None:
        """The mask as an image, which results are written in; None if there is none."""
        if self.mask is not None:
            return loaders.read_volume(spark, self.mask)
        if not self.paths():
            return None
        head = arrays.head_of(self.paths()[0])
        data = np.zeros(head.shape[:3])
        at = self.lattice(spark).select("i", "j", "k").toPandas().to_numpy()
        data[tuple(at.T)] = 1
        return loaders.Volume(data, np.array(head.affine))

    def features(self, spark: SparkSession) -> DataFrame:
        """(feature_id, y array in sample order)."""
        data = self.data
        if isinstance(data, DataFrame):
            return analysis.to_features(data)
        if loaders.is_image(data):
            lattice = self.lattice(spark)
            voxels = loaders.mask_voxels(loaders.read_voxels(spark, self.paths(), lattice), lattice)
            obs = voxels.select(F.struct("image_id", "t").alias("sample_id"), "feature_id", F.col("value").alias("y"))
            return analysis.to_features(obs)
        if isinstance(data, str):
            return analysis.to_features(loaders.to_observations(loaders.read_table(spark, data)))
        m = np.asarray(data, float)
        m = (m[:, None] if self.mask is not None else m[None, :]) if m.ndim == 1 else m
        return spark.createDataFrame([(i, [float(v) for v in col]) for i, col in enumerate(m.T)], "feature_id long, y array<double>")

    def run(self, spark: SparkSession, save_fn=None, permute_fn=None, folder: str | None = None, ranges: int = 10) -> dict[str, object]:
        """Result, and with the settings that ask for it the cube ('permuted_stats') and the Result of TFCE maps ('tfce').

        folder: work in ranges of permutations there, and go on where an earlier run stopped; save_fn(p-values so far) and permute_fn(the
        range's permuted statistics) are then called after each range. Without one both are called once, with the result and the cube."""
        spec, features = self.spec(spark), self.features(spark)
        out: dict[str, object] = {}
        if folder:
            result = resumable_analysis(features, spec, folder, ranges, save_fn, permute_fn)
        else:
            result = analysis.permutation_analysis(features, spec)
            if permute_fn:
                permute_fn(analysis.permuted_blocks(features, spec))
            if save_fn:
                save_fn(result)
        out["result"] = result
        if spec.return_permutations:
            out["permuted_stats"] = analysis.permuted_statistics(features, spec)
        volume = self.volume(spark)
        if spec.tfce:
            if volume is None:
                raise ValueError("TFCE needs a mask")
            out["tfce"] = tfce.tfce_analysis(features, spec, self.lattice(spark))
        if self.output_prefix:
            out["files"] = sinks.export(spark, result, self.output_prefix, volume)
            if spec.tfce:
                out["files"] += sinks.export(spark, out["tfce"], self.output_prefix, volume)
        return out

    def permuted_indices(self, spark: SparkSession) -> DataFrame:
        return analysis.permuted_indices(spark, self.spec(spark))

    def save_config(self, spark: SparkSession, path: str, command: list[str] | None = None) -> None:
        """Settings as JSON by name. Matrices, and data that are an array, are written beside it as headerless CSV and told by their path;
        what came as a path stays one."""
        settings = json.loads(replace(self.spec(spark), **dict.fromkeys(MATRICES[2:])).to_json())
        stem = path.removesuffix(".json")

        def beside(name: str, value: object) -> object:
            if value is None or isinstance(value, str):
                return value
            lines = "".join(",".join(repr(x) for x in np.atleast_1d(row).tolist()) + "\n" for row in np.asarray(value))
            sinks.put(spark, f"{stem}_{name}.csv", lines.encode())
            return f"{stem}_{name}.csv"

        settings |= {k: beside(k, v) for k, v in self.settings.items() if k in MATRICES}
        data = beside("data", self.data) if isinstance(self.data, np.ndarray) else self.data
        told = {"data": data, "mask": self.mask, "output_prefix": self.output_prefix, "name": self.name, "settings": settings, "cmd": command}
        sinks.put(spark, path, json.dumps(told, indent=1, default=plain).encode())

    @classmethod
    def from_config(cls, spark: SparkSession, path: str) -> Dataset:
        given = json.loads(loaders.read_bytes(spark, path))
        given.pop("cmd", None)
        return cls(**given)


def spatial_similarity(spark: SparkSession, datasets, references=None, two_tailed: bool = True, compare=None, accel_tail: bool = False) -> dict[str, DataFrame | None]:
    """Similarity of datasets' maps with each other and with reference maps (arrays by name, or a DataFrame ref_id, feature_id,
    value). A single dataset without references has nothing to be compared with: everything is None."""
    datasets = [datasets] if isinstance(datasets, Dataset) else list(datasets or [])
    if not datasets:
        raise ValueError("similarity needs a dataset")
    if references is not None and not isinstance(references, DataFrame):
        named = references if isinstance(references, dict) else {f"ref{i}": r for i, r in enumerate(references if isinstance(references, (list, tuple)) else [references])}
        rows = [(k, i, float(v)) for k, r in named.items() for i, v in enumerate(np.ravel(r))]
        references = spark.createDataFrame(rows, "ref_id string, feature_id long, value double")
    parts = {d.name if len({x.name for x in datasets}) == len(datasets) else f"{d.name}{i}": (d.features(spark), d.spec(spark)) for i, d in enumerate(datasets)}
    return similarity.similarity_analysis(parts, references, two_tailed, compare, accel_tail)
