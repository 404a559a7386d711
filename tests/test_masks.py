"""Automatic masks against brute force on synthetic volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from permeon.operators import masks
from permeon.plans.facade import Dataset
from permeon.sources import loaders


def voxels_of(spark, volume):
    return spark.createDataFrame([(*map(int, p), float(volume[tuple(p)])) for p in np.argwhere(np.ones(volume.shape))], "i int, j int, k int, value double")


def shifted(mask):
    padded = np.pad(mask, 1)
    return [padded[1 + a : 1 + a + mask.shape[0], 1 + b : 1 + b + mask.shape[1], 1 + c : 1 + c + mask.shape[2]] for a, b, c in masks.STEPS]


def components(mask):
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), -1)
    while True:
        padded = np.pad(label, 1, constant_values=-1)
        around = [padded[1 + a : 1 + a + mask.shape[0], 1 + b : 1 + b + mask.shape[1], 1 + c : 1 + c + mask.shape[2]] for a, b, c in masks.STEPS]
        new = np.where(mask, np.max(around, axis=0), -1)
        if np.array_equal(new, label):
            return label
        label = new


def brute(volume):
    finite = volume[np.isfinite(volume)]
    lo, hi = finite.min(), finite.max()
    place = np.minimum(np.floor((volume - lo) / (hi - lo) * masks.BINS), masks.BINS - 1)
    best, cut = -1.0, 0
    for t in range(1, masks.BINS):
        a, b = place[place < t], place[place >= t]
        if len(a) and len(b) and (value := len(a) * len(b) * (a.mean() - b.mean()) ** 2) > best * (1 + 1e-12):
            best, cut = value, t
    mask = place >= cut
    mask = np.all(shifted(mask), axis=0)
    mask = np.any(shifted(mask), axis=0)
    label = components(mask)
    names, n = np.unique(label[label >= 0], return_counts=True)
    return label == names[np.argmax(n)]


def volume(seed, shape=(12, 11, 40)):
    rng = np.random.default_rng(seed)
    out, grid = rng.random(shape), np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1)
    for _ in range(4):
        centre, r = rng.integers(0, shape), rng.uniform(2, 6)
        out[((grid - centre) ** 2 * [1, 1, 0.15]).sum(-1) < r * r] += 6
    out[rng.random(shape) < 0.03] += 6  # specks, which opening takes away
    return out


@pytest.mark.parametrize("seed", range(3))
def test_automatic_masks(spark, seed, monkeypatch):
    monkeypatch.setattr(masks, "SLAB", 5)
    x = volume(seed)
    got = {tuple(r) for r in masks.automatic(voxels_of(spark, x)).collect()}
    assert got == {tuple(map(int, p)) for p in np.argwhere(brute(x))} and len(got) > 100


def test_components_over_slabs(spark, monkeypatch):
    monkeypatch.setattr(masks, "SLAB", 3)
    mask = np.zeros((3, 5, 20), bool)
    mask[0, 0, :], mask[0, 4, :], mask[0, :, 19] = True, True, True  # a bracket: both arms meet at the far end only
    mask[2, 2, 3:9] = True
    voxels = voxels_of(spark, mask.astype(float)).where("value > 0")
    parts = masks.labelled(voxels).groupBy("component").count().collect()
    assert sorted(r["count"] for r in parts) == [6, 43]
    assert masks.largest(voxels).count() == 43 and masks.largest(voxels.limit(0)).count() == 0


def test_nothing_is_bright(spark):
    flat = voxels_of(spark, np.full((3, 3, 3), 2.0))
    assert masks.automatic(flat).count() == 0 and masks.automatic(flat.withColumn("value", F.lit(float("nan")))).count() == 0


def test_images_without_a_mask(spark, tmp_path):
    x = volume(1, (9, 9, 9))
    rng, paths = np.random.default_rng(2), []
    data = [x + rng.standard_normal(x.shape) * 0.1 for _ in range(8)]
    for i, d in enumerate(data):
        paths.append(str(tmp_path / f"{i}.nii"))
        (tmp_path / f"{i}.nii").write_bytes(loaders.nifti_bytes(loaders.Volume(d, np.eye(4)), compress=False))
    want = brute(np.mean(data, 0))
    design = np.column_stack((np.ones(8), np.arange(8) % 2))
    dataset = Dataset(paths, {"design": design, "contrast": np.array([0, 1.0]), "permutations": 5}, output_prefix=str(tmp_path / "out"))
    features = dataset.features(spark).orderBy("feature_id").toPandas()
    assert np.allclose(np.stack(features["y"]).T, np.stack([d[want] for d in data]))
    files = dataset.run(spark)["files"]
    image = loaders.read_volume(spark, next(f for f in files if f.endswith("vox_tstat.nii.gz")))
    assert image.data.shape == x.shape and (image.data[~want] == 0).all() and (image.data[want] != 0).any()
