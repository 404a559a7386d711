"""Analyses end to end, inputs and outputs, command lines."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from permeon import cli
from permeon.operators import similarity
from permeon.plans.analysis import permutation_analysis, permuted_indices, permuted_statistics, plan
from permeon.plans.facade import Dataset, spatial_similarity
from permeon.sources import loaders, sinks
from permeon.spec import AnalysisSpec

RNG = np.random.default_rng(42)
DATA, DESIGN = RNG.standard_normal((36, 200)), RNG.standard_normal((36, 3))
EB = RNG.permutation(np.repeat([1, 2], 18))


@pytest.mark.parametrize(
    "case",
    [
        {"contrast": [1.0, 0, 0]},
        {"contrast": [[1.0, 0, 0]], "zstat": True},
        {"contrast": [[1.0, 0, 0], [0, 1, 0]], "f_contrast": np.ones(2, bool), "f_only": True},
        {"contrast": [1.0, 0, 0], "exchangeability": EB, "vg_auto": True, "within": True, "accel_tail": True},
        {"contrast": [[1.0, 0, 0], [0, 1, 0]], "f_contrast": np.ones(2, bool), "exchangeability": EB, "vg_auto": True, "across_contrasts": True},
        {"contrast": [1.0, 0, 0], "stat": "pearson", "flip_signs": True, "demean": True},
    ],
)
def test_null_data(spark, case):
    features = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(DATA.T)], "feature_id long, y array<double>")
    f = permutation_analysis(features, AnalysisSpec(DESIGN, permutations=99, **case)).features.toPandas()
    for _, g in f.groupby("contrast"):
        assert len(g) == 200 and g[["uncp", "fdrp", "fwep"]].stack().between(0, 1).all()
        assert (g["uncp"] < 0.05).mean() <= 0.15 and (g["fwep"] < 0.05).mean() <= 0.05
        assert (g["fwep"] >= g["uncp"] - 1e-12).all() or case.get("accel_tail")


def test_a_user_statistic_and_the_cube(spark):
    features = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(DATA.T[:4])], "feature_id long, y array<double>")

    def median_slope(y, m, c, groups=None):
        return np.median(y * m[:, :1], axis=0), 1, 1

    spec = AnalysisSpec(DESIGN, np.array([1.0, 0, 0]), permutations=5, stat=median_slope)
    assert permutation_analysis(features, spec).tags == {"c1": "median_slopestat"}
    cube = permuted_statistics(features, spec).toPandas()
    assert len(cube) == 20 and (cube["stat"] != 0).any()
    used = np.stack(plan(spec)[0].orders)
    told = permuted_indices(spark, spec).toPandas().sort_values(["perm_id", "pos"])["src"].to_numpy().reshape(5, 36)
    assert (used == told).all()


@pytest.mark.parametrize(("n_ds", "n_ref"), [(2, 0), (3, 0), (1, 1), (1, 2), (2, 2), (1, 0)])
def test_similarity(spark, n_ds, n_ref):
    rng = np.random.default_rng(n_ds)
    ds = [Dataset(rng.standard_normal((12, 20)), {"design": np.column_stack((np.ones(12), rng.standard_normal(12))), "contrast": np.array([0, 1.0]), "permutations": 9 + i, "seed": i}, name=f"d{i}") for i in range(n_ds)]
    out = spatial_similarity(spark, ds, [rng.standard_normal(20) for _ in range(n_ref)] or None)
    assert (out["ds_ds"] is None) == (n_ds == 1) and (out["ds_ref"] is None) == (n_ref == 0)
    if n_ds > 1:
        r, p = similarity.matrix(out["ds_ds"], [d.name for d in ds])
        assert r.shape == (n_ds, n_ds) and np.isnan(np.diag(p)).all() and (np.diag(r) == 1).all()
    if n_ref:
        assert out["ds_ref"].count() == n_ds * n_ref
        assert out["ds_ref"].where("p < 0.1 or p > 1").count() == 0


def test_similarity_needs_a_dataset(spark):
    with pytest.raises(ValueError):
        spatial_similarity(spark, [], [np.ones(3)])


def test_tables_and_matrices(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3,4\n")
    (tmp_path / "one.tsv").write_text("5\n6\n")
    (tmp_path / "one.txt").write_text("5\n6\n")
    (tmp_path / "c.con").write_text("/NumWaves 2\n/Matrix\n1 0\n0 1\n")
    (tmp_path / "bad.mat").write_text("1 0\n")
    np.save(tmp_path / "n.npy", np.arange(6.0).reshape(2, 3))
    read = lambda name: loaders.read_matrix(spark, str(tmp_path / name))
    assert read("a.csv").tolist() == [[1, 2], [3, 4]] and read("one.tsv").shape == (2,) and read("one.txt").shape == (2, 1)
    assert read("c.con").tolist() == [[1, 0], [0, 1]] and read("n.npy").shape == (2, 3)
    for name in ("bad.mat", "a.xyz"):
        with pytest.raises(Exception):  # noqa: B017
            read(name)
    table = loaders.read_table(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in loaders.to_observations(table).orderBy("sample_id", "feature_id").collect()] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]


def test_images(spark, tmp_path):
    affine = np.array([[2.0, 0, 0, -4], [0, 2, 0, -6], [0, 0, 2, -8], [0, 0, 0, 1]])
    mask = np.zeros((3, 3, 3))
    mask[1:, :, :] = 1
    images = [RNG.standard_normal((3, 3, 3)) for _ in range(10)]
    paths = [str(tmp_path / f"i{i}.nii.gz") for i in range(10)]
    for path, data in zip(paths, images):
        (tmp_path / path.rsplit("/")[-1]).write_bytes(loaders.nifti_bytes(loaders.Volume(data, affine)))
    (tmp_path / "m.nii").write_bytes(loaders.nifti_bytes(loaders.Volume(mask, affine), compress=False))
    volume = loaders.read_volume(spark, str(tmp_path / "m.nii"))
    assert (volume.data == mask).all() and (volume.affine == affine).all()
    x = np.column_stack((np.ones(10), np.arange(10.0)))
    d = Dataset(paths, {"design": x, "contrast": np.array([0, 1.0]), "permutations": 9, "tfce": True}, str(tmp_path / "m.nii"), str(tmp_path / "out"))
    got = d.features(spark).orderBy("feature_id").toPandas()
    assert np.allclose(np.stack(got["y"]).T, np.stack([i[mask != 0] for i in images]))
    out = d.run(spark)
    assert any(f.endswith("out_vox_tstat.nii.gz") for f in out["files"]) and any(f.endswith("out_tfce_tstat_fwep.nii.gz") for f in out["files"])
    assert out["tfce"].features.count() == 18
    lattice = loaders.lattice_of(spark, volume)
    grid = spark.createDataFrame([(int(i), int(j), int(k)) for i, j, k in np.ndindex(3, 3, 3)], "i int, j int, k int")
    full = loaders.unmask(lattice.select("feature_id", F.lit(1.0).alias("value")), grid, lattice)
    assert full.agg(F.sum("value")).first()[0] == 18 and full.count() == 27
    assert not loaders.is_image([]) and loaders.is_image(paths)


def test_names_and_files(spark, tmp_path):
    assert sinks.key_name("fwep", "c1", "tstat", 1) == "tstat_fwep" and sinks.key_name("stat", "c2", "vstat", 2) == "vstat_c2"
    assert sinks.key_name("uncp", "f", "fstat", 2, image=True) == "vox_fstat_uncp" and sinks.renamed("stat_fwep_c1", "zt", 1) == "zt_fwep"
    features = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(DATA.T[:5])], "feature_id long, y array<double>")
    spec = AnalysisSpec(DESIGN, np.array([1.0, 0, 0]), permutations=9)
    result = permutation_analysis(features, spec)
    sinks.save_parquet(result, str(tmp_path / "r"))
    sinks.save_parquet(result, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/results")).count() == 20
    done: set[str] = set()
    assert len(sinks.export(spark, result, str(tmp_path / "x"), done=done)) == 4 and sinks.export(spark, result, str(tmp_path / "x"), done=done) == []
    assert np.load(tmp_path / "x_tstat.npy").shape == (5,)
    (csv,) = sinks.save_indices(permuted_indices(spark, spec), str(tmp_path / "x"))
    assert np.loadtxt(csv, delimiter=",").shape == (9, 36)


def test_command_lines(spark, tmp_path, capsys):
    np.savetxt(tmp_path / "y.csv", DATA[:, :6], delimiter=",")
    np.savetxt(tmp_path / "x.csv", DESIGN, delimiter=",")
    np.savetxt(tmp_path / "c.csv", [[1, 0, 0]], delimiter=",")
    base = ["glm", "-i", str(tmp_path / "y.csv"), "-d", str(tmp_path / "x.csv"), "-t", str(tmp_path / "c.csv"), "-n", "9"]
    for name in ("a", "b"):
        with pytest.warns(UserWarning, match="ignored"):
            assert cli.main([*base, "-o", str(tmp_path / name), "-twotail", "-savedof", "-rmethod", "huh"]) == 0
    assert len(json.loads(capsys.readouterr().out.splitlines()[-1])) == 4
    assert cli.main(["similarity", "-configs", str(tmp_path / "a_config.json"), str(tmp_path / "b_config.json"), "-o", str(tmp_path / "sim")]) == 0
    assert spark.read.parquet(str(tmp_path / "sim/ds_ds")).first()["r"] == pytest.approx(1)
    for bad in (["-T"], ["-fonly"], ["-n", "0"], ["-twotial"], ["-savdof"]):
        with pytest.raises(SystemExit):
            cli.main([*base, *bad])
    assert "-twotail" in capsys.readouterr().err


def test_output_prefixes(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "there").mkdir()
    assert cli.output_prefix("there") == f"{tmp_path}/there/" and cli.output_prefix("x") == f"{tmp_path}/x"
    assert cli.output_prefix("new/sub/x") == f"{tmp_path}/new/sub/x" and (tmp_path / "new/sub").is_dir()
    assert cli.output_prefix("s3://b/x") == "s3://b/x"


def test_configs_with_arrays(spark, tmp_path):
    eb = np.repeat([1, 2], 18)
    given = Dataset(DATA[:, :4], {"design": DESIGN, "contrast": np.array([[1.0, 0, 0], [0, 1, 0]]), "f_contrast": np.array([True, True]), "exchangeability": eb, "permutations": 7, "seed": 3})
    given.save_config(spark, str(tmp_path / "c.json"), ["x"])
    told = json.loads((tmp_path / "c.json").read_text())
    assert told["data"] == str(tmp_path / "c_data.csv") and told["settings"]["design"] == str(tmp_path / "c_design.csv")
    again = Dataset.from_config(spark, str(tmp_path / "c.json"))
    spec = again.spec(spark)
    assert np.array_equal(spec.design, DESIGN) and np.array_equal(spec.exchangeability, eb) and spec.f_contrast.tolist() == [True, True] and spec.permutations == 7
    one, other = (d.run(spark)["result"].features.orderBy("contrast", "feature_id").toPandas() for d in (given, again))
    assert one["contrast"].tolist() == other["contrast"].tolist() and one["exceed"].tolist() == other["exceed"].tolist()
    assert one["stat"].to_numpy() == pytest.approx(other["stat"].to_numpy(), rel=1e-12)
