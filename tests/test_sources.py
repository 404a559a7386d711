"""Data sources by byte ranges, and global order by ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from permeon import exchange
from permeon.operators import order, spatial
from permeon.functions import special
from permeon.sources import arrays, loaders

RNG = np.random.default_rng(3)
AFFINE = np.diag([2.0, 2, 2, 1])


def write(path, data, compress=False):
    path.write_bytes(loaders.nifti_bytes(loaders.Volume(data, AFFINE), compress))
    return str(path)


def values(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["i"], r["j"], r["k"], r["t"]] = r["value"]
    return out


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("box", [None, [[1, 3], [0, 5], [2, 4]], [[0, 4], [1, 2], [0, 99]], [[9, 12], [0, 5], [0, 6]], [[0, 0]] * 3])
def test_images_by_ranges(spark, tmp_path, compress, box):
    data = [RNG.standard_normal((4, 5, 6, 3)), RNG.standard_normal((4, 5, 6))]
    paths = [write(tmp_path / f"{'a'}{i}.nii{'.gz' if compress else ''}", d, compress) for i, d in enumerate(data)]
    got = arrays.read_images(spark, paths, box, part_bytes=400)
    for i, d in enumerate(data):
        d = d if d.ndim == 4 else d[..., None]
        want = np.full(d.shape, np.nan)
        inside = tuple(slice(a, b) for a, b in (box or [[0, 99]] * 3))
        want[inside] = d[inside]
        assert np.array_equal(values(got.where(F.col("image_id") == i), d.shape), want, equal_nan=True)
    assert {r["path"] for r in got.select("path").distinct().collect()} <= set(paths)


def test_only_the_box_is_read(tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "READ_BYTES", 1 << 14)
    data = RNG.standard_normal((20, 30, 40, 2))
    path = write(tmp_path / "a.nii", data)
    reader = arrays.NiftiReader({"paths": f'["{path}"]', "box": "[[5, 10], [10, 13], [7, 9]]"})
    read = []
    for part in (p for b in reader.partitions() for p in b.parts):
        with arrays.Ranges(path) as file:
            rows = list(arrays.ranged(file, part, reader.box))
            read.append(file.bytes)
        assert {k for _, k, _ in rows} <= {7, 8}
    assert len(arrays.NiftiReader({"paths": f'["{path}"]', "partbytes": 20 * 30 * 8 * 10}).partitions()) == 8 and len(reader.partitions()) == 1
    assert sum(read) == 2 * 2 * 3 * 20 * 8  # volumes, planes, rows of the box, whole rows
    packed = tmp_path / "a.nii.gz"
    packed.write_bytes(loaders.nifti_bytes(loaders.Volume(data, AFFINE)))
    head = arrays.head_of(str(packed))
    with arrays.Ranges(str(packed)) as file:
        assert len(list(arrays.unzipped(file, arrays.Planes(0, str(packed), head, None, 0, 2), None))) == 4
        assert file.bytes < packed.stat().st_size  # nothing behind the last plane


def test_types_scales_and_orders(spark, tmp_path):
    data = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    raw = bytearray(loaders.nifti_bytes(loaders.Volume(np.zeros((2, 3, 4)), AFFINE), compress=False)[:352])
    import struct

    struct.pack_into("<2h", raw, 70, 4, 16)
    struct.pack_into("<3f", raw, 108, 352, 2.0, 5.0)
    (tmp_path / "s.nii").write_bytes(bytes(raw) + data.tobytes(order="F"))
    assert np.array_equal(values(arrays.read_images(spark, [str(tmp_path / "s.nii")]), (2, 3, 4, 1))[..., 0], data * 2.0 + 5)
    (tmp_path / "bad.nii").write_bytes(b"x" * 400)
    with pytest.raises(Exception, match="NIfTI"):
        arrays.read_images(spark, [str(tmp_path / "bad.nii")]).count()


def test_qform_is_a_rotation():
    import struct

    raw = bytearray(352)
    b, c, d = 0.5, -0.5, 0.5  # a = 0.5: a third of a turn
    struct.pack_into("<8f", raw, 76, -1, 2, 3, 4, 0, 0, 0, 0)
    struct.pack_into("<2h", raw, 252, 1, 0)
    struct.pack_into("<6f", raw, 256, b, c, d, 7, 8, 9)
    got = arrays.affine(bytes(raw), "<")
    # a permutation of the axes by the rule for unit quaternions, checked by turning vectors
    q = np.array([0.5, b, c, d])
    turned = [rotate(q, v) for v in np.eye(3)]
    assert got[:3, :3] == pytest.approx(np.stack(turned, 1) * [2, 3, -4]) and got[:3, 3].tolist() == [7, 8, 9]


def rotate(q, v):
    a, u = q[0], q[1:]
    return v + 2 * np.cross(u, np.cross(u, v) + a * v)


def test_images_with_like_names(spark, tmp_path):
    """A name is a path, not a pattern, and not the end of another."""
    (tmp_path / "x").mkdir()
    names = ["sub_1.nii", "subA1.nii", "1.nii", "11.nii", "x/1.nii"]
    data = [np.full((2, 2, 2), float(i)) for i in range(5)]
    paths = [write(tmp_path / n, d) for n, d in zip(names, data)]
    got = loaders.read_voxels(spark, paths).groupBy("image_id").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("image_id").collect()
    assert [tuple(r) for r in got] == [(i, 8, float(i), float(i)) for i in range(5)]
    again = loaders.read_voxels(spark, [paths[0], paths[0]])
    assert again.count() == 16 and again.select("image_id").distinct().count() == 2


def test_a_mask_file(spark, tmp_path):
    mask = (RNG.random((5, 4, 3)) < 0.4).astype(float)
    path = write(tmp_path / "m.nii.gz", mask, True)
    one, other = (loaders.lattice_of(spark, m).orderBy("feature_id").collect() for m in (path, loaders.Volume(mask, AFFINE)))
    assert one == other and len(one) == mask.sum()


@pytest.mark.parametrize("order_", ["C", "F"])
def test_npy_by_ranges(spark, tmp_path, order_):
    x = RNG.standard_normal((57, 7)).astype(np.float32)
    np.save(tmp_path / "x.npy", np.array(x, order=order_))
    got = sorted((r["sample_id"], r["x"]) for r in arrays.read_npy(spark, str(tmp_path / "x.npy"), part_bytes=200).collect())
    assert [i for i, _ in got] == list(range(57)) and np.allclose([v for _, v in got], x)
    assert arrays.read_npy(spark, str(tmp_path / "x.npy"), part_bytes=200).rdd.getNumPartitions() > 5
    np.save(tmp_path / "v.npy", np.arange(4))
    assert arrays.read_npy(spark, str(tmp_path / "v.npy")).collect()[0]["x"] == [0, 1, 2, 3]
    np.save(tmp_path / "e.npy", np.empty((0, 3)))
    assert loaders.read_table(spark, str(tmp_path / "e.npy")).count() == 0
    np.save(tmp_path / "bad.npy", np.array(["a"]))
    with pytest.raises(Exception, match="numbers"):
        arrays.read_npy(spark, str(tmp_path / "bad.npy")).count()


def test_npy_written_by_tasks(spark, tmp_path):
    x = RNG.standard_normal((40, 3))
    ids = RNG.permutation(1000)[:40]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "sample_id long, x array<double>")
    paths = arrays.write_npy(rows, str(tmp_path / "out"), 5)
    assert len(paths) > 1
    got = sorted(arrays.read_npy(spark, paths).collect())
    assert np.array_equal([r["x"] for r in got], x[np.argsort(ids)]) and [r["sample_id"] for r in got] == list(range(40))


def test_lines_are_numbered_in_pieces(spark, tmp_path):
    lines = [f"{i},{i * 0.5}" for i in range(5000)]
    (tmp_path / "t.csv").write_text("\n".join(lines[:10] + ["", " "] + lines[10:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = loaders.read_table(spark, str(tmp_path / "t.csv"))
        rows = sorted((r["sample_id"], r["x"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == [(i, [float(i), i * 0.5]) for i in range(5000)]


def test_places_without_one_task(spark):
    x = RNG.integers(0, 300, 2000)
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(x)], "v int, id int").repartition(7)
    got = order.numbered(df, F.desc("v"), "id", partitions=6)
    want = sorted(((int(v), i) for i, v in enumerate(x)), key=lambda r: (-r[0], r[1]))
    assert [(r["v"], r["id"]) for r in sorted(got.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got.collect()) == list(range(2000))
    assert order.numbered(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3, 6])
def test_hilbert_columns(spark, bits):
    points = RNG.integers(0, 1 << bits, (200, 3))
    df = spark.createDataFrame([tuple(map(int, (i, *p))) for i, p in enumerate(points)], "id int, x long, y long, z long")
    got = {r["id"]: r["h"] for r in df.select("id", spatial.hilbert_col(F.col("x"), F.col("y"), F.col("z"), bits).alias("h")).collect()}
    assert [got[i] for i in range(200)] == spatial.hilbert(points, bits).tolist()


def test_incomplete_beta_as_a_column(spark):
    a, b, x = RNG.uniform(0.3, 900, 300), RNG.uniform(0.3, 900, 300), RNG.random(300)
    x[:3] = 0, 1, 1e-12
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(a, b, x))], "id int, a double, b double, x double")
    got = df.select("id", special.betainc_col(F.col("a"), F.col("b"), F.col("x")).alias("p")).toPandas().sort_values("id")["p"]
    assert got.to_numpy() == pytest.approx(special.betainc(a, b, x), abs=1e-10)
    t, df2 = RNG.standard_normal(50) * 4, RNG.uniform(1, 200, 50)
    t[0] = 0
    rows = spark.createDataFrame([(i, float(u), float(v)) for i, (u, v) in enumerate(zip(t, df2))], "id int, t double, v double")
    z = rows.select("id", special.z_of_t_col(F.col("t"), F.col("v")).alias("z"), special.z_of_f_col(F.abs("t"), F.lit(3.0), F.col("v")).alias("f")).toPandas().sort_values("id")
    assert z["z"].to_numpy() == pytest.approx(special.z_of_t(t, df2), abs=1e-7)
    assert z["f"].to_numpy() == pytest.approx(special.z_of_f(np.abs(t), 3.0, df2), abs=1e-7)


def test_nested_blocks(spark):
    """Labels of three levels. Blocks of a positive parent trade places, samples of a positive innermost block move."""
    levels = {"a": [1, 1, 1, 1, 2, 2, 2, 2], "b": [-1, -1, -2, -2, 3, 3, 4, 4], "c": [1, 1, 1, 1, -1, -1, -1, -1]}
    rows = list(zip(range(10, 18), *levels.values()))
    samples = spark.createDataFrame(rows, "sample_id long, a int, b int, c int")
    got = {}
    for r in exchange.hash_nested(samples, 60, list(levels)).collect():
        got.setdefault(r["perm_id"], {})[r["pos"] - 10] = r["src"] - 10
    a, b = np.array(levels["a"]), np.array(levels["b"])
    seen = {tuple(p[i] for i in range(8)) for p in got.values()}
    assert all(sorted(p) == list(range(8)) for p in seen) and len(seen) > 10
    for p in seen:
        p = np.array(p)
        assert len(set(a[p][:4])) == len(set(a[p][4:])) == 1  # outermost blocks stay whole, and trade
        assert all(b[p][i] == b[p][i + 1] for i in (0, 2, 4, 6))
        moved = a[p][0] == 2
        inner = p[:4] if moved else p[4:]
        assert inner[0] % 2 == 0 and inner[1] == inner[0] + 1  # negative innermost labels keep their samples' order
    assert {p[0] in (4, 6) for p in seen} == {True, False}
    for bad, what in (([(1, 1, 0)], "label 0"), ([(1, 1, 1), (2, 1, -2)], "mixed"), ([(1, 1, 1), (2, 1, 1), (3, 1, 2)], "same size")):
        with pytest.raises(ValueError, match=what):
            exchange.hash_nested(spark.createDataFrame(bad, "sample_id long, a int, b int"), 1, ["a", "b"])
