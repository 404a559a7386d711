"""Queries over tables whose shapes differ from the small test tables'."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from permeon.plans import analysis
from permeon.queries import ORACLE_SQL, QUERIES
from permeon.spec import AnalysisSpec


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """256 vectors: of the blocks vec_id % 100 some have three samples, some two."""
    folder, rng = tmp_path_factory.mktemp("uneven"), np.random.default_rng(5)
    rows = {"vec_id": pa.array(np.arange(256)), "embedding": pa.array(rng.standard_normal((256, 4)).astype(np.float32).tolist(), pa.list_(pa.float32())), "label": pa.array((np.arange(256) % 10).astype(np.int32))}
    pq.write_table(pa.table(rows), folder / "embeddings.parquet")
    return str(folder)


def same_as_sql(name, spark, folder):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, folder).toPandas()[list(want.columns)]
    by = [c for c in want.columns if c in ("perm_id", "pos", "sample_id", "contrast", "feature_id")]
    pd.testing.assert_frame_equal(*(f.sort_values(by).reset_index(drop=True) for f in (got, want)), check_dtype=False, atol=2e-6)


def test_nested_blocks_of_uneven_sizes(spark, uneven):
    same_as_sql("perm_multilevel", spark, uneven)


def test_places_in_blocks_of_uneven_sizes(spark, uneven):
    same_as_sql("vg_multi_pos", spark, uneven)


@pytest.mark.parametrize("flip_signs", [False, True])
def test_samples_in_parts_give_what_whole_features_give(spark, monkeypatch, flip_signs):
    """A table that is cut along its samples: parts, feature groups and chunks of permutations, all with remainders. No order is made twice."""
    n, rng = 1_300, np.random.default_rng(8)
    x = np.column_stack((np.ones(n), rng.standard_normal((n, 2))))
    y = rng.standard_normal((7, n)) + 3
    y[:3] += 0.1 * x[:, 1]
    features = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(y)], "feature_id long, y array<double>").repartition(3)
    s = AnalysisSpec(x, np.array([[0, 1.0, 0], [0, 0, 1.0]]), f_contrast=np.array([True, True]), permutations=70, flip_signs=flip_signs, across_contrasts=True)
    read = lambda r: (r.features.orderBy("contrast", "feature_id").toPandas(), r.maxima.orderBy("contrast", "perm_id").toPandas())
    whole = read(analysis.permutation_analysis(features, s))
    monkeypatch.setattr(analysis, "TALL", 100)
    monkeypatch.setattr(analysis, "PART", 500)
    monkeypatch.setattr(analysis, "GROUP", 4)
    assert not analysis.partials_of(features, analysis.plan(s), analysis.shared(spark, analysis.plan(s), s)).isEmpty()
    for a, b in zip(read(analysis.permutation_analysis(features, s)), whole):
        pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def in_parts(monkeypatch):
    """Cuts 256 samples, and makes the way that goes by whole features fail."""

    def whole(*_):
        raise AssertionError("a task holds all samples' weights")

    monkeypatch.setattr(analysis, "TALL", 100)
    monkeypatch.setattr(analysis, "PART", 60)
    monkeypatch.setattr(analysis, "block_partials", whole)


def test_contrasts_together_in_parts(spark, uneven, monkeypatch):
    in_parts(monkeypatch)
    same_as_sql("cross_contrast_p", spark, uneven)


def test_two_tails_in_parts(spark, uneven, monkeypatch):
    in_parts(monkeypatch)
    same_as_sql("cfwe_p", spark, uneven)
