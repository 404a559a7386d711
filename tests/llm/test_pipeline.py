"""The pipeline's stages on the smallest tables."""

import corpus_pipeline as pipeline
from permeon.llm._session import table


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns, name
        before, after = {r[0] for r in kept.select("doc_id").collect()}, [r[0] for r in out.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before, name
        kept = out.cache()
    packed = pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r[0] for r in packed.select("doc_id").collect()} == set(after)
    assert pipeline.run(spark, sf).count() == packed.count()


def test_awkward_documents(spark, sf):
    """Nulls, empty and very long texts, repeated rows, copies, clashing columns; and no documents at all."""
    words = [f"word{i % 97}x{i % 13}" for i in range(40_000)]
    base = " ".join(words[:300])
    rows = [(1, None), (2, ""), (3, base), (4, base), (5, base + " end"), (5, base + " end"), (None, "no id at all"), (6, " ".join(words)), (7, "short"), (8, " ".join(words[500:700]))]
    extra = ("en", "s", 1, "q", 2, 3, "w")
    docs = spark.createDataFrame([r + extra for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, length int, kept int, component_id string")
    kept, columns = docs, docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == columns, name
        assert {r["node"] for r in kept.collect()} <= {"q"}
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) <= 1 and 4 not in ids and 5 not in ids  # one of the copies and near copies at most
    packed = pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert sorted({(r["doc_id"] or -1) for r in packed}) == sorted({(i or -1) for i in ids})
    nothing = docs.limit(0)
    for _, stage in pipeline.STAGES:
        nothing = stage(spark, nothing, sf)
        assert nothing.count() == 0
