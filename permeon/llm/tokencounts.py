"""Operator 2: token counts as rollups that are maintained by deltas.

A rollup is a folder of committed batches. A batch holds signed sums by source, language and tokenizer version: inserts
count up, deletes down, a revision is the delete of the old count and the insert of the new one. All measures are additive,
so totals are the sum over batches, whatever their order. fold() sums the batches so far into one, so totals read the last fold
and what came after it; of a folded batch a mark stays, so that it isn't taken twice.

Commits are idempotent: a batch is written aside and moved to its id's place in one rename; if the id is there already,
the new one is dropped. A job that fails and runs again, in part or as a whole, changes nothing twice. Sums are combined
before the shuffle, so a source with a third of all rows is one row a task.

Null sources and languages are groups of their own. Null and empty texts are documents of no tokens. Very long texts count whole.
Repeated rows count each time. Groups whose sums are all zero don't show. Empty table: a batch without rows; a rollup without
batches has no totals. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._encode import COUNT_BITS, library_counter
from ._session import prepare, schema, written

KEYS = ["source", "lang", "tokenizer_version"]
MEASURES = ["n_docs", "n_tokens", "n_bytes"]
SUMS = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def counts(docs: DataFrame, tokenizers: dict[str, tuple[str, bool]]) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens, n_bytes of whole texts; a row for each tokenizer.

    tokenizers: version to (file, whether it is byte-level)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, mask = library_counter(tuple(tokenizers.values())), (1 << COUNT_BITS) - 1
        for batch in batches:
            texts = batch.column(3).to_pylist()
            size = pa.array([len((t or "").encode()) for t in texts], pa.int64())
            numbers = counter.encode_batch(texts)
            for i, version in enumerate(tokenizers):
                n = pa.array([x >> COUNT_BITS * i & mask for x in numbers], pa.int64())
                names = ["doc_id", "source", "lang", "tokenizer_version", "n_tokens", "n_bytes"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * len(texts), pa.string()), n, size], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
    return rows.mapInArrow(run, schema("doc_id bigint, source string, lang string, tokenizer_version string, n_tokens bigint, n_bytes bigint"))


def inserts(counted: DataFrame) -> DataFrame:
    """Signed rows for counted documents that are new."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def deletes(counted: DataFrame) -> DataFrame:
    """Signed rows for counted documents that go."""
    return inserts(counted).select(*KEYS, *((-F.col(m)).alias(m) for m in MEASURES))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows for documents that were counted as old and count as new: another text, group or tokenizer version."""
    return deletes(old).unionByName(inserts(new))


def history(docs: DataFrame, labels: DataFrame, tokenizers: dict[str, tuple[str, bool]]) -> dict[str, DataFrame]:
    """Batches by id, as they come about in a corpus: each tokenizer version loads all documents; documents labelled toxic are
    deleted; others that are labelled bad are revised, as they move to the source 'quarantine'."""
    counted = written(counts(docs, tokenizers), "counted")
    said = lambda c, v: F.max(F.coalesce(F.col(c) == v, F.lit(False)))
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("toxic", 1).alias("toxic"), said("quality", 0).alias("bad"))
    of = written(of.where("toxic or bad"), "labelled")
    bad = counted.join(of.where("bad and not toxic").select("doc_id"), "doc_id", "left_semi")
    out = {f"load {v}": inserts(counted.where(F.col("tokenizer_version") == v)) for v in tokenizers}
    out["delete toxic"] = deletes(counted.join(of.where("toxic").select("doc_id"), "doc_id", "left_semi"))
    out["quarantine bad"] = revisions(bad, bad.withColumn("source", F.lit("quarantine")))
    return out


class Rollup:
    """Additive totals in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        prepare(spark)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def committed(self, batch: str) -> bool:
        return self._there(self._place(batch)) or self._there(f"{self.folder}/_folded/{batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows; False if this batch is there already, and then nothing changes."""
        if self.committed(batch):
            return False
        aside = f"{self.folder}/_aside-{uuid.uuid4().hex}"
        self._sums(changes).write.parquet(aside)
        return self._move(aside, self._place(batch))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens, n_bytes; groups whose documents are all gone don't show."""
        places = self._places()
        if not places:
            return self.spark.createDataFrame([], SUMS)
        return self._sums(self.spark.read.schema(SUMS).parquet(*places)).where(" or ".join(f"{m} <> 0" for m in MEASURES))

    def fold(self) -> int:
        """Sum the last fold and all batches after it into a new fold; how many batches that took in. One folder folds at a time."""
        places = self._places()
        batches = [p.rpartition("/batch=")[2] for p in places if "/batch=" in p]
        if not batches:
            return 0
        aside = f"{self.folder}/_aside-{uuid.uuid4().hex}"
        self._sums(self.spark.read.schema(SUMS).parquet(*places)).write.parquet(aside)
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.parquet(f"{aside}/_batches")
        if not self._move(aside, f"{self.folder}/fold={self._folds()[-1] + 1 if self._folds() else 0:09d}"):
            return 0
        self._settle()
        return len(batches)

    def _settle(self) -> None:
        """Mark and delete what the last fold took in; after a crash, the rest of it."""
        last = f"{self.folder}/fold={self._folds()[-1]:09d}"
        for r in self.spark.read.schema("batch string").parquet(f"{last}/_batches").toLocalIterator():
            self._fs.mkdirs(self._path(f"{self.folder}/_folded/{r['batch']}"))
            self._fs.delete(self._path(self._place(r["batch"])), True)
        for k in self._folds()[:-1]:
            self._fs.delete(self._path(f"{self.folder}/fold={k:09d}"), True)

    def _places(self) -> list[str]:
        """The last fold, and batches that are not in it."""
        folds = self._folds()
        if folds:
            self._settle()
        names = [f"fold={k:09d}" for k in folds[-1:]] + sorted(n for n in self._names() if n.startswith("batch="))
        return [f"{self.folder}/{n}" for n in names]

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]

    def _folds(self) -> list[int]:
        return sorted(int(n.removeprefix("fold=")) for n in self._names() if n.startswith("fold="))

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))

    def _there(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def _place(self, batch: str) -> str:
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.folder}/batch={batch}"

    def _move(self, aside: str, to: str) -> bool:
        """Move a folder to its place, of which there is none yet. Who comes second in a race is moved inside the first's, unseen as
        its name begins with _, and goes away from there."""
        inside = self._path(f"{to}/{aside.rpartition('/')[2]}")
        moved = not self._there(to) and bool(self._fs.rename(self._path(aside), self._path(to)))
        if moved and self._fs.exists(inside):
            self._fs.delete(inside, True)
            return False
        if not moved:
            self._fs.delete(self._path(aside), True)
        return moved
