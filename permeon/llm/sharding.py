"""Operator 11: shards of nearly equal size by longest-processing-time scheduling; documents of a group stay together.

A group is a set of equal texts (or of rows with equal values in a column that the caller names). Its documents' sizes are summed
before the shuffle, so a group of very many copies is one short row. Scheduling has two heaps:

* A task holds some of the groups, sorted by size, and hands each to the least loaded of its bundles. Bundles come in levels: the
  first half of the task's bytes (its largest groups) goes to as many bundles as there are shards, the next quarter to as many
  again, and so on, so the last bundles are small enough to level what large groups leave uneven.
* The driver hands the bundles, largest first, to the least loaded shard. There are at most BUNDLES of them, however many groups there
  are, since tasks share names.

A group above the mean load has a shard nearly to itself, and that shard is as large as the group. Groups with at least a 4096th of
all documents (so 4096 at most) are broadcast to their documents; the others meet them in a shuffle of digests, not of texts. Slots come
from counts of (shard, bucket) and a row number within; a bucket is a share of the input's rows, whatever their ids or texts are.

Null and empty texts: one group of no bytes, 16 each. Repeated rows, equal and null doc_ids: rows of their own, of one group if their
texts agree. Very long texts: their size only matters. Ties: by digest, then bundle, then shard number. Empty table: no rows. Extra
columns are ignored. A group column's null is a group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._session import few, parts_for, prepare, schema, scratch_path, written

SHARDS = 40
#: Bytes that a document takes besides its text.
OVERHEAD = 16
LEVELS, BUNDLES = 12, 163_840
#: Groups with this share of the documents are broadcast.
HOT = 4096
#: Documents in a bucket of slots.
BUCKET_ROWS = 1_000_000


def longest_first(weights: np.ndarray, bins: int) -> tuple[np.ndarray, list[int]]:
    """For weights in descending order: the bin of each, always the least loaded; and the bins' loads."""
    heap, out = [(0, b) for b in range(bins)], np.empty(len(weights), np.int64)
    for i, w in enumerate(weights.tolist()):
        load, b = heap[0]
        out[i] = b
        heapq.heapreplace(heap, (load + w, b))
    return out, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def bundle(weights: np.ndarray, shards: int) -> np.ndarray:
    """For weights in descending order: each one's bundle, level * shards + bin."""
    passed = np.cumsum(weights) - weights
    left = 1 - passed / max(int(weights.sum()), 1)
    level = np.clip(np.floor(-np.log2(np.maximum(left, 2.0**-LEVELS))), 0, LEVELS - 1).astype(np.int64)
    out = level * shards
    for lv in np.unique(level):
        of = level == lv
        out[of] += longest_first(weights[of], shards)[0]
    return out


def _bundles(shards: int):
    names = max(1, BUNDLES // (LEVELS * shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        groups = pa.Table.from_batches(held)  # a partition of a shuffle, some 40 bytes a group
        of = bundle(groups["weight"].to_numpy(), shards)
        part = np.full(len(of), TaskContext.get().partitionId() % names)
        yield from groups.append_column("part", pa.array(part)).append_column("bundle", pa.array(of)).to_batches(50_000)

    return run


def _digest(group: str | None):
    """Of what keeps documents together, as 128 bits; a null in a group column differs from an empty string."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")) if group else text))


def _size():
    return (F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + F.lit(OVERHEAD)).cast("long")


def scheduled(sized: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """Rows' digest and size to (digest, copies, shard) for each group, and the number of rows."""
    spark = sized.sparkSession
    groups = sized.groupBy("digest").agg(F.sum("size").alias("weight"), F.count("*").alias("copies")).sortWithinPartitions(F.desc("weight"), "digest")
    groups = written(groups.mapInArrow(_bundles(shards), schema("digest binary, weight bigint, copies bigint, part bigint, bundle bigint")), "groups")
    bundles = groups.groupBy("part", "bundle").agg(F.sum("weight").alias("weight"), F.sum("copies").alias("n")).collect()  # BUNDLES at most, or LEVELS a shard
    bundles.sort(key=lambda r: (-r["weight"], r["part"], r["bundle"]))
    to, _ = longest_first(np.array([r["weight"] for r in bundles], np.int64), shards)
    plan = spark.createDataFrame([(r["part"], r["bundle"], int(s)) for r, s in zip(bundles, to)], schema("part bigint, bundle bigint, shard int"))
    return groups.join(F.broadcast(plan), ["part", "bundle"]).select("digest", "copies", "shard"), sum(r["n"] for r in bundles)


def _with_shard(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Rows with a digest, and their group's shard."""
    hot = F.col("copies") * HOT >= n
    known = rows.join(F.broadcast(groups.where(hot).select("digest", F.col("shard").alias("known"))), "digest", "left")
    cold = known.where("known is null").drop("known").join(groups.where(~hot).select("digest", "shard"), "digest")
    return cold.unionByName(known.where("known is not null").withColumnRenamed("known", "shard")).drop("digest")


def assign(docs: DataFrame, shards: int = SHARDS, group: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, for every row. group: rows with equal values in this column stay together (None: texts)."""
    prepare(docs.sparkSession)
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32")
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size"), crc, _digest(group).alias("digest"), F.monotonically_increasing_id().alias("row")), "sized")
    groups, n = scheduled(sized, shards)
    buckets = parts_for(n, BUCKET_ROWS * shards, 8)
    placed = written(_with_shard(sized, groups, n).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")), "placed")
    held = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = few(written(held.select("shard", "bucket", before.alias("before")), "starts"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")) - 1
    return placed.withColumn("inside", inside).join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).alias("slot"))


def write_shards(docs: DataFrame, folder: str | None = None, shards: int = SHARDS, group: str | None = None) -> str:
    """Write whole documents with all their columns to folder/shard=N as Parquet; returns the folder. Columns named shard, digest or known
    are left out."""
    prepare(docs.sparkSession)
    docs = docs.drop("shard", "digest", "known")
    folder = folder or scratch_path(docs.sparkSession, "shards")
    groups, n = scheduled(docs.select(_digest(group).alias("digest"), _size().alias("size")), shards)
    _with_shard(docs.withColumn("digest", _digest(group)), groups, n).write.partitionBy("shard").parquet(folder)
    return folder
