"""Operator 5: packing documents into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one remainder. How often each remainder length occurs is all that packing
needs: at most `window` numbers, whatever the corpus. Windows are then filled one pattern at a time: the longest length
left opens the window; a dynamic program over bitsets (bit t is set if some multiset of the lengths left sums to t) finds
the multiset that comes closest to filling it; backtracking gives how many of each length it takes; the pattern is
repeated as often as the counts allow. Each repeat uses up a length, so there are at most `window` patterns.

Pieces get their place natively: their rank among pieces of their length comes from counts of (length, bucket) and a
row number within, so a length that a third of the pieces share is dealt to many tasks; the pattern table, bounded by
the window, is broadcast.

Null and empty texts: the end id alone. Repeated rows are documents of their own. A null doc_id stays null. Empty table:
no rows. Extra columns are ignored. Every window but the last patterns' is full or as near as the lengths allow.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._encode import library_encoder
from ._session import lean, prepare, schema, shuffle_partitions, written

WINDOW = 4096


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most counts of each) whose sum comes closest to room, not above it."""
    reach, steps = 1, []
    mask, goal = (1 << room + 1) - 1, 1 << room
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, take = left - take, take * 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return dict(chosen)


def patterns(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(repeats, lengths of each window), until all lengths are used up."""
    left, out = {x: c for x, c in counts.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = Counter(closest(left, window - longest))
        pattern[longest] += 1
        left[longest] += 1
        repeats = min(left[x] // c for x, c in pattern.items())
        out.append((repeats, dict(pattern)))
        for x, c in pattern.items():
            left[x] -= repeats * c
            if not left[x]:
                del left[x]
    return out


def cut(docs: DataFrame, tokenizer: str, end_id: int, window: int, byte_level: bool) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        encoder = library_encoder(tokenizer, byte_level)
        for batch in batches:
            rows = [[] for _ in range(5)]
            for d, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for column, x in zip(rows, (d, start, len(piece) // 4, zlib.crc32(piece), n)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, byte_level: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    prepare(spark)
    buckets = max(64, 4 * shuffle_partitions(spark))
    pieces = written(cut(docs, tokenizer, end_id, window, byte_level).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    held = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    spans, used, sequence = [], Counter(), 0
    for repeats, pattern in patterns(counts, window):
        offset = 0
        for length, each in sorted(pattern.items(), reverse=True):
            spans.append((length, used[length], used[length] + repeats * each, each, sequence, offset))
            used[length] += repeats * each
            offset += each * length
        sequence += repeats
    spans = spark.createDataFrame(spans, schema("length bigint, lo bigint, hi bigint, each bigint, sequence bigint, base bigint"))
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    placed = pieces.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))
    s, p = F.broadcast(spans).alias("s"), placed.alias("p")
    i = F.col("p.at") - F.col("s.lo")
    return p.join(s, (F.col("p.length") == F.col("s.length")) & (F.col("p.at") >= F.col("s.lo")) & (F.col("p.at") < F.col("s.hi"))).select(
        "doc_id", "start", "p.length", "ids_crc32", "doc_tokens",
        (F.col("s.sequence") + F.floor(i / F.col("s.each"))).alias("sequence_id"),
        (F.col("s.base") + i % F.col("s.each") * F.col("p.length")).alias("offset"),
    )
