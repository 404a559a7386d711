"""Blocks of whole documents: the unit in which corpus-wide text operators work and exchange short messages.

A block is made where its documents are read (no shuffle), written once, and named by a number that is fixed from then
on. Operators send requests from blocks to shards (ranges of a hash) and get replies back as packed bits or numbers, so
what crosses the network is a few bytes a position, not the texts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import schema, written

BLOCK_BYTES = 3 << 20


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed blob."""
    out = []
    for a in arrays:
        data = a if isinstance(a, bytes) else a.tobytes()
        out += [struct.pack("<Q", len(data)), data]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(blob: bytes) -> list[bytes]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


class Block:
    """Documents of a block: ids (with validity), groups, and their texts' bytes, one after the other."""

    def __init__(self, blob: bytes) -> None:
        ids, known, groups, ends, self.text, *rest = unpack(blob)
        self.rest = rest[0] if rest else None
        self.known = np.frombuffer(known, bool)
        self.ids = np.frombuffer(ids, "<i8")
        self.groups = groups.decode().split("\0")
        self.ends = np.frombuffer(ends, "<i8")
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)

    def carried(self) -> pa.Table:
        """The documents' other columns (see blocks())."""
        return pa.ipc.open_stream(self.rest).read_all()

    def doc_ids(self) -> list[int | None]:
        return [int(d) if k else None for d, k in zip(self.ids, self.known)]


def carried_name(i: int) -> str:
    return f"carried_{i}"


def blocks(docs: DataFrame, what: str, group: str | None = None, size: int = BLOCK_BYTES, buckets: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """block long, docs binary (see Block), bytes long. group: a string column, free of zero characters, that is kept for each document.
    buckets: so many buckets by block, which a join on it reads in place. carry: columns of any type that go along as Arrow data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rests, n = [], [], 0

        def block() -> pa.RecordBatch:
            ids, groups, texts = zip(*held)
            rest = []
            if carry:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rests[0].schema) as stream:
                    for r in rests:
                        stream.write_batch(r)
                rest = [sink.getvalue().to_pybytes()]
            blob = pack(
                np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], bool), "\0".join(groups).encode(),
                np.cumsum([len(t) for t in texts], dtype="<i8"), b"".join(texts), *rest,
            )
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([n], pa.int64())], names=["docs", "bytes"])

        for batch in batches:
            other, first = batch.select(list(range(3, batch.num_columns))), 0
            for at, (i, g, t) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                t = (t or "").encode()
                if held and n + len(t) > size:
                    rests.append(other.slice(first, at - first))
                    yield block()
                    held, rests, n, first = [], [], 0, at
                held.append((i, (g or "").replace("\0", ""), t))
                n += len(t)
            rests.append(other.slice(first))
        if held:
            yield block()

    rest = [F.col(f"`{c}`").alias(carried_name(i)) for i, c in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(group) if group else F.lit(None)).cast("string").alias("grp"), F.col("text").cast("string").alias("text"), *rest)
    made = rows.mapInArrow(run, schema("docs binary, bytes bigint"))
    return written(made.select(F.monotonically_increasing_id().alias("block"), "docs", "bytes"), what, ("block", buckets) if buckets else None)
