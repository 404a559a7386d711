"""Operator 4: token ids as one succinct file per shard, a wavelet matrix.

A shard's ids are stored as bit planes, from the highest bit to the lowest. Each plane holds its bit of every id in the
order that the planes above leave: ids with a 0 first, then ids with a 1, each in their former order. With ranks over
the planes one can read any id, count an id in any prefix and find its k-th occurrence without unpacking the shard.

File: magic, number of ids, of documents and of planes; then blocks, each with its length: document ids, their validity,
document lengths (compressed with zstd), the ranks of each plane at every STEP bits, and how long each plane's pieces of PIECE
bytes are, compressed one by one; then the pieces. A reader unpacks only the pieces that a question touches: reading one id, or
counting a token, takes two small pieces a plane. count_tokens() and occurrences() ask all files of a folder.

Plan: documents are encoded where they are read; blobs of ids are dealt to ranges of doc_id (boundaries from quantiles of
the id column alone), sorted there, and each range cuts files of at most `shard_tokens` ids while it streams. A file's
place in the whole is its range's offset (one number a range, at most MAX_RANGES) plus its offset in the range.

Null and empty texts: the end id alone. Null doc_ids come first. Repeated doc_ids: each row is a document, ordered by its
ids, so ties don't matter. A very long document, of more than shard_tokens, gets a file of its own. Empty table: no file. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._encode import library_encoder
from ._session import prepare, schema, scratch_path, shuffle_partitions

MAGIC = b"WMX2"
HEAD = struct.Struct("<4sQQB")
#: Bits between two stored ranks.
STEP = 512
#: Bytes of a plane that are compressed together.
PIECE = 8192
MAX_RANGES = 20_000
SHARD_TOKENS = 1 << 20


class WaveletMatrix:
    """Ids in bit planes with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray]) -> None:
        """planes: packed bits, the highest plane first."""
        self.n, self.depth, self._planes = n, len(planes), planes
        self._ranks: np.ndarray | None = None

    @classmethod
    def stored(cls, n: int, ranks: np.ndarray, sizes: np.ndarray, data: memoryview) -> WaveletMatrix:
        """From a file's ranks and pieces, which are unpacked when they are asked for."""
        m = cls(n, [])
        m.depth, m._ranks, m._data = len(ranks), ranks, data
        m._ends = np.cumsum(sizes.ravel(), dtype=np.int64)
        m._pieces, m._a_plane, m._unpack = {}, sizes.shape[1], zstandard.ZstdDecompressor()
        return m

    def piece(self, level: int, p: int) -> np.ndarray:
        """A plane's bytes from p * PIECE."""
        if self._planes:
            return self._planes[level][p * PIECE : (p + 1) * PIECE]
        i = level * self._a_plane + p
        if i not in self._pieces:
            lo = int(self._ends[i - 1]) if i else 0
            self._pieces[i] = np.frombuffer(self._unpack.decompress(self._data[lo : int(self._ends[i])]), np.uint8)
        return self._pieces[i]

    def plane(self, level: int) -> np.ndarray:
        if self._planes:
            return self._planes[level]
        return np.concatenate([self.piece(level, p) for p in range(self._a_plane)]) if self._a_plane else np.empty(0, np.uint8)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        left = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for b in range(bits - 1, -1, -1):
            one = ((left >> b) & 1).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            if b:
                left = np.concatenate((np.compress(~one, left), np.compress(one, left)))
        return cls(len(ids), planes)

    def bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.plane(level), count=self.n, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        k = self.depth
        low = np.zeros(self.n, np.uint16 if k <= 16 else np.uint32)
        for level in range(k - 1, -1, -1):
            one = self.bits(level)
            # places beat masks here by half
            zeros, ones = np.flatnonzero(~one), np.flatnonzero(one)
            back = np.empty_like(low)
            back[zeros] = low[: len(zeros)]
            back[ones] = low[len(zeros) :] | low.dtype.type(1 << (k - 1 - level))
            low = back
        return low

    @property
    def ranks(self) -> np.ndarray:
        """For each plane how many ones stand before each STEP bits, and in all."""
        if self._ranks is None:
            self._ranks = np.zeros((self.depth, -(-self.n // STEP) + 1), np.uint32)
            for level, plane in enumerate(self._planes):
                padded = np.concatenate((plane, np.zeros(-len(plane) % (STEP // 8), np.uint8)))
                np.cumsum(np.bitwise_count(padded).reshape(-1, STEP // 8).sum(1, dtype=np.uint32), out=self._ranks[level, 1:])
        return self._ranks

    def zeros(self, level: int) -> int:
        return self.n - int(self.ranks[level, -1])

    def _ones(self, level: int, i: int) -> int:
        """Ones in the plane's first i bits."""
        block = i // STEP
        ones = int(self.ranks[level, block])
        if i % STEP:
            start, full = block * STEP // 8 % PIECE, i // 8 % PIECE
            part = self.piece(level, i // 8 // PIECE)
            ones += int(np.bitwise_count(part[start:full]).sum())
            if i % 8:
                ones += (int(part[full]) & ((1 << i % 8) - 1)).bit_count()
        return ones

    def _bit(self, level: int, i: int) -> int:
        return int(self.piece(level, i // 8 // PIECE)[i // 8 % PIECE]) >> i % 8 & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.depth):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros(level) + ones if bit else i - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int] | None:
        """Where the token's occurrences among the first `end` ids lie below the last plane."""
        k = self.depth
        if token >> k:
            return None
        lo, hi = 0, end
        for level in range(k):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros(level) + a, self.zeros(level) + b) if token >> (k - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often the token stands among the first i ids."""
        found = self._range(token, min(i, self.n))
        return found[1] - found[0] if found else 0

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the token's occurrence number k, from 0."""
        found = self._range(token, self.n)
        if not found or not 0 <= k < found[1] - found[0]:
            raise IndexError(k)
        i, depth = found[0] + k, self.depth
        for level in range(depth - 1, -1, -1):
            one = token >> (depth - 1 - level) & 1
            i = self._place(level, one, i - self.zeros(level) if one else i)
        return i

    def _place(self, level: int, bit: int, k: int) -> int:
        """Where the plane's bit number k of that value stands."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * STEP - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        start = block * STEP // 8
        part = self.piece(level, start // PIECE)[start % PIECE : start % PIECE + STEP // 8]
        return block * STEP + int(np.flatnonzero(np.unpackbits(part, bitorder="little") == bit)[k - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard's file."""
    matrix, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in doc_ids], bool)
    planes = [matrix.plane(level).tobytes() for level in range(matrix.depth)]
    pieces = [[pack.compress(p[lo : lo + PIECE]) for lo in range(0, len(p), PIECE)] for p in planes]
    blocks = [pack.compress(b.tobytes()) for b in (np.array([d or 0 for d in doc_ids], "<i8"), known, np.array(lengths, "<i8"))]
    blocks += [matrix.ranks.astype("<u4").tobytes(), np.array([[len(p) for p in plane] for plane in pieces], "<u4").tobytes()]
    out = [HEAD.pack(MAGIC, len(ids), len(doc_ids), matrix.depth)]
    for b in blocks:
        out += [struct.pack("<Q", len(b)), b]
    return b"".join([*out, *(p for plane in pieces for p in plane)])


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths, and the ids."""
    magic, n, docs, planes = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a wavelet matrix file")
    at, blocks, unpack = HEAD.size, [], zstandard.ZstdDecompressor()
    for _ in range(5):
        (size,) = struct.unpack_from("<Q", data, at)
        blocks.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    ids, known, lengths = map(unpack.decompress, blocks[:3])
    doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(ids, "<i8"), np.frombuffer(known, bool))]
    ranks, sizes = (np.frombuffer(b, "<u4").reshape(planes, -1) for b in blocks[3:])
    return doc_ids, np.frombuffer(lengths, "<i8"), WaveletMatrix.stored(n, ranks, sizes, memoryview(data)[at:])


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, byte_level: bool = True) -> None:
    """Encode documents and write one file a shard: rows (range, shard, range_start, n_tokens, file) in `folder`."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = min(MAX_RANGES, shuffle_partitions(spark))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    bounds = np.array(cuts, float)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, byte_level)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            at = [-1 if d is None else int(np.searchsorted(bounds, d, side="right")) for d in doc_ids]
            ids = [np.frombuffer(x + end, "<u4") for x in encoder.encode_batch(batch.column(1).to_pylist())]
            # two bytes an id while it crosses the network, where that is enough
            ids = [b"2" + x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"4" + x.tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), pa.array(ids, pa.binary())], names=["range", "doc_id", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, before, held, doc_ids, ids = None, 0, 0, 0, [], []

        def file() -> pa.RecordBatch:
            data = to_file(doc_ids, [len(x) for x in ids], np.concatenate(ids))
            row = ([at], pa.int32()), ([shard], pa.int32()), ([before], pa.int64()), ([held], pa.int64()), ([data], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(*x) for x in row], names=["range", "shard", "range_start", "n_tokens", "file"])

        for batch in batches:
            for r, d, x in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(x, "<u2" if x[:1] == b"2" else "<u4", offset=1)
                if ids and (r != at or held + len(x) > shard_tokens):
                    yield file()
                    before, shard, held, doc_ids, ids = before + held, shard + 1, 0, [], []
                if r != at:
                    at, shard, before = r, 0, 0
                held += len(x)
                doc_ids.append(d)
                ids.append(x)
        if ids:
            yield file()

    dealt = docs.mapInArrow(encode, schema("range int, doc_id bigint, ids binary")).repartition(max(1, ranges), "range").sortWithinPartitions("range", "doc_id", "ids")
    files = dealt.mapInArrow(build, schema(FILES))
    files.write.option("compression", "none").parquet(folder)


FILES = "range int, shard int, range_start bigint, n_tokens bigint, file binary"


def first_places(files: DataFrame) -> dict[int, int]:
    """How many ids stand before each range."""
    totals = {r["range"]: r["total"] for r in files.groupBy("range").agg(F.sum("n_tokens").alias("total")).collect()}  # at most MAX_RANGES numbers
    first, at = {}, 0
    for r in sorted(totals):
        first[r], at = at, at + totals[r]
    return first


def count_tokens(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of some tokens stands in all files, by ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                matrix = from_file(data)[2]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    prepare(spark)
    files = spark.read.schema(FILES).parquet(folder).select("file")
    return files.mapInArrow(run, schema("token bigint, n bigint")).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """doc_id, position (in the document, from 0), place (in the whole) of each occurrence of a token, by select."""
    prepare(spark)
    files = spark.read.schema(FILES).parquet(folder)
    first = first_places(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, inner, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids, lengths, matrix = from_file(data)
                places = np.array(matrix.occurrences(token), np.int64)
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, places, side="right")
                out = ([doc_ids[d] for d in doc.tolist()], places - (ends - lengths)[doc], places + first[r] + inner)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "position", "place"])

    return files.select("range", "range_start", "file").mapInArrow(run, schema("doc_id bigint, position bigint, place bigint"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone."""
    files = spark.read.schema(FILES).parquet(folder)
    prepare(spark)
    first = first_places(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, inner, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids, lengths, matrix = from_file(data)
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(lengths, ends)]
                out = (doc_ids, ends - lengths + first[r] + inner, lengths, crc)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("range", "range_start", "file").mapInArrow(read, schema("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch_path(spark, "tokens")
    write_files(docs, tokenizer, folder, end_id)
    return read_files(spark, folder)
