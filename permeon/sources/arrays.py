"""Images and arrays as Spark data sources: partitions are byte ranges of the files, and only these are read.

`nifti`: (image_id, path, t, i, j, k, value) of NIfTI-1 images. A partition is some planes of one volume of one image, which lie next to
each other in the file; with a box (of a mask) the planes outside are no partitions, and of the others only the rows inside are read. Values
outside the box along the first axis are dropped where they are read.
`npy`: (sample_id, x array<double>) of a matrix; a partition is some rows, or, where the file is in column order, a range of rows of which
every column's part is read.

Files are read by ranges through pyarrow's file systems: local and shared paths, and stores with a URI that pyarrow knows. Gzipped images
can't be entered in the middle: each is one partition, decompressed as a stream up to the last plane of the box and given on plane by
plane. Headers, some hundred bytes a file, are read while the scan is planned.
"""

from __future__ import annotations

import ast
import json
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, and of what is read at a time.
PART_BYTES, READ_BYTES = 16 << 20, 4 << 20
#: NIfTI-1 data type codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: Bytes of a NIfTI-1 header.
HEADER = 348


class Ranges:
    """A file of which ranges of bytes are read, and how many bytes that were."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        if "://" in path or path.startswith("file:"):
            system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        else:
            system, inner = fs.LocalFileSystem(), path
        self.file, self.bytes = system.open_input_file(inner), 0

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(size)
        self.bytes += len(data)
        return data

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


@dataclass(frozen=True)
class Header:
    """What a NIfTI-1 header says of the numbers: shape (i, j, k, t), type, where they start, and their scale."""

    shape: tuple[int, int, int, int]
    dtype: str
    offset: int
    slope: float
    shift: float
    affine: tuple

    def values(self, data: bytes) -> np.ndarray:
        x = np.frombuffer(data, self.dtype).astype(np.float64)
        return x * (self.slope or 1) + self.shift if self.slope not in (0, 1) or (self.slope and self.shift) else x


def header(raw: bytes) -> Header:
    """From the first bytes of an (unzipped) file."""
    order = next((o for o in "<>" if len(raw) >= HEADER and struct.unpack_from(o + "i", raw)[0] == HEADER), None)
    if order is None:
        raise ValueError("not a NIfTI-1 file")
    field = lambda kind, at: struct.unpack_from(order + kind, raw, at)
    dim, code = field("8h", 40), field("h", 70)[0]
    if code not in NIFTI_TYPES:
        raise ValueError(f"unsupported NIfTI data type {code}")
    sizes = dim[1 : dim[0] + 1]
    if any(n > 1 for n in sizes[4:]):
        raise ValueError(f"an image of more than four dimensions: {sizes}")
    shape = (*sizes[:4], *[1] * (4 - len(sizes[:4])))
    offset, slope, shift = field("3f", 108)
    return Header(tuple(int(n) for n in shape), order + NIFTI_TYPES[code], int(offset), slope, shift, tuple(map(tuple, affine(raw, order).tolist())))


def affine(raw: bytes, order: str) -> np.ndarray:
    """Voxels to world: the sform if there is one, else the qform's rotation, else the voxels' sizes."""
    pixdim, (qform, sform) = struct.unpack_from(order + "8f", raw, 76), struct.unpack_from(order + "2h", raw, 252)
    out = np.eye(4)
    if sform > 0:
        out[:3] = np.array(struct.unpack_from(order + "12f", raw, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, x, y, z = struct.unpack_from(order + "6f", raw, 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        cross = np.array([[0, -d, c], [d, 0, -b], [-c, b, 0]])  # of the unit quaternion a + bi + cj + dk
        axis = np.array([b, c, d])
        turn = (a * a - axis @ axis) * np.eye(3) + 2 * np.outer(axis, axis) + 2 * a * cross
        out[:3, :3] = turn * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
        out[:3, 3] = x, y, z
    else:
        out[[0, 1, 2], [0, 1, 2]] = pixdim[1:4]
    return out


def gzipped(path: str) -> bool:
    return path.lower().endswith(".gz")


def head_of(path: str) -> Header:
    with Ranges(path) as file:
        if not gzipped(path):
            return header(file.at(0, HEADER + 4))
        unzip, raw, at = zlib.decompressobj(31), b"", 0
        while len(raw) < HEADER and (data := file.at(at, 4096)):
            raw, at = raw + unzip.decompress(data), at + len(data)
        return header(raw)


def clipped(box: list[list[int]] | None, shape: tuple) -> list[tuple[int, int]]:
    """The box's half-open ranges on the first three axes, inside the image."""
    box = box or [[0, n] for n in shape[:3]]
    return [(max(0, lo), max(0, lo, min(hi, n))) for (lo, hi), n in zip(box, shape)]


@dataclass
class Planes:
    """Planes lo .. hi - 1 of volume t of an image (t None: of all its volumes)."""

    image_id: int
    path: str
    head: Header
    t: int | None
    lo: int
    hi: int


@dataclass
class Bundle(InputPartition):
    """Planes of one image or of several small ones."""

    parts: list[Planes]


class NiftiReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"])
        self.box = json.loads(options.get("box", "null"))
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Bundle]:
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(head_of, self.paths))
        out, held = [], 0
        for i, (path, head) in enumerate(zip(self.paths, heads)):
            lo, hi = clipped(self.box, head.shape)[2]
            plane = head.shape[0] * head.shape[1] * np.dtype(head.dtype).itemsize
            step = max(1, self.part_bytes // max(1, plane))
            parts = [Planes(i, path, head, t, k, min(k + step, hi)) for t in range(head.shape[3]) for k in range(lo, hi, step)]
            for part in [Planes(i, path, head, None, lo, hi)] if gzipped(path) else parts:
                size = plane * (part.hi - part.lo) * (head.shape[3] if part.t is None else 1)
                if not out or held + size > self.part_bytes:
                    out.append(Bundle([]))
                    held = 0
                out[-1].parts.append(part)
                held += size
        return out

    def read(self, bundle: Bundle | None) -> Iterator[pa.RecordBatch]:
        for part in bundle.parts if bundle else []:  # None: there are no partitions
            with Ranges(part.path) as file:
                for t, k, rows in (unzipped if part.t is None else ranged)(file, part, self.box):
                    yield plane(part, self.box, t, k, rows)


def ranged(file: Ranges, part: Planes, box) -> Iterator[tuple[int, int, bytes]]:
    """(t, k, the rows inside the box) of planes: one range a plane, or one for some whole planes."""
    ni, nj, nk, _ = part.head.shape
    size = np.dtype(part.head.dtype).itemsize
    (j0, j1), row = clipped(box, part.head.shape)[1], ni * size
    if j1 <= j0:
        return
    start = lambda k: part.head.offset + ((part.t * nk + k) * nj + j0) * row
    whole = j1 - j0 == nj
    step = max(1, READ_BYTES // max(1, nj * row)) if whole else 1
    for k in range(part.lo, part.hi, step):
        n = min(step, part.hi - k)
        data = file.at(start(k), n * nj * row if whole else (j1 - j0) * row)
        for i in range(n):
            yield part.t, k + i, data[i * nj * row : (i + 1) * nj * row] if whole else data


def unzipped(file: Ranges, part: Planes, box) -> Iterator[tuple[int, int, bytes]]:
    """The same from a gzipped image, as a stream."""
    ni, nj, nk, nt = part.head.shape
    (j0, j1), row = clipped(box, part.head.shape)[1], ni * np.dtype(part.head.dtype).itemsize
    unzip, held, at, start = zlib.decompressobj(31), bytearray(), 0, 0  # held: unzipped bytes from `start` on
    for t in range(nt):
        for k in range(part.lo, part.hi):
            lo = part.head.offset + ((t * nk + k) * nj + j0) * row
            hi = lo + (j1 - j0) * row
            while start + len(held) < hi:
                if not (data := file.at(at, READ_BYTES // 4)):
                    raise ValueError(f"{part.path} ends early")
                at += len(data)
                while data:
                    held += unzip.decompress(data)
                    data = unzip.unused_data
                    if data:  # another member
                        unzip = zlib.decompressobj(31)
                drop = min(lo - start, len(held))
                if drop > 0:
                    del held[:drop]
                    start += drop
            yield t, k, bytes(held[lo - start : hi - start])


def plane(part: Planes, box, t: int, k: int, rows: bytes) -> pa.RecordBatch:
    (i0, i1), (j0, j1), _ = clipped(box, part.head.shape)
    x = part.head.values(rows).reshape(j1 - j0, part.head.shape[0])[:, i0:i1]
    n = x.size
    i, j = np.tile(np.arange(i0, i1, dtype=np.int32), j1 - j0), np.repeat(np.arange(j0, j1, dtype=np.int32), i1 - i0)
    same = lambda v, kind: pa.array(np.full(n, v, kind))
    names = ["image_id", "path", "t", "i", "j", "k", "value"]
    return pa.RecordBatch.from_arrays([same(part.image_id, np.int64), pa.array([part.path] * n, pa.string()), same(t, np.int32), pa.array(i), pa.array(j), same(k, np.int32), pa.array(x.ravel())], names=names)


class NiftiSource(DataSource):
    """Options: paths (a JSON list), box (JSON: [[i0, i1], [j0, j1], [k0, k1]], half-open), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return "image_id bigint, path string, t int, i int, j int, k int, value double"

    def reader(self, schema) -> NiftiReader:
        return NiftiReader({k.lower(): v for k, v in self.options.items()})


@dataclass(frozen=True)
class Matrix:
    """What an .npy file's header says."""

    shape: tuple[int, int]
    dtype: str
    by_column: bool
    offset: int


def matrix_head(file: Ranges) -> Matrix:
    start = file.at(0, 12)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    wide = start[6] > 1
    size = struct.unpack_from("<I" if wide else "<H", start, 8)[0]
    offset = (12 if wide else 10) + size
    told = ast.literal_eval(file.at(offset - size, size).decode("utf-8" if start[6] > 2 else "latin-1"))
    shape, dtype = told["shape"], np.dtype(told["descr"])
    if dtype.kind not in "biuf" or len(shape) > 2:
        raise ValueError(f"an array of numbers with two dimensions at most is needed, not {dtype} {shape}")
    return Matrix((1, *shape) if len(shape) == 1 else shape or (1, 1), dtype.str, bool(told["fortran_order"]) and len(shape) == 2, offset)


@dataclass
class Rows(InputPartition):
    """Rows lo .. hi - 1 of a file, of which the first has a number."""

    path: str
    head: Matrix
    lo: int
    hi: int
    number: int


def matrix_of(path: str) -> Matrix:
    with Ranges(path) as file:
        return matrix_head(file)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.part_bytes = json.loads(options["paths"]), int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Rows]:
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(matrix_of, self.paths))
        if len({h.shape[1] for h in heads}) > 1:
            raise ValueError(f"files with different numbers of columns: {sorted({h.shape[1] for h in heads})}")
        out, before = [], 0
        for path, head in zip(self.paths, heads):
            n, width = head.shape
            step = max(1, self.part_bytes // max(1, width * np.dtype(head.dtype).itemsize))
            out += [Rows(path, head, lo, min(lo + step, n), before + lo) for lo in range(0, n, step)]
            before += n
        return out

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no partitions
            return
        (n, width), dtype = part.head.shape, part.head.dtype
        size, start = np.dtype(dtype).itemsize, part.head.offset
        with Ranges(part.path) as file:
            if part.head.by_column:
                columns = [np.frombuffer(file.at(start + (c * n + part.lo) * size, (part.hi - part.lo) * size), dtype) for c in range(width)]
                yield rows(part.number, np.stack(columns, 1) if columns else np.empty((part.hi - part.lo, 0)))
                return
            step = max(1, READ_BYTES // max(1, width * size))
            for lo in range(part.lo, part.hi, step):
                hi = min(lo + step, part.hi)
                yield rows(part.number + lo - part.lo, np.frombuffer(file.at(start + lo * width * size, (hi - lo) * width * size), dtype).reshape(hi - lo, width))


def rows(first: int, x: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x), dtype=np.int64)), pa.ListArray.from_arrays(ends, pa.array(x.astype(np.float64).ravel()))], names=["sample_id", "x"])


class NpySource(DataSource):
    """Options: paths (a JSON list), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "sample_id bigint, x array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader({k.lower(): v for k, v in self.options.items()})


def read_images(spark: SparkSession, paths: list[str], box: list[list[int]] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Voxels of images; image_id is the place in the list. box: only those inside."""
    spark.dataSource.register(NiftiSource)
    return spark.read.format("nifti").option("paths", json.dumps([str(p) for p in paths])).option("box", json.dumps(box)).option("partBytes", part_bytes).load()


def read_npy(spark: SparkSession, paths: str | list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of a matrix, or of several, one after the other; a vector is one row."""
    spark.dataSource.register(NpySource)
    paths = [paths] if isinstance(paths, str) else [str(p) for p in paths]
    return spark.read.format("npy").option("paths", json.dumps(paths)).option("partBytes", part_bytes).load()


def create(path: str, data: bytes) -> None:
    """A file in any file system that pyarrow knows, with the folders that it needs."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner, compression=None) as out:
        out.write(data)


def write_npy(rows: DataFrame, folder: str, partitions: int | None = None) -> list[str]:
    """rows (sample_id, x array) as .npy files under a folder, a range of sample_ids each, written by the tasks; their paths, in order. What
    read_npy makes of them has the rows in the order of their sample_ids."""
    import io

    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        held = [f for f in frames if len(f)]
        if held:
            buffer = io.BytesIO()
            np.save(buffer, np.stack([np.asarray(x, np.float64) for f in held for x in f["x"]]))
            path = f"{folder}/part-{TaskContext.get().partitionId():06d}.npy"
            create(path, buffer.getvalue())
            yield pd.DataFrame({"path": [path]})

    ordered = rows.select("sample_id", "x").repartitionByRange(n, "sample_id").sortWithinPartitions("sample_id")
    return sorted(r[0] for r in ordered.mapInPandas(run, "path string").collect())


def write_images(voxels: DataFrame, folder: str, shape: tuple[int, int, int], affine: np.ndarray, compress: bool = True) -> list[str]:
    """voxels (image_id, t, i, j, k, value) as NIfTI-1 images, an image a task; what is not there is 0. Their paths, by image_id."""
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        from .loaders import Volume, nifti_bytes

        data = np.zeros((*shape, int(f["t"].max()) + 1))
        data[f["i"], f["j"], f["k"], f["t"]] = f["value"]
        path = f"{folder}/image-{int(f['image_id'].iloc[0]):09d}.nii{'.gz' if compress else ''}"
        create(path, nifti_bytes(Volume(data, affine), compress))
        return pd.DataFrame({"path": [path]})

    return sorted(r[0] for r in voxels.groupBy("image_id").applyInPandas(run, "path string").collect())
