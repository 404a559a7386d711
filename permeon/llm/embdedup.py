"""Operator 7: near-duplicate vectors by cosine, compared inside cells of a spherical k-means.

Equal vectors are one row with a multiplicity. Centroids come from a sample of at most SAMPLE vectors; there is one for each
CELL_ROWS rows, MOST_CELLS at most, so they may be broadcast, and fewer where a vector would be a guest of more than GUESTS cells on
average (spread-out vectors of many dimensions are near most borders): what travels is then a bounded number of copies. Every vector goes to its nearest centroid's cell, its home, and as a
guest to each cell whose border (the plane half-way between both centroids) is at most REACH away. Unit vectors of cosine 0.95 are
at most 2 * REACH apart, so of two of them with different homes one at least is within REACH of the other's cell: no link is
lost, and guests need no comparison with each other.

A cell is compared in blocks: its vectors travel packed, are dealt to blocks of about BLOCK rows or BLOCK_BYTES by a hash, and each pair of
blocks of homes, and of homes and guests, is a task, however large the cell is. Products in single precision, whose error is bounded, leave
out what is far below COSINE; the rest is decided in double precision. A task returns, for each vector, how many it links with (multiplicities
counted) and one edge to the smallest member of its group among all the task's links; never the pairs, of which a group of
copies has a square.

Result: vec_id, n_links, component_id, kept. Vectors that are null, zero or hold null or non-finite components: n_links 0,
their own component, kept. A null vec_id: n_links 0, component null, kept. Repeated rows link with each other (equal
vectors); rows that share a vec_id count their own links and are of one component. Vectors of different lengths are compared only with their like. Ties at the threshold link. Empty table: no rows. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import pack, unpack
from ._components import components
from ._session import prepare, schema, written
from ._vectors import matrix, sample, vectors

COSINE = 0.95
REACH = (2 - 2 * COSINE) ** 0.5 / 2 + 1e-9
SAMPLE, CELL_ROWS, MOST_CELLS, GUESTS = 20_000, 1_000, 4_096, 24
#: A block's vectors at most, and their bytes as doubles.
BLOCK, BLOCK_BYTES = 32_768, 16 << 20
#: Vectors that a task deals together, their bytes, and the bytes of packed vectors that it hands on at a time.
DEALT, DEALT_BYTES, SENT_BYTES = 16_384, 16 << 20, 4 << 20
#: Rows and columns of a comparison.
CHUNK, ACROSS = 512, 2_048
#: Products of vectors and centroids that are held at a time.
PRODUCTS = 1 << 22


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def slices(x: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Rows in parts whose products with k centroids stay small."""
    step = max(1, PRODUCTS // k)
    return (x[lo : lo + step] for lo in range(0, max(len(x), 1), step))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors."""
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        cell = np.concatenate([(part @ centroids.T).argmax(1) for part in slices(x, k)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return np.unique(centroids, axis=0)


def fitted(x: np.ndarray, most: int, seed: int = 7) -> np.ndarray:
    """Centroids of one half of a sample, as many (1, 2, 3, 4, 6, 8, 12, .. most) as keep the other half's guests at GUESTS a vector or fewer."""
    best, judges = spherical_kmeans(x, 1, seed=seed), x[1::2][:4_096]
    for k in sorted({most, *(m << i for m in (2, 3) for i in range(most.bit_length()) if m << i < most)} - {1}):
        centroids = spherical_kmeans(x[::2], k, seed=seed)
        if cells_of(judges, centroids)[1].sum() <= GUESTS * len(judges):
            best = centroids
    return best


def cells_of(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home of each unit vector, and which cells it is a guest of."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    homes, guests = [], []
    for part in slices(x, len(centroids)):
        near = part @ centroids.T
        home, at = near.argmax(1), np.arange(len(part))
        with np.errstate(divide="ignore", invalid="ignore"):
            border = (near[at, home][:, None] - near) / apart[home]
        guest = ~(border > REACH)
        guest[at, home] = False
        homes.append(home)
        guests.append(guest)
    return np.concatenate(homes), np.concatenate(guests)


class Vectors:
    """Vectors of one block of a cell: ids, copies, home cells, the cells each is a guest of (as sorted row * cells + cell), unit vectors."""

    def __init__(self, blobs: list[bytes], cells: int) -> None:
        parts, ids, copies, home, guest, x = [unpack(b) for b in blobs], [], [], [], [], []
        n = 0
        for i, c, h, g, v, kind in parts:
            ids.append(np.frombuffer(i, "<i8"))
            copies.append(np.frombuffer(c, "<i8"))
            home.append(np.frombuffer(h, "<i4"))
            guest.append(np.frombuffer(g, "<i8") + n * cells)
            x.append(np.frombuffer(v, kind.decode()).reshape(len(ids[-1]), -1))
            n += len(ids[-1])
        self.ids, self.copies, self.home, self.guest = map(np.concatenate, (ids, copies, home, guest))
        self.x, self.cells = unit(np.concatenate(x).astype(np.float64)), cells

    @staticmethod
    def packed(ids: np.ndarray, copies: np.ndarray, home: np.ndarray, guest: np.ndarray, x: np.ndarray) -> bytes:
        single = x.astype("<f4")
        exact = np.array_equal(single.astype(np.float64), x)
        rows, of = np.nonzero(guest)
        return pack(ids.astype("<i8"), copies.astype("<i8"), home.astype("<i4"), (rows * guest.shape[1] + of).astype("<i8"), single if exact else x.astype("<f8"), b"<f4" if exact else b"<f8")


def _deal(centroids: dict[int, np.ndarray]):
    """Packed vectors of each cell: size, cell, guests (whether they are), rows, name, data."""

    def dealt(size: int, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        home, guest = cells_of(unit(x), centroids[size])
        for c in range(len(centroids[size])):
            for guests, rows in ((False, np.flatnonzero(home == c)), (True, np.flatnonzero(guest[:, c]))):
                for lo in range(0, len(rows), CHUNK):
                    r = rows[lo : lo + CHUNK]
                    yield size, c, guests, len(r), int(ids[r].min()), Vectors.packed(ids[r], copies[r], home[r], guest[r] if not guests else guest[r] & False, x[r])

    def sent(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, out, n = pd.concat(held), [], 0
        table = lambda: pd.DataFrame(out, columns=["size", "cell", "guests", "rows", "name", "data"])
        for size, g in f.groupby(f["embedding"].map(len)):
            if size in centroids:
                for row in dealt(size, g["vec_id"].to_numpy(np.int64), g["copies"].to_numpy(np.int64), matrix(g["embedding"])):
                    out.append(row)
                    n += len(row[-1])
                    if n >= SENT_BYTES:
                        yield table()
                        out, n = [], 0
        yield table()

    def run(frames):
        held, n, size = [], 0, 0
        for f in frames:
            held.append(f)
            n, size = n + len(f), size + 8 * int(f["embedding"].map(len).sum())
            if n >= DEALT or size >= DEALT_BYTES:
                yield from sent(held)
                held, n, size = [], 0, 0
        if n:
            yield from sent(held)

    return run


def settled(group: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest of each component, where u and v are linked."""
    while True:
        before = group.copy()
        np.minimum.at(group, u, group[v])
        np.minimum.at(group, v, group[u])
        group = group[group]
        if np.array_equal(before, group):
            return group


def among(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x if len(ascending) else np.zeros(len(x), bool)


def compare(cell: int, left: Vectors, right: Vectors | None) -> pd.DataFrame:
    """Links between homes of a cell and another block of homes or guests, or inside a block: rows (vec_id, other, n)."""
    inside, right = right is None, left if right is None else right
    names, node = np.unique(np.concatenate((left.ids, right.ids)), return_inverse=True)
    of_left, of_right, count = node[: len(left.ids)], node[len(left.ids) :], np.zeros(len(names), np.int64)
    stars = [(node[:0], node[:0])]  # of each part, what leads to the smallest of its group there
    # single precision is off by less than (length + 2) / 2 ** 24
    single, least = (left.x.astype(np.float32), right.x.astype(np.float32)), np.float32(COSINE - (left.x.shape[1] + 8) / 2**23)
    corners = ((lo, at) for lo in range(0, len(left.ids), CHUNK) for at in range(0, len(right.ids), ACROSS) if not inside or at + ACROSS > lo)
    for lo, at in corners:
        near = single[0][lo : lo + CHUNK] @ single[1][at : at + ACROSS].T >= least
        if not near.any():
            continue
        a, b = lo + np.flatnonzero(near.any(1)), at + np.flatnonzero(near.any(0))
        link = left.x[a] @ right.x[b].T >= COSINE
        if inside:
            link &= a[:, None] < b
        # a pair that both cells see counts in the smaller one
        p, q = np.nonzero(link & (right.home[b] < cell))
        seen = among(a[p] * left.cells + right.home[b[q]], left.guest)
        link[p[seen], q[seen]] = False
        rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
        if not len(rows):
            continue
        link, a, b = link[np.ix_(rows, cols)], a[rows], b[cols]
        # integers of 64 bits take no BLAS, doubles do; counts stay far below 2**53
        weight = link.astype(np.float64)
        np.add.at(count, of_left[a], (weight @ right.copies[b]).astype(np.int64))
        np.add.at(count, of_right[b], (left.copies[a] @ weight).astype(np.int64))
        here, own = np.unique(np.concatenate((of_left[a], of_right[b])), return_inverse=True)
        u, v, label = own[: len(a)], own[len(a) :], np.arange(len(here))
        while True:
            before = label[u].sum(), label[v].sum()
            np.minimum.at(label, u, np.where(link, label[v], len(here)).min(1))
            np.minimum.at(label, v, np.where(link, label[u][:, None], len(here)).min(0))
            if before == (label[u].sum(), label[v].sum()):
                break
        moved = np.flatnonzero(label != np.arange(len(here)))
        stars.append((here[moved], here[label[moved]]))
    group = settled(np.arange(len(names)), *(np.concatenate(x) for x in zip(*stars)))
    some = (count > 0) | (group != np.arange(len(names)))
    return pd.DataFrame({"vec_id": names[some], "other": names[group[some]], "n": count[some]})


def _compare(cells: dict[int, int]):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        size, cell, guests, i, j = key
        of = lambda rows: Vectors(f.loc[rows, "data"].tolist(), cells[size])
        left = (f["block"] == i) & ~f["guest"]
        right = f["guest"] if guests else (f["block"] == j)
        return compare(cell, of(left), None if not guests and i == j else of(right)) if left.any() and right.any() else pd.DataFrame({"vec_id": [], "other": [], "n": []})

    return run


def near_duplicates(embeddings: DataFrame, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept, for every row."""
    spark = embeddings.sparkSession
    prepare(spark)
    every = vectors(embeddings).withColumn("same", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("embedding").cast("array<string>")), 256)))
    every = written(every, "vectors")
    classes = every.where("ok").groupBy("same").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    # a class has a number of its own, since different vectors may share a vec_id
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "same", "least", "copies", "embedding"), "classes")
    reps = classes.select(F.col("node").alias("vec_id"), "embedding", "copies")
    centroids = {}
    for r in reps.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).collect():  # one row a vector length
        most = max(1, min(MOST_CELLS, r["n"] // CELL_ROWS))
        centroids[r["size"]] = fitted(unit(sample(reps.where(F.size("embedding") == r["size"]), SAMPLE)), most, seed=seed)
    dealt = reps.mapInPandas(_deal(centroids), schema("size int, cell int, guests boolean, rows bigint, name bigint, data binary"))
    dealt = written(dealt.withColumnRenamed("guests", "guest"), "cells")
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.floor(F.lit(BLOCK_BYTES / 8) / F.col("size"))))
    blocks = lambda guest: F.greatest(F.lit(1), F.ceil(F.sum(F.when(guest, F.col("rows"))) / F.first(most))).cast("int")
    of_cell = dealt.groupBy("size", "cell").agg(blocks(~F.col("guest")).alias("homes"), blocks(F.col("guest")).alias("others"))
    rows = dealt.join(F.broadcast(of_cell), ["size", "cell"])  # at most MOST_CELLS rows a vector length
    rows = rows.withColumn("block", F.pmod(F.xxhash64("name"), F.when(F.col("guest"), F.col("others")).otherwise(F.col("homes"))).cast("int"))

    def tasks(guests: bool, n: str, i, j):
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda w: F.struct(F.lit(guests).alias("guests"), i(w).alias("i"), j(w).alias("j")))

    own = F.col("block")
    with_homes = tasks(False, "homes", lambda w: F.least(own, w), lambda w: F.greatest(own, w))
    with_guests = tasks(True, "others", lambda w: own, lambda w: w)
    as_guest = tasks(True, "homes", lambda w: w, lambda w: own)
    rows = rows.select("size", "cell", "guest", "block", "data", F.explode(F.when(F.col("guest"), as_guest).otherwise(F.concat(with_homes, with_guests))).alias("task"))
    rows = rows.select("size", "cell", "guest", "block", "data", "task.*")
    cells = {size: len(c) for size, c in centroids.items()}
    found = rows.groupBy("size", "cell", "guests", "i", "j").applyInPandas(_compare(cells), schema("vec_id bigint, other bigint, n bigint"))
    found = written(found, "links")
    counts = found.groupBy(F.col("vec_id").alias("node")).agg(F.sum("n").alias("n"))
    rows = every.join(classes.select("same", "node"), "same", "left").select("vec_id", "node")
    shared = rows.where("node is not null").groupBy("vec_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most")
    shared = rows.join(shared, "vec_id").where("node > b").select(F.col("node").alias("a"), "b").distinct()
    groups = components(found.where("other <> vec_id").select(F.col("vec_id").alias("a"), F.col("other").alias("b")).unionByName(shared))
    of = classes.join(counts, "node", "left").join(groups, "node", "left")
    of = of.select("node", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    smallest = of.groupBy("component").agg(F.min("least").alias("smallest"))
    out = rows.join(of.join(smallest, "component").select("node", "links", "smallest"), "node", "left")
    component = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
