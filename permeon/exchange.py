"""Which rearrangements of samples are exchangeable: permutations, sign flips and variance groups.

Orders and Signs are sequences of which any task makes any element by itself, from the labels and a key: random numbers come from a
counter-based generator (Philox) whose key is the seed and whose counter is the permutation's number. So nothing that travels grows
with the number of permutations. HashOrders are orders by md5 instead, which any SQL engine can reproduce; hash_permutations makes the
same ones in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.order import numbered


def block_matrix(eb, n: int | None = None) -> np.ndarray | None:
    """Exchangeability labels as an integer matrix (samples x levels); None if there are none."""
    if eb is None:
        return None
    if not isinstance(eb, np.ndarray):
        raise TypeError("exchangeability labels come as an array")
    if eb.ndim == 0:
        raise ValueError("exchangeability labels are 0-dimensional")
    if eb.dtype.kind not in "iuf":
        raise ValueError("exchangeability labels must be integer-like")
    if eb.dtype.kind == "f" and not np.array_equal(eb, np.floor(eb)):
        raise ValueError("exchangeability labels are non-integer")
    m = eb.astype(np.int64)
    m = m[:, None] if m.ndim == 1 else m
    if n is not None and len(m) not in (0, n):
        raise ValueError(f"{len(m)} exchangeability labels for {n} samples")
    return m if m.size else None


@dataclass
class Node:
    """Samples, or groups of them, and what may be shuffled. order: None (kept), 'first' or 'last' (when it is drawn)."""

    samples: np.ndarray | None = None
    shuffle: bool = False
    parts: list[Node] = field(default_factory=list)
    order: str | None = None

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        if self.samples is not None:
            return rng.permutation(self.samples) if self.shuffle else self.samples
        drawn = rng.permutation(len(self.parts)) if self.order == "first" else None
        parts = [p.draw(rng) for p in self.parts]
        if self.order == "last":
            drawn = rng.permutation(len(parts))
        return np.concatenate(parts if drawn is None else [parts[i] for i in drawn])


def nested(eb: np.ndarray, samples: np.ndarray, level: int = 0, fixed: bool = False) -> Node:
    """The tree of a multi-level label matrix: a positive label lets the blocks below it trade places, a negative one doesn't."""
    if not len(samples) or level >= eb.shape[1]:
        return Node(samples, shuffle=len(samples) > 0)
    labels, of = np.unique(eb[samples, level], return_inverse=True)
    if (labels == 0).any():
        raise ValueError(f"label 0 at level {level}")
    if (labels > 0).any() and (labels < 0).any():
        raise ValueError(f"mixed signs at level {level}")
    positive, last = bool(labels[0] > 0), level == eb.shape[1] - 1
    if len(labels) == 1:
        if last:
            return Node(samples, shuffle=positive)
        below, of_below, sizes = np.unique(eb[samples, level + 1], return_inverse=True, return_counts=True)
        if not positive or len(below) <= 1:
            return nested(eb, samples, level + 1, fixed=not positive)
        if len(set(sizes.tolist())) > 1:
            raise ValueError(f"blocks that trade places must be the same size: level {level + 1} has sizes {sizes.tolist()}")
        return Node(parts=[nested(eb, samples[of_below == i], level + 1, bool(b < 0)) for i, b in enumerate(below)], order="first")
    if last and not fixed:
        return Node(samples, shuffle=positive)
    parts = [nested(eb, samples[of == i], level + 1, bool(b < 0)) for i, b in enumerate(labels)]
    return Node(parts=parts, order=None if fixed or not positive else "last")


def flags(within: bool | None, whole: bool | None) -> tuple[bool, bool]:
    whole = bool(whole)
    return (not whole if within is None else bool(within)), whole


class Drawn(Sequence):
    """`count` things, of which the p-th comes from random numbers of its own: key (seed, stream), counter p."""

    def __init__(self, count: int, seed: int | None, stream: int) -> None:
        self.count = count
        self.key = np.array([(np.random.SeedSequence().entropy if seed is None else int(seed)) % (1 << 64), stream], np.uint64)

    def __len__(self) -> int:
        return self.count

    def rng(self, p: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=self.key, counter=np.array([0, 0, 0, p], np.uint64)))

    def __getitem__(self, p: int) -> np.ndarray:
        if not 0 <= p < self.count:
            raise IndexError(p)
        return self.make(self.rng(int(p)))

    def make(self, rng: np.random.Generator) -> np.ndarray:
        raise NotImplementedError


class Orders(Drawn):
    """Row orders, each a bijection of the samples that the labels allow."""

    def __init__(self, n: int, count: int, eb=None, within: bool | None = None, whole: bool | None = None, seed=None, stream: int = 0) -> None:
        super().__init__(count, seed, stream)
        self.n, self.labels, (self.within, self.whole) = n, block_matrix(eb, n), flags(within, whole)
        if self.whole and not self.within and len(self.blocks) > 1 and len({len(b) for b in self.blocks}) > 1:
            raise ValueError("whole-block shuffling requires all blocks to be the same size")
        _ = self.tree  # labels that can't be nested are told at once

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("tree", "blocks")}  # made again where they are needed

    @cached_property
    def tree(self) -> Node | None:
        return nested(self.labels, np.arange(self.n)) if self.labels is not None and self.labels.shape[1] > 1 else None

    @cached_property
    def blocks(self) -> list[np.ndarray]:
        one = self.labels is not None and self.labels.shape[1] == 1
        return [np.flatnonzero(self.labels[:, 0] == b) for b in np.unique(self.labels[:, 0])] if one else []

    def make(self, rng: np.random.Generator) -> np.ndarray:
        if self.tree is not None:
            return self.tree.draw(rng)
        if len(self.blocks) <= 1 or self.within == self.whole:
            return rng.permutation(self.n)
        if self.whole:
            return np.concatenate([self.blocks[i] for i in rng.permutation(len(self.blocks))])
        out = np.arange(self.n)
        for b in self.blocks:
            out[b] = rng.permutation(b)
        return out


class HashOrders(Sequence):
    """The orders that hash_permutations makes, for samples in ascending order of their ids. blocks: a label for each."""

    def __init__(self, ids: np.ndarray, count: int, mode: str = "free", blocks: np.ndarray | None = None) -> None:
        self.ids, self.count, self.mode, self.blocks = np.asarray(ids), count, mode, blocks

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, p: int) -> np.ndarray:
        if not 0 <= p < self.count:
            raise IndexError(p)
        md5 = lambda *x: hashlib.md5(":".join(map(str, (p, *x))).encode()).digest()
        ids, every = self.ids.tolist(), range(len(self.ids))
        if self.mode == "free":
            drawn = np.frombuffer(b"".join(hashlib.md5(f"{p}:{i}".encode()).digest() for i in ids), ">u8").reshape(-1, 2)
            return np.lexsort((self.ids, drawn[:, 1], drawn[:, 0]))
        of = np.asarray(self.blocks).tolist()
        place = sorted(every, key=lambda i: (of[i], ids[i]))
        if self.mode == "within":
            order = sorted(every, key=lambda i: (of[i], md5(ids[i]), ids[i]))
        else:
            moved = {b: md5("b", b) for b in set(of)}
            order = sorted(every, key=lambda i: (moved[of[i]], of[i], md5(ids[i]) if self.mode == "both" else b"", ids[i]))
        out = np.empty(len(ids), np.int64)
        out[place] = order
        return out


def permutations(n: int, count: int, eb=None, within: bool | None = None, whole: bool | None = None, seed=None) -> Iterator[np.ndarray]:
    """Orders, one after the other."""
    yield from Orders(n, count, eb, within, whole, seed)


def variance_groups(eb, within: bool | None = True, whole: bool | None = False) -> np.ndarray:
    """For each sample the number, from 1, of the group of samples that share a variance."""
    if isinstance(eb, np.ndarray) and eb.size == 0:
        return np.empty(0, np.int64)
    m = block_matrix(eb)
    n, one = len(m), np.ones(len(m), np.int64)
    if n == 1:
        return one
    first = m[:, 0]
    if m.shape[1] > 1 and (first > 0).any() and (first < 0).any():
        raise ValueError("mixed signs in first column")
    by_position = (first > 0).all() if m.shape[1] > 1 else flags(within, whole) == (False, True)
    blocks = m[:, 1] if m.shape[1] > 1 else first
    labels, dense, sizes = np.unique(blocks, return_inverse=True, return_counts=True)
    if m.shape[1] == 1 and (len(labels) == 1 or len(set(flags(within, whole))) == 1):
        return one
    if not by_position:
        return dense + 1
    if len(set(sizes.tolist())) > 1:
        raise ValueError("blocks" + (" (sub-blocks)" if m.shape[1] > 1 else "") + " must be the same size")
    if m.shape[1] > 1 and sizes[0] == 1:
        return one
    out = np.empty(n, np.int64)
    for i in range(len(labels)):
        out[dense == i] = np.arange(1, sizes[i] + 1)
    return out


class Signs(Drawn):
    """+1 or -1 for each sample; with groups, one sign a group."""

    def __init__(self, n: int, count: int, groups: np.ndarray | None = None, seed=None, stream: int = 0) -> None:
        super().__init__(count, seed, stream)
        self.of = np.arange(n) if groups is None else np.unique(groups, return_inverse=True)[1]

    def make(self, rng: np.random.Generator) -> np.ndarray:
        return rng.choice([-1, 1], int(self.of.max(initial=-1)) + 1)[self.of]


def signs(n: int, count: int, groups: np.ndarray | None = None, seed=None) -> Iterator[np.ndarray]:
    """Signs, one after the other."""
    yield from Signs(n, count, groups, seed)


# In Spark, by hash. Ties in md5 break by sample.


def _drawn(spark: SparkSession, samples: DataFrame, count: int) -> DataFrame:
    perms = spark.range(count).select(F.col("id").cast("int").alias("perm_id"))
    return samples.crossJoin(F.broadcast(perms)).withColumn("h", F.md5(F.concat_ws(":", F.col("perm_id").cast("string"), F.col("sample_id").cast("string"))))


def hash_permutations(samples: DataFrame, count: int, mode: str = "free") -> DataFrame:
    """(perm_id, pos, src): the sample that stands at each sample's place. samples: sample_id[, block].

    free: over all samples; within: in each block's own places; whole: blocks of one size trade places (order by the md5 of the
    block); both: blocks trade places and their samples are shuffled."""
    spark = samples.sparkSession
    if mode == "free":
        order = Window.partitionBy("perm_id").orderBy("h", "sample_id")
        place = Window.partitionBy("perm_id").orderBy("sample_id")
    elif mode == "within":
        order = Window.partitionBy("perm_id", "block").orderBy("h", "sample_id")
        place = Window.partitionBy("perm_id", "block").orderBy("sample_id")
    else:
        inside = ["h", "sample_id"] if mode == "both" else ["sample_id"]
        order = Window.partitionBy("perm_id").orderBy("hb", "block", *inside)
        place = Window.partitionBy("perm_id").orderBy("block", "sample_id")
    drawn = _drawn(spark, samples, count)
    if mode in ("whole", "both"):
        drawn = drawn.withColumn("hb", F.md5(F.concat_ws(":", F.col("perm_id").cast("string"), F.lit("b"), F.col("block").cast("string"))))
    key = ["perm_id", "block", "r"] if mode == "within" else ["perm_id", "r"]
    src = drawn.withColumn("r", F.row_number().over(order)).select(*key, F.col("sample_id").alias("src"))
    pos = drawn.withColumn("r", F.row_number().over(place)).select(*key, F.col("sample_id").alias("pos"))
    return src.join(pos, key).select("perm_id", "pos", "src")


def hash_signs(samples: DataFrame, count: int, by: str = "sample_id") -> DataFrame:
    """(perm_id, sample_id, sign): the parity of md5's first character; by a group's label, one sign a group."""
    perms = samples.sparkSession.range(count).select(F.col("id").cast("int").alias("perm_id"))
    h = F.md5(F.concat_ws(":", F.col("perm_id").cast("string"), F.lit("s"), F.col(by).cast("string")))
    return samples.crossJoin(F.broadcast(perms)).select("perm_id", "sample_id", (1 - 2 * (F.ascii(h) % 2)).alias("sign"))


def checked_levels(samples: DataFrame, levels: list[str], equal_sizes: bool = True) -> None:
    """What can't be nested: a label 0, labels of both signs in one block, and (equal_sizes) blocks of different sizes that would trade places."""
    for j, level in enumerate(levels):
        above = levels[:j]
        blocks = samples.groupBy(*above, level).count()
        moves = F.col(above[-1]) > 0 if above else F.col(level) > 0
        held = blocks.groupBy(*above).agg(F.min(level).alias("lo"), F.max(level).alias("hi"), F.count_if(F.col(level) == 0).alias("zeros"), F.min(F.when(moves, F.col("count"))).alias("least"), F.max(F.when(moves, F.col("count"))).alias("most"))
        uneven = F.col("least") < F.col("most") if equal_sizes else F.lit(False)
        bad = held.where((F.col("zeros") > 0) | ((F.col("lo") < 0) & (F.col("hi") > 0)) | uneven).limit(1).collect()
        if bad:
            r = bad[0]
            what = "label 0" if r["zeros"] else "mixed signs" if r["lo"] < 0 < r["hi"] else "blocks that trade places must be the same size"
            raise ValueError(f"{what} at level {j}")


def hash_nested(samples: DataFrame, count: int, levels: list[str], equal_sizes: bool = True) -> DataFrame:
    """(perm_id, pos, src) for nested blocks. samples: sample_id and a column of labels for each level, outermost first.

    A sample's sort key follows its path down the tree: at each level the md5 of the path where the block above lets its blocks trade
    places (its label is positive; on the first level, the blocks' own are), else the label; at the end the md5 of the sample where its
    innermost label is positive. Samples in the order of the keys stand at the places in the order of the labels. equal_sizes: blocks that
    trade places must be of one size; without it a block of another size takes the places that its turn gives it, as in a plain SQL sort."""
    checked_levels(samples, levels, equal_sizes)
    path, order, place = [], [], []
    told = lambda c: F.col(c).cast("string")
    for j, level in enumerate(levels):
        path.append(told(level))
        hashed = F.md5(F.concat_ws(":", told("perm_id"), F.lit(f"b{j}"), *path))
        order += [F.when(F.col(levels[max(j - 1, 0)]) > 0, hashed).otherwise(F.lit("")), F.col(level)]
        place.append(F.col(level))
    order += [F.when(F.col(levels[-1]) > 0, F.col("h")).otherwise(F.lit("")), F.col("sample_id")]
    drawn, of = _drawn(samples.sparkSession, samples.select("sample_id", *levels), count), Window.partitionBy("perm_id")
    src = drawn.select("perm_id", F.row_number().over(of.orderBy(*order)).alias("r"), F.col("sample_id").alias("src"))
    pos = drawn.select("perm_id", F.row_number().over(of.orderBy(*place, "sample_id")).alias("r"), F.col("sample_id").alias("pos"))
    return src.join(pos, ["perm_id", "r"]).select("perm_id", "pos", "src")


def variance_groups_df(samples: DataFrame, by_position: bool) -> DataFrame:
    """(sample_id, grp): the position inside the block, or the block's rank among all."""
    if by_position:
        return samples.select("sample_id", F.row_number().over(Window.partitionBy("block").orderBy("sample_id")).cast("long").alias("grp"))
    blocks = numbered(samples.select("block").distinct(), "block").select("block", (F.col("place") + 1).alias("grp"))
    return samples.join(blocks, "block").select("sample_id", "grp")


def nested_variance_groups(samples: DataFrame, levels: list[str], equal_sizes: bool = True) -> DataFrame:
    """(sample_id, grp) of nested blocks: by the second level's blocks, by position where the first level's labels are positive, for which
    blocks must be of one size (equal_sizes); without it longer blocks have more groups."""
    signs = samples.agg(F.min(levels[0]).alias("lo"), F.max(levels[0]).alias("hi")).first()
    if (signs["lo"] or 0) < 0 < (signs["hi"] or 0):
        raise ValueError("mixed signs in first column")
    blocks = samples.select("sample_id", F.col(levels[1]).alias("block"))
    by_position = (signs["lo"] or 0) > 0
    if by_position and equal_sizes:
        sizes = blocks.groupBy("block").count().agg(F.min("count").alias("least"), F.max("count").alias("most")).first()
        if sizes["least"] != sizes["most"]:
            raise ValueError("blocks (sub-blocks) must be the same size")
    return variance_groups_df(blocks, by_position)
