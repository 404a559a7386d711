"""Operator 13: how the sources of a language differ in their words, from mergeable radix tries.

* A task counts the terms of its documents in a byte trie a language, whose leaves have a counter for each source. A trie that has
  grown to LEAVES is handed on, leaf by leaf in UTF-8 order; so is the last one.
* Leaves are dealt by ranges of (language, term), that is by prefixes, which Spark balances by sampling; a range's leaves, sorted, are
  merged as they stream by. A term that is in every trie has one leaf for each of them, however many documents have it.
* Terms in at least LEAST documents of the language are kept. Each range is then traversed in UTF-8 order together with the language's
  sources: terms of which a source has more than its language are candidates, TOP of which a range keeps for each source; and pairs of
  sources get the sum of their differences. A source without a term has a share that depends on the source alone, so only the
  terms that a pair shares are looked at pair by pair; the others come from the counts of one source.

Shares are exact integers (long division, in steps of a thousand), as are all sums. A task holds a range's kept terms and a square
of its language's sources; the result has a row for each of these pairs too. Nothing but sizes goes through the driver.

Null text, lang and source: ''. Empty texts: their group is there, without terms. Repeated rows and equal doc_ids: documents of
their own. Ties: the smaller item in UTF-8. Very long texts: a trie may outgrow its bound by one text. A language without kept terms: pairs
of value 0. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._session import parts_for, prepare, schema, written

LEAST, TOP, SCALE_STEPS = 10, 10, 3
#: Leaves of a task's tries, and counters that wait to be added up.
LEAVES, WAITING = 250_000, 2_000_000
#: Leaves in a range, about.
RANGE_LEAVES = 100_000
#: Pairs looked at together.
CELLS = 1 << 20
#: UTF-8 bytes of a text: letters of terms (A-Z as a-z), and spaces for all else.
LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(LETTER).split()


#: Bytes of an edge, and the terms below one from which on it gets edges of its own.
HEAD, BURST = 3, 2048


class Trie:
    """A radix trie over byte strings whose small subtrees are flat (a burst trie): an edge takes HEAD bytes, or the rest of a shorter term,
    and leads to a dict of what follows and the number of the leaf there, or, once that has more than BURST entries, to a trie."""

    def __init__(self) -> None:
        self.edges: dict[bytes, dict[bytes, int] | Trie] = {}
        self.size = 0

    def leaf(self, term: bytes) -> int:
        """The number of the term's leaf, a new one if there is none."""
        edges, at = self.edges, 0
        while True:
            head = term[at : at + HEAD]
            below = edges.get(head)
            at += HEAD
            if below is None:
                edges[head] = below = {}
            elif type(below) is Trie:
                edges = below.edges
                continue
            rest = term[at:]
            n = below.get(rest)
            if n is None:
                below[rest] = n = self.size
                self.size += 1
                if len(below) > BURST:
                    edges[head] = burst = Trie()
                    for r, m in below.items():
                        burst.edges.setdefault(r[:HEAD], {})[r[HEAD:]] = m
            return n

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Terms and their leaves' numbers, in the order of their bytes."""
        stack = [(b"", self)]
        while stack:
            before, node = stack.pop()
            if type(node) is Trie:
                stack += [(before + head, node.edges[head]) for head in sorted(node.edges, reverse=True)]
            else:
                yield from ((before + rest, node[rest]) for rest in sorted(node))


class Counters:
    """A language's trie, with the counters of its leaves."""

    class Known(dict):
        def __init__(self, trie: Trie) -> None:
            super().__init__()
            self.leaf = trie.leaf

        def __missing__(self, term: bytes) -> int:
            self[term] = n = self.leaf(term)
            return n

    def __init__(self) -> None:
        self.trie = Trie()
        self.known = Counters.Known(self.trie)
        self.sources: dict[str, int] = {}
        self.settled = np.empty((3, 0), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0
        self.full = False

    def add(self, source: str, found: Counter) -> None:
        """A document's terms."""
        s = self.sources.setdefault(source, len(self.sources))
        self.waiting.append((np.fromiter(map(self.known.__getitem__, found), np.int64, len(found)) << 32 | s, np.fromiter(found.values(), np.int64, len(found))))
        self.n_waiting += len(found)
        if self.n_waiting > WAITING:
            self.settled, self.waiting, self.n_waiting = self.added(), [], 0
            self.full = self.settled.shape[1] > WAITING

    def added(self) -> np.ndarray:
        """leaf << 32 | source (ascending), occurrences, documents."""
        code, n = (np.concatenate(x) for x in zip(*self.waiting)) if self.waiting else (np.empty(0, np.int64),) * 2
        return _added(np.concatenate((self.settled, np.stack((code, n, np.ones_like(n)))), 1))

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """A row for each leaf, in the order of its bytes."""
        walked, numbers = map(list, zip(*self.trie.walk()))
        rank = np.empty(len(walked), np.int64)
        rank[numbers] = np.arange(len(walked))
        code, n, docs = self.added()
        leaf, source = rank[code >> 32], code & 0xFFFFFFFF
        order = np.argsort(leaf << 32 | source)
        leaf, source, n, docs = leaf[order], source[order], n[order], docs[order]
        names = pa.array(list(self.sources), pa.string())
        for lo in range(0, len(walked), 20_000):
            hi = min(lo + 20_000, len(walked))
            a, b = np.searchsorted(leaf, (lo, hi))
            at = np.searchsorted(leaf[a:b], np.arange(lo, hi + 1))
            yield _leaves(
                pa.array([lang] * (hi - lo), pa.string()), pa.array(walked[lo:hi], pa.binary()).cast(pa.string()),
                np.add.reduceat(docs[a:b], at[:-1]), at, names.take(pa.array(source[a:b])), n[a:b],
            )


LEAF = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"


def _leaves(lang: pa.Array, term: pa.Array, docs: np.ndarray, at: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    at = pa.array(at, pa.int32())
    return pa.RecordBatch.from_arrays([lang, term, pa.array(docs, pa.int64()), pa.ListArray.from_arrays(at, sources), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], names=["lang", "term", "docs", "sources", "counts"])


def _added(rows: np.ndarray) -> np.ndarray:
    """Rows under equal codes (the first) added up."""
    rows = rows[:, np.argsort(rows[0])]
    if not rows.shape[1]:
        return rows
    first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
    return np.stack((rows[0, first], *(np.add.reduceat(r, first) for r in rows[1:])))


def tries(docs: DataFrame) -> DataFrame:
    """The leaves of the tasks' tries: LEAF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counters] = {}
        leaves = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                if found := Counter(terms(text)):
                    of = held.setdefault(lang, Counters())
                    before = of.trie.size
                    of.add(source, found)
                    leaves += of.trie.size - before
                    if leaves > LEAVES or of.full:
                        for name in sorted(held):
                            yield from held.pop(name).rows(name)
                        leaves = 0
        for name in sorted(held):
            yield from held.pop(name).rows(name)

    return docs.mapInArrow(run, schema(LEAF))


def merged(rows: pa.Table) -> pa.RecordBatch:
    """Leaves in order, those of one term as one."""
    rows = rows.combine_chunks()
    lang, term, docs, sources, counts = (rows.column(i).chunk(0) if rows.column(i).num_chunks else pa.array([], rows.column(i).type) for i in range(5))
    new = np.ones(len(term), bool)
    if len(term) > 1:
        new[1:] = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
    first, of = np.flatnonzero(new), np.cumsum(new) - 1
    of = np.repeat(of, pc.list_value_length(sources).to_numpy())
    names = sources.flatten().dictionary_encode()
    code, n = _added(np.stack((of << 32 | names.indices.to_numpy(), counts.flatten().to_numpy())))
    at = np.searchsorted(code >> 32, np.arange(len(first) + 1))
    return _leaves(lang.take(pa.array(first)), term.take(pa.array(first)), np.add.reduceat(docs.to_numpy(), first), at, names.dictionary.take(pa.array(code & 0xFFFFFFFF)), n)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's leaves, sorted, to its kept terms."""
    part, last = TaskContext.get().partitionId(), None

    def kept(rows: pa.RecordBatch) -> pa.RecordBatch:
        rows = rows.filter(pc.greater_equal(rows.column(2), LEAST))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, part), pa.int32())], names=[*rows.schema.names, "range"])

    for b in batches:
        if not b.num_rows:
            continue
        b = pa.RecordBatch.from_arrays(b.columns, names=["lang", "term", "docs", "sources", "counts"])
        rows = merged(pa.Table.from_batches([b] if last is None else [last, b.cast(last.schema)]))
        yield kept(rows.slice(0, rows.num_rows - 1))
        last = rows.slice(rows.num_rows - 1)
    if last is not None:
        yield kept(last)


def share(count, total, kept: int):
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)), exact: long division, three digits at a time."""
    left, by = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * kept
    out = left // by
    for _ in range(SCALE_STEPS):
        left = left % by * 1000
        out = out * 1000 + left // by
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(of: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """For sources a, b (0 if they are one): the sum, over the terms that either has, of their gap less that of two sources without the term. of: each
    counter's term, ascending; source, p: its source and share; p0: the sources' shares of terms that they haven't."""
    s = len(p0)
    none = gap(p0[:, None], p0[None, :])
    one = np.zeros((s, s), np.int64)
    for a in np.unique(source):
        shares, n = np.unique(p[source == a], return_counts=True)
        for lo in range(0, len(shares), max(1, CELLS // s)):
            some = slice(lo, lo + max(1, CELLS // s))
            one[a] += (n[some, None] * (gap(shares[some, None], p0[None, :]) - none[a])).sum(0)
    both = np.zeros(s * s, np.int64)
    size = np.bincount(of) if len(of) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    for k in np.unique(size[size > 1]):
        i, j = np.triu_indices(k, 1)
        rows = first[size == k]
        for lo in range(0, len(rows), max(1, CELLS // len(i))):
            at = rows[lo : lo + max(1, CELLS // len(i)), None]
            a, b, x, y = source[at + i], source[at + j], p[at + i], p[at + j]
            np.add.at(both, a * s + b, gap(x, y) - gap(x, p0[b]) - gap(p0[a], y) + none[a, b])
    both = both.reshape(s, s)
    out = one + one.T + both + both.T
    np.fill_diagonal(out, 0)
    return out


def traverse(key, rows: pa.Table, sources: pa.Table) -> pa.Table:
    """A range's terms and all sources of their language: part, source, item, value."""
    out_schema = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not rows.num_rows:
        return out_schema.empty_table()
    lang = key[0].as_py()
    rows, sources = rows.sort_by("term").combine_chunks(), sources.sort_by("source").combine_chunks()
    names, total, kept, everywhere = sources["source"].combine_chunks(), sources["n"].to_numpy(), sources["kept"][0].as_py(), sources["total"][0].as_py()
    lists, counts = rows["sources"].combine_chunks(), rows["counts"].combine_chunks().flatten().to_numpy()
    of = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
    source = pc.index_in(lists.flatten(), names).to_numpy().astype(np.int64)
    order = np.lexsort((source, of))
    of, source, counts = of[order], source[order], counts[order]
    p, p0 = share(counts, total[source], kept), share(0, total, kept)
    first = np.searchsorted(of, np.arange(rows.num_rows))
    q = share(np.add.reduceat(counts, first), everywhere, kept)[of]
    value = gap(p, q)
    over = np.flatnonzero(p > q)
    over = over[np.lexsort((of[over], -value[over], source[over]))]
    place = np.arange(len(over)) - np.searchsorted(source[over], source[over])
    over = over[place < TOP]
    sums = pair_sums(of, source, p, p0)
    a, b = np.nonzero(sums)
    return pa.table(
        [
            pa.array([lang] * (len(over) + len(a)), pa.string()), pa.array(["term"] * len(over) + ["pair"] * len(a), pa.string()), names.take(pa.array(np.concatenate((source[over], a)))),
            pa.chunked_array([rows["term"].combine_chunks().take(pa.array(of[over])), names.take(pa.array(b))]), pa.array(np.concatenate((value[over], sums[a, b]))),
        ], schema=out_schema,
    )


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    leaves = written(tries(docs), "tries")
    ranges = parts_for(leaves.count(), RANGE_LEAVES, 8)
    kept = leaves.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge, schema(f"{LEAF}, range int"))
    kept = written(kept, "kept")
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("total"))
    groups = docs.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "kept", "total"))), "groups")
    of_range = groups.join(kept.select("lang", F.col("range").alias("place")).distinct(), "lang")
    found = kept.groupBy("lang", "range").cogroup(of_range.groupBy("lang", "place")).applyInArrow(traverse, schema("lang string, part string, source string, item string, value bigint"))
    found = written(found, "found")
    share0 = F.expr("1 + 2000000000 div (n + 2 * kept)")
    ours = groups.where("kept > 0").select("lang", "source", "kept", share0.alias("p"))
    pairs = ours.join(ours.select("lang", F.col("source").alias("item"), F.col("p").alias("q")), "lang").where("source <> item")
    pairs = pairs.select("lang", "source", "item", F.expr("kept * ((p - q) * (p - q) div (p + q))").alias("value"))
    # of languages without kept terms
    bare = groups.where("kept = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.unionByName(bare).unionByName(found.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", rank]
    term = found.where("part = 'term'").select(columns).where(F.col("rank") <= TOP)
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(term)
