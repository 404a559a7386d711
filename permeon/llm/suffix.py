"""Operator 10: exact substring removal by a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id.

Where repeats can be. Each window of LENGTH bytes has an anchor: of the SEED-byte strings inside it the one with the
least hash (the first of equals). Equal windows have equal anchors, so only windows whose anchor occurs in more than one
document can repeat; the rest, most of the text, is never sent. Blocks of documents send the hashes of their anchors to
shards and get one bit each back: does another document have it?

Runs. Neighbouring windows mostly share their anchor; such a run of windows is one short string. Of equal runs a block
sends one, that of its smallest document, to the anchor's shard; the block's others are covered by it. So a passage that
every document has costs a shard one entry a block. Where all runs of an anchor are equal, the smallest document keeps
its run and all others lose theirs, and nothing more is to be compared.

Suffix arrays. Where an anchor has different runs (the passage begins, ends or was edited there), blocks come one after the
other, in batches. A batch's windows are sorted (a suffix array cut off at LENGTH bytes); the array is
merge-scanned against every level of the shard's index, and where suffixes share LENGTH bytes the one of the larger
document is marked. The array then joins the index as a level, and levels of like size merge: a batch meets
logarithmically many levels, and an entry moves as often. Of a document's equal windows one stays and the others follow
it, so all have its mark. Marks don't depend on the order of batches.

Blocks are made where documents are read and written once (see _blocks), in buckets, so that messages move to them; the shuffles
carry hashes, bits, runs of repeated text, and spans.

Null and empty texts: no bytes, nothing removed. Null doc_ids count as smaller than all others and equal to each other;
repeated doc_ids are one document's parts and don't remove each other. Very long texts are whole blocks of their own. Equal
passages tie by doc_id: the smallest keeps its own. Empty table: no rows. Extra columns are ignored, or carried along as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import Block, blocks, carried_name, pack, unpack
from ._session import prepare, schema, shuffle_partitions, written
from ._shingles import mix

LENGTH = 50
SEED = 20
SPREAD = LENGTH - SEED + 1
#: Levels merge when the newer is at least 1/RATIO of the older. Blocks join a batch until it has so many windows.
RATIO, BATCH = 2, 1 << 16
SHARDS_A_TASK = 16
#: Bytes of documents that are hashed together.
RUN_BYTES = 1 << 19


def seeds(data: np.ndarray) -> np.ndarray:
    """A hash of each SEED-byte string, by doubling."""
    h, k, c = data.astype(np.uint64) + np.uint64(1), 1, np.array([0x9E3779B97F4A7C15], np.uint64)
    while k < SEED:
        step = min(k, SEED - k)
        h = h[:-step] * c + h[step:]
        h ^= h >> np.uint64(29)
        k, c = k + step, mix(c) | np.uint64(1)
    return mix(h)


def anchors(h: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes the place of its anchor, from the hashes of all seeds."""
    low = np.uint64(0xFFFFFFFF)  # the place breaks ties
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    k = 1
    while 2 * k <= SPREAD:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    return (np.minimum(least[: len(least) - (SPREAD - k)], least[SPREAD - k :]) & low).astype(np.int64)


class Runs:
    """A block's runs: windows that follow each other in a document and have the same anchor. Run i holds the windows
    that start from start[i] to end[i] - LENGTH, so the bytes from start[i] to end[i]."""

    def __init__(self, block: Block) -> None:
        parts = [(np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)]
        first = 0
        for d in range(1, len(block) + 1):  # documents in groups, as hashes of all places take many times their bytes
            if d == len(block) or block.ends[d] - block.starts[first] > RUN_BYTES:
                parts.append(self._of(block, first, d))
                first = d
        self.start, self.end, self.doc, self.anchor, self.hash = map(np.concatenate, zip(*parts))

    @staticmethod
    def _of(block: Block, first: int, last: int) -> tuple[np.ndarray, ...]:
        """start, end, doc, anchor, hash of the runs of documents from first up to last."""
        lo, hi = int(block.starts[first]), int(block.ends[last - 1])
        data = np.frombuffer(block.text, np.uint8)[lo:hi]
        if len(data) < LENGTH:
            return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
        h = seeds(data)
        anchor = anchors(h)
        doc = np.repeat(np.arange(first, last, dtype=np.int32), (block.ends - block.starts)[first:last])
        doc, after = doc[: len(anchor)], doc[LENGTH - 1 :]
        inside = doc == after
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(anchor)) + LENGTH - 1
        keep = inside[start]
        start, end = start[keep], end[keep]
        anchor = anchor[start]
        return start + lo, end + lo, ranks(block)[doc[start]], anchor + lo, h[anchor]


def ranks(block: Block) -> np.ndarray:
    """Documents' order for 'smaller': null first."""
    return np.where(block.known, block.ids, np.iinfo(np.int64).min)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def windows(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some runs as strings of one length, which compare byte by byte; and how many each run has."""
    count = np.array([len(r) - LENGTH + 1 for r in runs], np.int64)
    data = np.frombuffer(b"".join(runs), np.uint8)
    sizes = count + LENGTH - 1
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(count) - count), count) + np.arange(count.sum())
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at])
    return rows.view(f"S{LENGTH}").ravel(), count


class SuffixArray:
    """Distinct windows in lexicographic order, the smallest document of each, and its number among the shard's windows."""

    def __init__(self, keys: np.ndarray, doc: np.ndarray, entry: np.ndarray) -> None:
        self.keys, self.doc, self.entry = keys, doc, entry

    def __len__(self) -> int:
        return len(self.doc)


class LogIndex:
    """Levels of suffix arrays of geometrically growing sizes. found: entries seen to be in a smaller document too; follows:
    for entries that left the index, the entry of the same window and document that stayed."""

    def __init__(self, entries: int) -> None:
        self.levels: list[SuffixArray] = []
        self.found = np.zeros(entries, bool)
        self.follows = np.arange(entries)

    @property
    def marked(self) -> np.ndarray:
        """Entries that a smaller document has too."""
        marked, follows = self.found.copy(), self.follows
        while True:
            marked |= marked[follows]
            further = follows[follows]
            if np.array_equal(further, follows):
                return marked
            follows = further

    def add(self, keys: np.ndarray, doc: np.ndarray, entry: np.ndarray) -> None:
        """A batch: sort it, scan it against all levels, and let it join them."""
        new = self.sorted(keys, doc, entry)
        found = [self.scan(level, new) for level in self.levels]
        while self.levels and len(new) * RATIO >= len(self.levels[-1]):
            new = self.merged(self.levels.pop(), new, *(found.pop() if found else (None, None)))
            found = []  # places in further levels are those of the batch alone
        self.levels.append(new)

    def sorted(self, keys: np.ndarray, doc: np.ndarray, entry: np.ndarray) -> SuffixArray:
        order = np.argsort(doc, kind="stable")
        order = order[np.argsort(keys[order], kind="stable")]
        keys, doc, entry = keys[order], doc[order], entry[order]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        more = doc > doc[first]
        self.found[entry[more]] = True
        self.follows[entry[~more]] = entry[first[~more]]
        return SuffixArray(keys[head], doc[head], entry[head])

    def scan(self, old: SuffixArray, new: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """Mark twins; where the new windows belong in the level, and which of them it has."""
        place = np.searchsorted(old.keys, new.keys)
        near = np.minimum(place, len(old) - 1)
        twin = old.keys[near] == new.keys
        other = old.doc[near]
        self.found[new.entry[twin & (new.doc > other)]] = True
        self.found[old.entry[near[twin & (new.doc < other)]]] = True
        return place, twin

    def merged(self, old: SuffixArray, new: SuffixArray, place: np.ndarray | None, twin: np.ndarray | None) -> SuffixArray:
        """One array; of equal windows the smaller document stays."""
        if place is None:
            place, twin = self.scan(old, new)
        doc, entry, better = old.doc.copy(), old.entry.copy(), twin & (new.doc < old.doc[np.minimum(place, len(old) - 1)])
        doc[place[better]], entry[place[better]] = new.doc[better], new.entry[better]
        equal = np.flatnonzero(twin)
        equal = equal[new.doc[equal] == old.doc[place[equal]]]
        self.follows[new.entry[equal]] = old.entry[place[equal]]
        add = ~twin
        return SuffixArray(*(np.insert(a, place[add], b[add]) for a, b in ((old.keys, new.keys), (doc, new.doc), (entry, new.entry))))


def _anchor_hashes(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of anchors, and which of them stand in more than one document."""
    if not len(runs.hash):
        return runs.hash, np.empty(0, bool)
    order = np.argsort(runs.hash)
    h, doc = runs.hash[order], runs.doc[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[start], np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)


def _pieces(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Equal neighbours of a sorted array."""
    if len(shard):
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(shard[lo]), slice(lo, hi)


def short(h: np.ndarray, shards: int) -> np.ndarray:
    """Sorted hashes of a shard as differences of their next 32 bits, in planes of bytes, which pack well. Hashes that are equal
    in them count as one, which costs a needless look at most."""
    part = (h >> np.uint64(32)) * np.uint64(shards) & np.uint64(0xFFFFFFFF)
    part = (part.astype(np.uint32) & np.uint32(0xFFFF0000)) | (h >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint32)
    return np.diff(part, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.copy()


def long(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _ask(shards: int):
    """From blocks to shards: the block's anchors, and whether two of its own documents have them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, blob in zip(frame["block"], frame["docs"]):
                h, several = _anchor_hashes(Runs(Block(blob)))
                rows = [(number, s, pack(short(h[i], shards), np.packbits(several[i]))) for s, i in _pieces(shard_of(h, shards))]
                yield pd.DataFrame(rows, columns=["block", "shard", "data"])

    return run


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's bits: does more than one block, or do several documents of a block, have the anchor?"""
    parts = [unpack(x) for x in frame["data"]]
    hashes = [long(a) for a, _ in parts]
    several = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(h)).view(bool) for h, (_, b) in zip(hashes, parts)]
    every = np.sort(np.concatenate([np.unique(h) for h in hashes]))
    again = np.unique(np.concatenate((every[1:][every[1:] == every[:-1]], *(h[s] for h, s in zip(hashes, several)))))
    bits = []
    for h in hashes:
        i = np.minimum(np.searchsorted(again, h), max(0, len(again) - 1))
        bits.append(np.packbits(again[i] == h if len(again) else np.zeros(len(h), bool)).tobytes())
    return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "data": bits})


def send(number: int, b: Block, known: dict[int, bytes], shards: int) -> list[tuple]:
    """From a block to shards (block, shard, settled, data): each distinct run once; and spans that the block has settled itself,
    which go along to its own shard's answer. known: the shards' bits."""
    rows = []
    runs = Runs(b)
    h, _ = _anchor_hashes(runs)
    bits = [np.unpackbits(np.frombuffer(known[s], np.uint8), count=i.stop - i.start) for s, i in _pieces(shard_of(h, shards))]
    wanted = np.flatnonzero(np.isin(runs.hash, h[np.concatenate(bits).view(bool)])) if bits else np.empty(0, np.int64)
    start, end, doc = runs.start[wanted], runs.end[wanted], runs.doc[wanted]
    text, least = b.text, {}
    strings = [text[s:e] for s, e in zip(start.tolist(), end.tolist())]
    docs = doc.tolist()
    for r, d in zip(strings, docs):
        if least.setdefault(r, d) > d:
            least[r] = d
    settled = np.array([d > least[r] for r, d in zip(strings, docs)], bool)
    rows.append((number, number % shards, True, pack(start[settled].astype("<u4"), end[settled].astype("<u4"))))
    sent = np.flatnonzero(~settled)
    shard = shard_of(runs.hash[wanted[sent]], shards)
    order = np.argsort(shard, kind="stable")
    sent, offset = sent[order], runs.anchor[wanted] - start
    for s, i in _pieces(shard[order]):
        mine = sent[i]
        rows.append((number, s, False, pack(
            start[mine].astype("<u4"), (end - start)[mine].astype("<u2"), offset[mine].astype("u1"), doc[mine].astype("<i8"),
            b"".join([strings[j] for j in mine.tolist()]),
        )))
    return rows


def _send(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, docs, shard, data in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3))):
                rows = send(number, Block(docs.as_py()), dict(zip(shard.as_py() or [], data.as_py() or [])), shards)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], names=["block", "shard", "settled", "data"])

    return run


def _resolve(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's spans for each block that sent it runs, after those that are settled."""
    settled = frame[frame["settled"]][["block", "data"]]
    frame = frame[~frame["settled"]].sort_values("block")
    batches, least, variants = [], {}, {}
    for number, blob in zip(frame["block"], frame["data"]):
        start, size, offset, doc, text = unpack(blob)
        start, size, offset, doc = np.frombuffer(start, "<u4"), np.frombuffer(size, "<u2"), np.frombuffer(offset, "u1"), np.frombuffer(doc, "<i8").tolist()
        ends = np.cumsum(size, dtype=np.int64).tolist()
        runs = [text[e - n : e] for e, n in zip(ends, size.tolist())]
        batches.append((number, start, size, doc, runs, offset.tolist()))
        for r, d, o in zip(runs, doc, offset.tolist()):
            if least.setdefault(r, d) > d:
                least[r] = d
            seed = r[o : o + SEED]
            if variants.setdefault(seed, r) != r:
                variants[seed] = None  # different runs
    # windows of anchors with different runs: each run once, in the batch that has it of its smallest document
    first, count, plan = {}, 0, []
    for _, _, _, doc, runs, offset in batches:
        new = []
        for r, d, o in zip(runs, doc, offset):
            if r not in first and d == least[r] and variants[r[o : o + SEED]] is None:
                first[r] = count
                count += len(r) - LENGTH + 1
                new.append(r)
        plan.append(new)
    index, batch = LogIndex(count), []
    for i, new in enumerate(plan):
        batch += new
        if batch and (i == len(plan) - 1 or sum(map(len, batch)) > BATCH):
            new, batch = batch, []
            keys, n = windows(new)
            entry = np.repeat(np.array([first[r] for r in new]) - (np.cumsum(n) - n), n) + np.arange(n.sum())
            index.add(keys, np.repeat(np.array([least[r] for r in new], np.int64), n), entry)
    rows, marked = [], index.marked
    for number, start, size, doc, runs, _ in batches:
        lo, hi = [], []
        for s, n, d, r in zip(start.tolist(), size.tolist(), doc, runs):
            if d > least[r]:
                lo.append(s)
                hi.append(s + n)
            elif (f := first.get(r)) is not None:
                hit = np.flatnonzero(marked[f : f + n - LENGTH + 1])
                if len(hit):
                    new = np.flatnonzero(np.concatenate(([True], np.diff(hit) > LENGTH)))
                    lo += (s + hit[new]).tolist()
                    hi += (s + hit[np.append(new[1:] - 1, len(hit) - 1)] + LENGTH).tolist()
        rows.append((number, pack(np.array(lo, "<u4"), np.array(hi, "<u4"))))
    return pd.concat((settled, pd.DataFrame(rows, columns=["block", "data"])))


def finish(b: Block, spans: list[bytes], with_text: bool) -> pa.Table:
    """A row for each document of the block."""
    step = np.zeros(len(b.text) + 1, np.int32)
    for data in spans:
        lo, hi = (np.frombuffer(x, "<u4") for x in unpack(data))
        np.add.at(step, lo, 1)
        np.subtract.at(step, hi, 1)
    gone, rows = np.cumsum(step[:-1], dtype=np.int32) > 0, []
    data = np.frombuffer(b.text, np.uint8)
    for d, lo, hi in zip(b.doc_ids(), b.starts.tolist(), b.ends.tolist()):
        g, t = gone[lo:hi], data[lo:hi]
        spans_of = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if hi > lo else 0
        row = (d, hi - lo, int(np.count_nonzero(g)), spans_of, hashlib.sha256(t[~g].tobytes()).hexdigest())
        rows.append((*row, *[whole_characters(t, g)] * with_text))
    made = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * with_text])
    if b.rest is not None:
        rest = b.carried()
        for name in rest.column_names:
            made = made.append_column(name, rest[name])
    return made


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, spans in zip(batch.column(0), batch.column(1)):
                yield from finish(Block(docs.as_py()), spans.as_py() or [], with_text).combine_chunks().to_batches()

    return run


def beside(made: DataFrame, messages: DataFrame) -> DataFrame:
    """block, docs, messages (structs) of each block, which stays where it is written."""
    of = messages.groupBy("block").agg(F.collect_list(F.struct(*(c for c in messages.columns if c != "block"))).alias("messages"))
    return made.select("block", "docs").join(of.hint("merge"), "block", "left")


#: Types of a row of _finish.
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())


def whole_characters(text: np.ndarray, gone: np.ndarray) -> str:
    """What is left as text: a character of which a byte is removed goes as a whole."""
    if gone.any():
        character = np.cumsum((text & 0xC0) != 0x80) - 1
        gone = np.bincount(character, gone)[character] > 0
    return text[~gone].tobytes().decode()


def remove_repeats(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = (), shard_bytes: int = 1 << 19) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text: also the text left (whole characters); carry: columns that go
    along, as carried_0 and so on. A shard takes the anchors of about shard_bytes of text: raise it, and the blocks, with executors'
    memory, as there are messages from each block to each shard."""
    spark = docs.sparkSession
    prepare(spark)
    made = blocks(docs, "suffix-blocks", carry=carry, buckets=shuffle_partitions(spark))
    total = made.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    shards = max(shuffle_partitions(spark), -(-total // shard_bytes))
    tasks = min(shards, max(4 * shuffle_partitions(spark), shards // SHARDS_A_TASK))  # named, as small requests are much work
    asked = made.select("block", "docs").mapInPandas(_ask(shards), schema("block bigint, shard int, data binary"))
    replies = asked.repartition(tasks, "shard").groupBy("shard").applyInPandas(_answer, schema("block bigint, shard int, data binary"))
    sent = beside(made, replies).select("block", "docs", "messages.shard", "messages.data").mapInArrow(_send(shards), schema("block bigint, shard int, settled boolean, data binary"))
    # written, as their shuffles and those before them can go then
    spans = written(sent.repartition(tasks, "shard").groupBy("shard").applyInPandas(_resolve, schema("block bigint, data binary")), "suffix-spans")
    out = schema("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text string" * with_text)
    for i, c in enumerate(carry):
        out = out.add(carried_name(i), docs.schema[c].dataType)
    return beside(made, spans).select("docs", "messages.data").mapInArrow(_finish(with_text), out)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns, texts without repeats; n_chars, if there, follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = remove_repeats(docs, with_text=True, carry=others)
    named = {c: F.col(carried_name(i)) for i, c in enumerate(others)}
    named |= {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(named[c].alias(c) for c in docs.columns))
