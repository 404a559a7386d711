"""Operator 3: quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each byte of a text from the ORDER - 1 bytes before it, with one model a language. It is trained on
all documents labelled as good and not toxic. Counts of the highest order are summed natively; the lower orders
are continuation counts, each derived from the order above; discounts follow Chen and Goodman's modified estimate from the
counts of counts, a language and order at a time.

One in HELD_OUT of the trusted texts, by a hash of the text, is kept out of the training, and thresholds come from those alone:
they are quantiles of text that the model hasn't seen.

Scoring joins counts by shards. A block of documents (see _blocks) asks for its distinct n-grams of every order, of whole
texts; requests meet the model's entries in shards by a hash of the whole n-gram, so that neither a common byte nor a common
context is a hot key and no entry is copied; each n-gram's probability, and what is left to the next order down after it, come
back to the block, which backs off and sums for each document. A shard is one partition, sorted with its entries first: it
holds its part of the model (ENTRIES at most, by the number of shards) and one Arrow batch of requests. Blocks are written
in buckets, so that replies move to them and the texts stay where they are; a scoring task holds one block and its replies.

Thresholds are quantiles a language: HIGH of the held-out trusted documents' perplexities, or, where the LOW quantile of the
documents labelled bad lies above that, the geometric mean of both. A document above its language's threshold is rejected.
Thresholds and decisions use `score`, the perplexity with PRIOR bytes of the language's trusted mean mixed in.

Result: doc_id, lang, n_bytes, perplexity, score, threshold, rejected. Null or empty text: perplexity null, not rejected. Very long
texts are scored whole, each in a block of its own. Languages (null and '' are one of them) with fewer than LEAST_TRUSTED
held-out trusted documents have no threshold, and nothing of them is rejected. A null doc_id has no label. Repeated rows are scored
each; repeated labels count once, as bad if one of them says so. Ties with a threshold are kept. Empty tables give no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._blocks import Block, blocks, pack, unpack
from ._session import dropped, few, prepare, schema, shuffle_partitions, written
from ._shingles import mix

ORDER = 5
HELD_OUT, LEAST_TRUSTED = 3, 10
HIGH, LOW = 0.995, 0.05
#: A text counts as if so many bytes of its language's usual perplexity stood before it: a few words alone say little.
PRIOR = 64
#: Entries of the model in one shard, at most (on average of the hash).
ENTRIES = 2_000_000
#: Logarithms are stored as multiples of -UNIT in 16 bits; ABSENT stands for no entry.
UNIT, ABSENT = 28 / 65535, 65535
#: Bytes of trusted text that a task counts together.
COUNT_BYTES = 3 << 20
#: Bytes whose ORDER-grams are made together.
GRAM_BYTES = 1 << 19
#: Entries that a task puts in messages together.
DEALT = 500_000
#: n-grams as numbers have their order above this bit.
TOP = 40


def grams(text: bytes | np.ndarray) -> np.ndarray:
    """For each byte the ORDER-gram that ends there, as a number; the text starts after zero bytes."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    padded = np.concatenate((np.zeros(ORDER - 1, np.uint64), data))
    key = np.zeros(len(data), np.uint64)
    for i in range(ORDER):
        key = key << np.uint64(8) | padded[i : i + len(data)]
    return key


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def distinct_grams(texts: Iterator[bytes]) -> np.ndarray:
    """Sorted distinct ORDER-grams of some texts, a few at a time."""
    out, held, n = [np.empty(0, np.uint64)], [], 0
    for t in texts:
        held.append(grams(t))
        n += len(t)
        if n > GRAM_BYTES:
            out.append(distinct(np.concatenate(held)))
            held, n = [], 0
    return distinct(np.concatenate([*out, *held]))


def low(keys: np.ndarray, m: int) -> np.ndarray:
    """The last m bytes."""
    return keys & np.uint64((1 << 8 * m) - 1)


def wanted(keys: np.ndarray) -> list[np.ndarray]:
    """For m = 0 .. ORDER the sorted m-grams that probabilities of these sorted distinct ORDER-grams may need, also as contexts."""
    out = [keys]
    for m in range(ORDER - 1, -1, -1):
        out.append(distinct(np.concatenate((low(out[-1], m), out[-1] >> np.uint64(8)))))
    return out[::-1]


def numbered(by_order: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([k | np.uint64(m << TOP) for m, k in enumerate(by_order)])


def named(block: Block) -> list[str]:
    """Kinds and languages: 't' trusted, 'h' trusted and held out, 'b' labelled bad, 'a' any other."""
    return [bytes.fromhex(g).decode() for g in block.groups]


# -- the model


def counted(made: DataFrame) -> DataFrame:
    """lang, key, c: ORDER-grams of the blocks' trusted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = defaultdict(list), 0

        def sums() -> Iterator[pa.RecordBatch]:
            for name, parts in of.items():
                key, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "c"])
            of.clear()

        for batch in batches:
            for blob in batch.column(0):
                b = Block(blob.as_py())
                for d, name in enumerate(named(b)):
                    if name[0] == "t":
                        of[name[1:]].append(grams(b.text[b.starts[d] : b.ends[d]]))
                        held += int(b.ends[d] - b.starts[d])
                if held > COUNT_BYTES:
                    yield from sums()
                    held = 0
        yield from sums()

    return made.select("docs").mapInArrow(run, schema("lang string, key bigint, c bigint"))


def _code(x: Column) -> Column:
    """-ln x in units; of 0, whose logarithm is null here, the largest code."""
    return F.least(F.rint(-F.log(x) / UNIT), F.lit(float(ABSENT - 1))).cast("int")


def model(counts: DataFrame) -> DataFrame:
    """lang, kind, key, code: for kind 0 log-probabilities of seen m-grams, for kind 1 logarithms of what contexts leave to the
    next order down, in units. counts: lang, key, c, of ORDER-grams; repeated keys add up."""
    tables = {ORDER: written(counts.groupBy("lang", "key").agg(F.sum("c").alias("c")), "grams")}
    for m in range(ORDER - 1, 0, -1):
        last = F.col("key").bitwiseAND(F.lit((1 << 8 * m) - 1))
        tables[m] = written(tables[m + 1].groupBy("lang", last.alias("key")).agg(F.count("*").alias("c")), "grams")
    lower, steps, out = None, [], []
    for m in range(1, ORDER + 1):
        of = tables[m].groupBy("lang").agg(*(F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        discount = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)))).otherwise(F.lit(0.75))
        of = of.select("lang", *(discount(i).alias(f"d{i}") for i in (1, 2, 3)))
        t = tables[m].join(F.broadcast(of), "lang")  # one row a language
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.select("lang", "key", "c", F.least(d, F.col("c").cast("double")).alias("d"), F.shiftright("key", 8).alias("context"))
        of_context = Window.partitionBy("lang", "context")  # 256 rows at most
        t = t.select("lang", "key", "c", "d", F.sum("c").over(of_context).alias("s"), F.sum("d").over(of_context).alias("left"), (F.row_number().over(of_context.orderBy("key")) == 1).alias("first"))
        t = t.select("lang", "key", "first", ((F.col("c") - F.col("d")) / F.col("s")).alias("share"), (F.col("left") / F.col("s")).alias("weight"))
        if lower is None:
            p = F.col("share") + F.col("weight") / 256
        else:
            below = lower.select("lang", F.col("key").alias("suffix"), F.col("p").alias("q"))
            t = t.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1))).join(below, ["lang", "suffix"])
            p = F.col("share") + F.col("weight") * F.col("q")
        lower = written(t.select("lang", "key", "first", "weight", p.alias("p")), "probabilities")
        steps.append(lower)
        out.append(lower.select("lang", F.lit(0).alias("kind"), F.col("key").bitwiseOR(F.lit(m << TOP)).alias("key"), _code(F.col("p")).alias("code")))
        context = F.shiftright("key", 8).bitwiseOR(F.lit((m - 1) << TOP))
        out.append(lower.where("first").select("lang", F.lit(1).alias("kind"), context.alias("key"), _code(F.col("weight")).alias("code")))
    every = out[0]
    for t in out[1:]:
        every = every.unionByName(t)
    every = written(every, "model")
    dropped(*tables.values(), *steps)
    return every


# -- requests and replies


def spread(keys: np.ndarray, shards: int) -> np.ndarray:
    """By a hash of all but the last two bytes: at most 65,536 neighbours stay together, which makes messages short."""
    return (mix(keys >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def flat(keys: np.ndarray) -> np.ndarray:
    """Differences in planes of bytes, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def restored(planes: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def contexts(keys: np.ndarray) -> int:
    """How many of sorted n-grams are of an order below ORDER, and so are asked as contexts too."""
    return int(np.searchsorted(keys, np.uint64(ORDER << TOP)))


def ask(block: Block, shards: int) -> list[tuple[int, bytes]]:
    """Messages (shard, names of models and their sorted n-grams as differences in planes of bytes)."""
    of, out = defaultdict(list), defaultdict(list)
    for d, name in enumerate(named(block)):
        of[name[1:]].append(d)
    for name in sorted(of):
        keys = numbered(wanted(distinct_grams(block.text[block.starts[d] : block.ends[d]] for d in of[name])))
        shard = spread(keys, shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            out[s].append((name, keys[order[cuts[s] : cuts[s + 1]]]))
    messages = []
    for s, parts in out.items():
        keys = np.concatenate([k for _, k in parts])
        messages.append((s, pack(json.dumps([[n, len(k)] for n, k in parts]).encode(), flat(keys))))
    return messages


class Entries:
    """A shard's part of the model."""

    def __init__(self) -> None:
        self.parts, self.of = defaultdict(list), {}

    def add(self, message: bytes) -> None:
        what, planes, codes = unpack(message)
        key, code, at = restored(planes), np.frombuffer(codes, "<u2"), 0
        for name, kind, n in json.loads(what):
            self.parts[name, kind].append((key[at : at + n], code[at : at + n]))
            at += n

    def close(self) -> None:
        for which, parts in self.parts.items():
            key, code = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key)
            self.of[which] = key[order], code[order]
        self.parts.clear()

    def look(self, name: str, kind: int, keys: np.ndarray) -> np.ndarray:
        known, code = self.of.get((name, kind), (np.empty(0, np.uint64), np.empty(0, np.uint16)))
        if not len(known):
            return np.full(len(keys), ABSENT, np.uint16)
        i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[i] == keys, code[i], np.uint16(ABSENT))

    def reply(self, message: bytes) -> bytes:
        """Codes of probabilities, then of what contexts leave."""
        names, planes = unpack(message)
        keys, p, left, at = restored(planes), [], [], 0
        for name, n in json.loads(names):
            mine = keys[at : at + n]
            p.append(self.look(name, 0, mine))
            left.append(self.look(name, 1, mine[: contexts(mine)]))
            at += n
        return pack(np.concatenate(p).astype("<u2"), np.concatenate(left).astype("<u2"))


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                asked = list(ask(Block(blob.as_py()), shards)) if len(blob.as_py()) else []  # nothing of a block without text
                shard, data = [s for s, _ in asked], [d for _, d in asked]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(asked), pa.int64()), pa.array(shard, pa.int32()), pa.array(data, pa.binary())], names=["block", "shard", "data"])

    return run


def _dealt(shards: int):
    """Entries lang, kind, key, code in messages to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            rows, out = pa.Table.from_batches(held), defaultdict(list)
            coded = rows.column(0).combine_chunks().dictionary_encode()
            which, kind = coded.indices.to_numpy(), rows.column(1).to_numpy()
            key, code = rows.column(2).to_numpy().astype(np.uint64), rows.column(3).to_numpy().astype("<u2")
            shard = spread(key, shards)
            order = np.lexsort((key, kind, which, shard))
            of = (shard * len(coded.dictionary) + which)[order] * 2 + kind[order]
            cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                i = order[lo]
                out[int(shard[i])].append((coded.dictionary[which[i]].as_py(), int(kind[i]), order[lo:hi]))
            data = []
            for parts in out.values():
                places = np.concatenate([p for _, _, p in parts])
                data.append(pack(json.dumps([[name, k, len(p)] for name, k, p in parts]).encode(), flat(key[places]), code[places]))
            return pa.RecordBatch.from_arrays([pa.nulls(len(data), pa.int64()), pa.array(list(out), pa.int32()), pa.array(data, pa.binary())], names=["block", "shard", "data"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= DEALT:
                yield sent()
                held, n = [], 0
        if n:
            yield sent()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows block, shard, data of one shard; entries (without a block) come first."""
    entries, closed = Entries(), False
    for batch in batches:
        n = batch.column(0).null_count
        for message in batch.column(2).slice(0, n):
            entries.add(message.as_py())
        if n == len(batch):
            continue
        if not closed:
            entries.close()
            closed = True
        rest = batch.slice(n)
        replies = [entries.reply(m.as_py()) for m in rest.column(2)]
        yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.array(replies, pa.binary())], names=["block", "shard", "data"])


def log_probabilities(by_order: list[np.ndarray], p: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of the ORDER-grams, backing off through the orders; p and left are codes of all wanted n-grams."""
    ends = np.cumsum([len(k) for k in by_order])
    part = lambda x, m: x[ends[m] - len(by_order[m]) : ends[m]]
    value = np.full(len(by_order[0]), -np.log(256))  # after nothing known, every byte alike
    for m in range(1, ORDER + 1):
        keys, seen, weight = by_order[m], part(p, m), part(left, m - 1)
        weight = np.where(weight == ABSENT, 0, weight)[np.searchsorted(by_order[m - 1], keys >> np.uint64(8))]
        below = value[np.searchsorted(by_order[m - 1], low(keys, m - 1))]
        value = np.where(seen == ABSENT, below - UNIT * weight, -UNIT * seen)
    return value


def scores(block: Block, replies: dict[int, bytes], shards: int) -> list[tuple]:
    """(doc_id, name, bytes, perplexity) of each document."""
    answers = {s: [np.frombuffer(x, "<u2") for x in unpack(data)] for s, data in replies.items()}
    taken, names, out = defaultdict(lambda: (0, 0)), named(block), []
    ids = block.doc_ids()
    models = np.array([n[1:] for n in names])
    for name in sorted(set(models.tolist())):  # in the order of ask()
        docs = np.flatnonzero(models == name)
        by_order = wanted(distinct_grams(block.text[block.starts[d] : block.ends[d]] for d in docs))
        keys = numbered(by_order)
        shard = spread(keys, shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        p, left = np.empty(len(keys), np.uint16), np.empty(contexts(keys), np.uint16)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            here, (i, j) = order[cuts[s] : cuts[s + 1]], taken[s]
            n = contexts(keys[here])
            p[here], left[here[:n]] = answers[s][0][i : i + len(here)], answers[s][1][j : j + n]
            taken[s] = i + len(here), j + n
        value = log_probabilities(by_order, p, left)
        for d in docs.tolist():
            own = value[np.searchsorted(by_order[ORDER], grams(block.text[block.starts[d] : block.ends[d]]))]
            out.append((ids[d], names[d], len(own), float(np.exp(-own.mean())) if len(own) else None))
    return out


def _score(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, shard, data in zip(batch.column(0), batch.column(1), batch.column(2)):
                replies = dict(zip(shard.as_py() or [], data.as_py() or []))
                rows = scores(Block(docs.as_py()), replies, shards)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=["doc_id", "name", "n_bytes", "perplexity"])

    return run


def perplexities(made: DataFrame, entries: DataFrame, shards: int) -> DataFrame:
    """doc_id, name, n_bytes, perplexity of each document of the blocks."""
    asked = made.select("block", "docs").mapInArrow(_ask(shards), schema("block bigint, shard int, data binary"))
    rows = entries.select("lang", "kind", "key", "code").mapInArrow(_dealt(shards), schema("block bigint, shard int, data binary")).unionByName(asked)
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("block").isNotNull())
    replies = rows.mapInArrow(_answer, schema("block bigint, shard int, data binary"))
    # as long as the block's own distinct n-grams, however common they are
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias("replies"))
    both = made.select("block", "docs").join(replies.hint("merge"), "block", "left").select("docs", "replies.shard", "replies.data")
    return both.mapInArrow(_score(shards), schema("doc_id bigint, name string, n_bytes bigint, perplexity double"))


# -- decisions


def marks(labels: DataFrame) -> DataFrame:
    """doc_id, mark: 1 where labelled good, never bad and never toxic; 0 where labelled bad."""
    said = lambda c, v: F.max(F.coalesce(F.col(c) == v, F.lit(False)))
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality", 0).alias("bad"), said("toxic", 1).alias("toxic"), said("quality", 1).alias("good"))
    mark = F.when(F.col("bad"), F.lit(0)).when(F.col("good") & ~F.col("toxic"), F.lit(1)).cast("tinyint")
    return of.select("doc_id", mark.alias("mark")).where("mark is not null")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, score, threshold, rejected."""
    spark = docs.sparkSession
    prepare(spark)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    known = written(marks(labels), "marks")
    docs = docs.join(few(known), "doc_id", "left")
    held_out = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    kind = F.when((F.col("mark") == 1) & (F.length("text") > 0), F.when(held_out, "h").otherwise("t")).when(F.col("mark") == 0, "b").otherwise("a")
    made = blocks(docs.withColumn("name", F.hex(F.concat(kind, "lang"))), "quality-blocks", group="name", buckets=shuffle_partitions(spark))
    entries = model(counted(made))
    shards = max(shuffle_partitions(spark), -(-entries.count() // ENTRIES))
    scored = perplexities(made, entries, shards)
    kind = F.substr("name", F.lit(1), F.lit(1))
    scored = written(scored.select("doc_id", F.substr("name", F.lit(2)).alias("lang"), kind.alias("kind"), "n_bytes", "perplexity"), "scored")
    dropped(made, entries, known)
    trusted = F.col("kind") == "h"
    usual = scored.where(trusted).groupBy("lang").agg((F.sum(F.log("perplexity") * F.col("n_bytes")) / F.sum("n_bytes")).alias("usual"))
    mixed = F.exp((F.log("perplexity") * F.col("n_bytes") + F.col("usual") * PRIOR) / (F.col("n_bytes") + PRIOR))
    scored = scored.join(F.broadcast(usual), "lang", "left").withColumn("score", mixed)  # one row a language
    high = F.percentile_approx(F.when(trusted, F.col("score")), F.lit(HIGH), F.lit(100_000))
    worst = F.percentile_approx(F.when(F.col("kind") == "b", F.col("score")), F.lit(LOW), F.lit(100_000))
    limits = scored.where(F.col("score").isNotNull() & F.col("kind").isin("h", "b")).groupBy("lang").agg(high.alias("high"), worst.alias("low"), F.count_if(trusted).alias("n")).where(F.col("n") >= LEAST_TRUSTED)
    limits = limits.select("lang", F.when(F.col("low") > F.col("high"), F.sqrt(F.col("low") * F.col("high"))).otherwise(F.col("high")).alias("threshold"))
    out = scored.join(F.broadcast(limits), "lang", "left")
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "score", "threshold", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)).alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns. A doc_id goes only if each of its rows is rejected."""
    gone = classify(docs, labels).groupBy("doc_id").agg(F.min("rejected").alias("rejected")).where("rejected and doc_id is not null").select("doc_id")
    return docs.join(few(written(gone, "gone")), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
