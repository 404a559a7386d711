"""Operator 1: near-duplicate documents by HyperMinHash.

A document's set of 5-word shingles is hashed once. The hash range is cut into REGISTERS buckets; of each bucket's least
hash a register keeps how many leading zeros follow the bucket's prefix and the next mantissa bits: eight bits in all.
Empty buckets borrow the register of another bucket by fixed permutations, so that short texts compare as long ones do.
Bands of ROWS registers give candidates: a pair of Jaccard similarity 0.75 shares no band with probability
(1 - 0.75**6)**56 < 2e-5, a pair of 0.85 with less than 1e-11. Candidates pass an estimate that is corrected for registers
that are equal by chance and set six standard deviations below the threshold; those left are confirmed on the full sets
of both texts.

Plan, without pairs inside groups:
- equal sets are one node (by a 128-bit fingerprint); the smallest doc_id stands for it;
- a band's bucket first links each member to the bucket's smallest node: as many candidates as members;
- after components of the confirmed links, only documents in buckets whose members still lie in different components are
  looked at again, and only across components. Their shingles are put in order from the rarest among them; a pair whose
  first common shingle stands at places i and j of n and m shares at most min(n - i, m - j). So pairs meet at the shingles
  of their prefixes, and only where that bound allows a link. Texts that merely quote the same passage, and copies whose
  edits are their own, never meet: what they share comes after too much that they don't;
- the rest are estimated and confirmed; then components again. So links between different texts are all found where a
  bucket sees them, while a large group of near copies costs one comparison a member and bucket at most.

A set is a node with a number of its own, whatever doc_ids its documents have; a doc_id with several texts links their sets.
Keys that very many rows share (a star, a common shingle) are counted first; there are few of them, and their rows are salted
or get what they need by broadcast.

Result: doc_id, n_shingles, component_id, kept. Null, empty and wordless texts: n_shingles 0, linked with nothing. A null
doc_id: component null, kept, links nothing. Very long texts are compared whole, in a batch of their own. Repeated rows are equal
sets. Ties: similarity of exactly 0.75 links. Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._session import dropped, few, prepare, schema, shuffle_partitions, written
from ._shingles import mix, shared, shingle_set

ROWS, BANDS = 6, 56
REGISTERS = ROWS * BANDS
ZERO_BITS, MANTISSA_BITS = 4, 4
#: A pair is linked if NUM * |union| <= DEN * |intersection|.
NUM, DEN = 75, 100
DEVIATIONS = 6
HOT, SALTS, COMMON = 256, 16, 20_000

#: For each register, in which order it asks others when its bucket is empty.
ASK = np.random.default_rng(20).permuted(np.tile(np.arange(REGISTERS, dtype=np.int16), (REGISTERS, 1)), axis=1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty sorted set."""
    scaled = (hashes >> np.uint64(11)).astype(np.float64) * (REGISTERS / 2.0**53)
    bucket = scaled.astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    mantissa, exponent = np.frexp(scaled[first] - bucket[first])
    zeros = np.clip(-exponent, 0, (1 << ZERO_BITS) - 1)
    tail = np.clip((mantissa * 2 - 1) * (1 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1)
    out, full = np.zeros(REGISTERS, np.uint8), np.zeros(REGISTERS, bool)
    out[bucket[first]] = zeros << MANTISSA_BITS | tail.astype(np.int64)
    full[bucket[first]] = True
    if len(first) < REGISTERS:
        bare = np.flatnonzero(~full)
        ask = ASK[bare]
        out[bare] = out[ask[np.arange(len(bare)), full[ask].argmax(1)]]
    return out


def chance() -> float:
    """How often two registers of unrelated sets agree: the same leading zeros and mantissa."""
    zeros = np.array([2.0 ** -(k + 1) for k in range((1 << ZERO_BITS) - 1)])
    return float((zeros**2).sum() + (1 - zeros.sum()) ** 2) / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, row by row, corrected for equal registers by chance."""
    p = chance()
    return ((a == b).mean(-1) - p) / (1 - p)


def least_estimate() -> float:
    j = NUM / DEN
    return j - DEVIATIONS * (j * (1 - j) / REGISTERS) ** 0.5


def signatures(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, set_print (128 bits of the set), registers; with_text: doc_id, set_print and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            if with_text:
                prints = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), prints, batch.column(1)], names=["doc_id", "set_print", "text"])
                continue
            out = (
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            )
            yield pa.RecordBatch.from_arrays(list(out), names=["doc_id", "n_shingles", "set_print", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema("doc_id bigint, set_print binary, text string" if with_text else "doc_id bigint, n_shingles bigint, set_print binary, registers binary"))


def bands(nodes: DataFrame) -> DataFrame:
    """node, n, key: a row for each band of a node's registers."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.zeros(r.shape[:2], np.uint64)
            for i in range(ROWS):
                key = key << np.uint64(8) | r[:, :, i]
            key = mix(mix(key) + salt)
            repeat = lambda c: pa.array(np.repeat(c.to_numpy(zero_copy_only=False), BANDS), pa.int64())
            yield pa.RecordBatch.from_arrays([repeat(batch.column(0)), repeat(batch.column(1)), pa.array(key.ravel().view(np.int64))], names=["node", "n", "key"])

    return nodes.select("node", "n", "registers").mapInArrow(run, schema("node bigint, n bigint, key bigint"))


def bucket_members(banded: DataFrame) -> DataFrame:
    """key, node, n, star (the bucket's smallest node), star_n, for buckets of more than one node.

    Streams sorted partitions, so a bucket may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, and whether its bucket has been opened
        for batch in batches:
            key, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(key):
                continue
            if held is not None:
                key, node, n = (np.concatenate(([h], x)) for h, x in zip(held[:3], (key, node, n)))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            start = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            star, star_n = node[start][of], n[start][of]
            if held is not None:
                star[of == 0], star_n[of == 0] = held[3], held[4]
            size = np.diff(np.append(start, len(key)))[of]
            emit = size > 1
            if held is not None:
                emit[0] &= not held[5]
            last = len(key) - 1
            held = key[last], node[last], n[last], star[last], star_n[last], bool(emit[last] or (last == 0 and held is not None and held[5]))
            yield pa.RecordBatch.from_arrays([pa.array(x[emit]) for x in (key, node, n, star, star_n)], names=["key", "node", "n", "star", "star_n"])

    return banded.select("key", "node", "n").repartition(shuffle_partitions(banded.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(run, schema("key bigint, node bigint, n bigint, star bigint, star_n bigint"))


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate doesn't rule a link out. pairs: a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_estimate()
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(estimate(a, b) >= least))

    side = lambda name: nodes.select(F.col("node").alias(name), F.col("registers").alias(f"r{name}"))
    both = salted_join(pairs.join(side("b"), "b"), side("a"), pairs)
    return both.select("a", "b", "ra", "rb").mapInArrow(run, schema("a bigint, b bigint"))


def salted_join(rows: DataFrame, side: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows joined with side on a. What stands in more than 1/HOT of the pairs (less than HOT keys) is spread over SALTS keys."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("of_a"))
    hot = F.broadcast(counts.where(F.col("of_a") * HOT > max(pairs.count(), SALTS * HOT)).select("a", F.lit(SALTS).alias("salts")))
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    rows = rows.join(hot, "a", "left").withColumn("salt", salt).drop("salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    return rows.join(side.join(hot, "a", "left").withColumn("salt", copies).drop("salts"), ["a", "salt"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs that are links by the full sets of both texts. pairs: a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if (a, ta) != last:
                    last, held = (a, ta), shingle_set(ta)
                other = shingle_set(tb)
                both = shared(held, other)
                keep.append(DEN * both >= NUM * (len(held) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"t{name}"))
    both = salted_join(pairs.join(side("b"), "b"), side("a"), pairs)
    return both.select("a", "b", "ta", "tb").mapInArrow(run, schema("a bigint, b bigint")).distinct()


def across(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes in different components whose prefixes leave room for a link. groups: node, component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), 64):
                sets = [shingle_set(t) for t in batch.column(1)[lo : lo + 64].to_pylist()]
                n = np.array([len(s) for s in sets], np.int64)
                out = (*(np.repeat(c, n) for c in (ids[lo : lo + 64], n)), np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["node", "n", "h"])

    own = texts.join(groups.select("node"), "node").select("node", "text")
    rows = written(own.mapInArrow(run, schema("node bigint, n bigint, h bigint")), "shingles")
    counts = rows.groupBy("h").agg(F.count("*").alias("held_by")).where("held_by > 1")
    common = written(counts.where(F.col("held_by") * COMMON > rows.count()), "common")  # less than COMMON rows
    light = counts.join(F.broadcast(common.select("h")), "h", "left_anti")
    often = rows.join(F.broadcast(common), "h")
    rows = rows.join(F.broadcast(common.select("h")), "h", "left_anti").join(light, "h").unionByName(often)
    mine = Window.partitionBy("node")
    rows = rows.withColumn("place", F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("held_by", "h")) - 1)
    rows = rows.where(f"{DEN} * (n - place) >= {NUM} * n").select("node", "n", "h", "place").join(groups, "node")
    x, y = rows.alias("x"), rows.alias("y")
    most = "least(x.n - x.place, y.n - y.place)"
    room = f"{DEN} * {most} >= {NUM} * (x.n + y.n - {most})"
    found = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.component") < F.col("y.component")) & F.expr(room))
    return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def texts_of(docs: DataFrame, wanted: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """node, text: of each wanted set (node, doc_id, set_print) the text of a document of that doc_id. repeated: doc_ids of several rows,
    whose texts are told apart by their sets."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if repeated is None:
        return docs.join(few(wanted.select("doc_id", "node")), "doc_id").select("node", "text")
    again = signatures(docs.join(repeated, "doc_id", "left_semi"), with_text=True)
    again = again.join(wanted, ["doc_id", "set_print"]).select("node", "text").dropDuplicates(["node"])
    return texts_of(docs.join(repeated, "doc_id", "left_anti"), wanted, None).unionByName(again)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, set_print."""
    prepare(docs.sparkSession)
    signed = written(signatures(docs), "signatures")
    known = signed.where("set_print is not null and doc_id is not null")
    classes = known.groupBy("set_print").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    repeated = written(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    some = repeated.count() > 0
    # nodes are in the order of doc_ids: an original comes before its copies, and is like more of them than they are like each other
    if some:
        classes = classes.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "set_print").withColumn("node", F.monotonically_increasing_id())
    else:
        classes = classes.withColumn("node", F.col("doc_id"))
    classes = written(classes, "classes")

    members = written(bucket_members(bands(classes)), "buckets")
    near = f"{DEN} * least(n, star_n) >= {NUM} * greatest(n, star_n)"
    wanted = members.select("node").distinct()
    nodes = written(classes.join(wanted, "node"), "nodes")
    texts = written(texts_of(docs, nodes.select("node", "doc_id", "set_print"), repeated if some else None), "texts")

    first = members.where(f"node <> star and {near}").select(F.col("star").alias("a"), F.col("node").alias("b")).distinct()
    first = written(first, "pairs")
    links = written(confirmed(written(likely(first, nodes), "likely"), texts), "confirmed")
    if some:  # sets of one doc_id
        of_doc = known.join(repeated, "doc_id", "left_semi").select("doc_id", "set_print").distinct().join(classes.select("set_print", "node"), "set_print")
        least = of_doc.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = written(links.unionByName(of_doc.join(least, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))), "confirmed")
    groups = components(links)

    # buckets whose members still lie in different components, paired across components only
    labelled = members.select("key", "node", "n").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = written(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rest = written(labelled.join(mixed, "key").select("node", "component").distinct(), "mixed")
    dropped(members, labelled)
    second = across(texts, rest)
    second = second.join(first, ["a", "b"], "left_anti")
    more = written(confirmed(written(likely(written(second, "pairs"), nodes), "likely"), texts), "confirmed")
    dropped(texts, nodes)
    groups = components(links.unionByName(more))

    of_set = classes.select("set_print", "doc_id", "node").join(groups, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    if some:  # nodes are no doc_ids then
        least = of_set.groupBy("component_id").agg(F.min("doc_id").alias("least"))
        of_set = of_set.join(least, "component_id").withColumn("component_id", F.col("least"))
    of_set = of_set.select("set_print", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_print").join(of_set, "set_print", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"), "set_print")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns. Of rows with one doc_id the text with the
    smallest hash stays, once (of rows with equal texts and other columns that differ, either); documents without an id all stay."""
    gone = few(written(near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct(), "gone"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    kept = kept.select(*columns, F.row_number().over(one).alias(ROW)).where(F.col(ROW) == 1)
    return kept.select(*columns).unionByName(docs.where("doc_id is null"))


#: A column of our own beside the caller's.
ROW = "permeon row of doc_id"
