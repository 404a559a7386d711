"""Operator 12: groups of spelling variants: words one inserted, deleted or replaced letter apart, by rolling-hash deletions.

Words are counted where their documents are read, with a bounded dictionary, and summed in one shuffle. Every word then gives a key
for itself and one for each letter that it can lose: from its prefix and suffix polynomial hashes (modulo 2^64), a deletion's hash is
prefix + suffix / base, so NumPy makes all keys of all words of a length in a few array operations. Keys are radix-partitioned by
their highest bits and sorted within. Two words of one length are near if they lose a letter at the same place and agree (a run of
one key and place); two of neighbouring lengths if what one loses leaves the other (a run with a word's own key). Such rows, and only these,
fetch their words; the strings, not the hashes, then decide.

A run gives each of its words the number and the best of the others (from the two best of the run), so no pairs are made. Runs are
bounded by the alphabet (90 letters at a place), and hashing spreads keys, so no word or source makes a task large. A word of n
letters costs n + 1 rows of numbers, not of strings; only true neighbours carry theirs.

Null and empty texts: no words. Null doc_id: '' in the hash that deletes letters. Repeated rows and equal doc_ids count each time. Ties
of a form: the smaller word. Very long texts and words: in pieces of bounded size. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import parts_for, prepare, schema, written
from ._shingles import mix

#: The least letters and occurrences of a word, how many times more frequent its form is, and the share of runs that lose a letter.
LETTERS, TIMES, FORM, DAMAGED = 7, 2, 10, 31
#: Entries in a task's dictionary; it is handed on when it has more.
HELD = 400_000
#: Keys that a task sorts, about.
RADIX_ROWS = 400_000
#: Letters hashed together.
CELLS = 1 << 20
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Latin-1 bytes of a text: letters (A-Z as a-z), and spaces for all else.
LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of at least LETTERS letters, in Latin-1."""
    return [w for w in (text or "").encode("latin-1", "replace").translate(LETTER).split(b" ") if len(w) >= LETTERS]


def damaged(words: dict[bytes, int], doc_id: str) -> Iterator[tuple[bytes, int]]:
    """The document's words, some of them less a letter: the hash of id and word says which, and where."""
    seed = zlib.crc32(f"{doc_id}:".encode())
    for w, n in words.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
        if h % DAMAGED == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
            if len(w) < LETTERS:
                continue
        yield w, n


def counts(docs: DataFrame) -> DataFrame:
    """word, n: partial counts, a row for each word of a task's dictionary."""

    def batch(held: dict[bytes, int]) -> pa.RecordBatch:
        words = b"\n".join(held).decode("latin-1").split("\n") if held else []
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in damaged(Counter(runs(text)), doc_id or ""):
                    held[w] += n
                if len(held) > HELD:
                    yield batch(held)
                    held.clear()
        yield batch(held)

    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema("word string, n bigint"))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def deletion_keys(letters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For words of one length (a row each, Latin-1): (-1, keys of the words), then (place, keys of the words without that letter and
    the next ones) in pieces."""
    length, step = letters.shape[1], max(1, CELLS // max(len(letters), 1))
    value, base = mix(np.arange(256, dtype=np.uint64) + np.uint64(1)), powers(BASE, length)
    total = np.zeros(len(letters), np.uint64)
    for lo in range(0, length, step):
        total += (value[letters[:, lo : lo + step]] * base[lo : lo + step]).sum(1, dtype=np.uint64)
    own, shorter = mix(np.array([length, length - 1], np.uint64))
    yield -1, mix(total ^ own)[:, None]
    prefix = np.zeros((len(letters), 1), np.uint64)
    for lo in range(0, length, step):
        terms = value[letters[:, lo : lo + step]] * base[lo : lo + step]
        upto = prefix + np.cumsum(terms, 1, dtype=np.uint64)
        suffix = total[:, None] - upto
        yield lo, mix((upto - terms + suffix * np.uint64(BACK)) ^ shorter)
        prefix = upto[:, -1:]


def keys(words: DataFrame) -> DataFrame:
    """key, place (-1: the word itself), id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            flat = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
            lengths = np.array([len(t) for t in texts])
            starts = np.cumsum(lengths) - lengths
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                for part in np.array_split(rows, max(1, len(rows) * int(n) // CELLS)):
                    for place, made in deletion_keys(flat[starts[part][:, None] + np.arange(n)]):
                        places = np.tile(np.arange(place, place + made.shape[1], dtype=np.int32), len(part))
                        yield pa.RecordBatch.from_arrays([pa.array(made.ravel().view(np.int64)), pa.array(places), pa.array(np.repeat(ids[part], made.shape[1]))], names=["key", "place", "id"])

    return words.select("id", "word").mapInArrow(run, schema("key bigint, place int, id bigint"))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def meeting(table: pa.Table) -> pa.Table:
    """Of a radix partition's keys, those in runs: key, run (the place that all lose, or -1 where one is whole), lost (-1: nothing), id."""
    key, place, word = (table[c].to_numpy() for c in ("key", "place", "id"))
    order = np.argsort(key)
    first = _starts(key[order])
    size = np.diff(np.append(first, len(order)))
    order = order[np.repeat(size > 1, size)]
    order = order[np.lexsort((word[order], place[order], key[order]))]
    key, place, word = key[order], place[order], word[order]
    first = _starts(key, place)
    size = np.diff(np.append(first, len(key)))
    same = np.repeat(size > 1, size) & (place >= 0)
    # runs with a whole word: it, and the first place of each other word
    first = _starts(key)
    size = np.diff(np.append(first, len(key)))
    with_whole = np.flatnonzero(np.repeat(place[first] == -1, size) if len(first) else np.zeros(0, bool))
    with_whole = with_whole[np.lexsort((place[with_whole], word[with_whole], key[with_whole]))]
    with_whole = with_whole[_starts(key[with_whole], word[with_whole])]
    pick = np.concatenate((np.flatnonzero(same), with_whole))
    run = np.concatenate((place[same], np.full(len(with_whole), -1, np.int32)))
    return pa.table({"key": key[pick], "run": run, "lost": place[pick], "id": word[pick]})


def neighbours(table: pa.Table) -> pa.Table:
    """Of the rows that meet, with their words and counts: id, near (how many), best_n, best."""
    groups = defaultdict(list)
    for run, lost, word, i, n in zip(*(table[c].to_pylist() for c in ("run", "lost", "word", "id", "n"))):
        groups[run, word if lost < 0 else word[:lost] + word[lost + 1 :]].append((-n, word, i, lost < 0))
    out = []
    for (run, _), rows in groups.items():
        if run >= 0:
            if len(rows) > 1:
                a, b = sorted(rows)[:2]
                out += [(i, len(rows) - 1, b if i == a[2] else a) for _, _, i, _ in rows]
        elif whole := [r for r in rows if r[3]]:
            others = [r for r in rows if not r[3]]
            if others:
                out.append((whole[0][2], len(others), min(others)))
                out += [(i, 1, whole[0]) for _, _, i, _ in others]
    return pa.table({"id": pa.array([r[0] for r in out], pa.int64()), "near": pa.array([r[1] for r in out], pa.int64()), "best_n": pa.array([-r[2][0] for r in out], pa.int64()), "best": pa.array([r[2][1] for r in out], pa.string())})


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n, for every word."""
    spark = docs.sparkSession
    prepare(spark)
    words = counts(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)
    words = written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    size = words.agg(F.sum(F.length("word") + 1).alias("keys"), F.max("n").alias("most")).first()
    bits = max(1, math.ceil(math.log2(parts_for(size["keys"] or 0, RADIX_ROWS))))
    radix = F.shiftrightunsigned("key", 64 - bits).alias("radix")
    met = keys(words).select(radix, "*").groupBy("radix").applyInArrow(meeting, schema("key bigint, run int, lost int, id bigint"))
    met = written(met, "meeting").join(words, "id").select(radix, "run", "lost", "word", "id", "n")
    near = met.groupBy("radix").applyInArrow(neighbours, schema("id bigint, near bigint, best_n bigint, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    near = words.join(near.groupBy("id").agg(F.sum("near").alias("n_near"), best), "id", "left")
    formed = -F.col("best.less") >= FORM * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    near = written(near, "near")
    roots = near.where("form is not null").select("word", F.col("form").alias("root"))
    # counts grow tenfold along a chain of forms, so the largest count bounds its length; each round doubles what is followed
    chain = math.floor(math.log(max(size["most"] or 1, TIMES) / TIMES, FORM) + 1e-9)
    for _ in range(math.ceil(math.log2(max(chain, 1)))):
        roots = written(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
