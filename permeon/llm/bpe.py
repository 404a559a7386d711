"""Operator 9: BPE encoding and decoding through an index of pair occurrences.

All distinct pieces of GROUP documents that the worker hasn't met lately lie in one symbol array. An index maps the rank of each
mergeable pair to the positions where the pair stands, over all of them. Ranks that occur are taken in ascending order from a heap; a rank's merge is
applied at all of its positions, and the lists of the pairs that appear to the left and right get the new positions.
A merge's token is made by that merge alone, so pairs that appear always have higher ranks, and one ascending pass over
the batch gives each piece what piece-by-piece merging would give it.

Documents are independent: a map over Arrow batches without a shuffle. Pieces repeat between documents, so a worker
keeps a bounded memo of their ids (see _encode).

Null and empty texts have no ids: n_tokens 0 and the digests of nothing. Repeated rows each give a row, a null doc_id
stays null. Very long texts are encoded whole, in a batch of their own. Empty table: no rows. The special token's literal in a text gives its id, as in the library's default. Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._encode import ChunkEncoder
from ._session import prepare, schema

#: Documents whose new pieces are merged together.
GROUP = 64
END = -1
DEAD = -2


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(others)}


class PairIndexBpe:
    """A byte-level BPE vocabulary. encode() gives ids, decode() text; both follow the tokenizers library."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of_char = spec["model"], byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"] | self.special
        self.bytes_of = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(of_char[c] for c in token)
        self.id_of_byte = [0] * 256
        for c, b in of_char.items():
            self.id_of_byte[b] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank_of = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.pairs = [(ids[a], ids[b]) for a, b in merges]
        self.find = regex.compile(pattern).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")").split if self.special else None

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens; ids of special tokens as they stand in the text."""
        if self.apart is None or not any(s in text for s in self.special):
            return self.find(text)
        return [p for x in self.apart(text) for p in ([self.special[x]] if x in self.special else self.find(x))]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; all distinct pre-tokens are merged together."""
        cut = [self.pieces(t) for t in texts]
        words = list({w for pieces in cut for w in pieces if isinstance(w, str)})
        ids = dict(zip(words, self.merge_all([w.encode() for w in words])))
        return [np.array([i for w in pieces for i in (ids[w] if isinstance(w, str) else (w,))], "<u4").tobytes() for pieces in cut]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        of_byte, rank_of = self.id_of_byte, self.rank_of
        symbols, starts = [END], []
        for w in words:
            starts.append(len(symbols))
            symbols.extend([of_byte[b] for b in w])
            symbols.append(END)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        where: dict[int, list[int]] = {}
        for p in range(1, len(symbols) - 1):
            if (r := rank_of.get(symbols[p] << 32 | symbols[p + 1])) is not None and symbols[p] >= 0 and symbols[p + 1] >= 0:
                where.setdefault(r, []).append(p)
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            (a, b), new = self.pairs[r], self.made[r]
            for p in sorted(where.pop(r)):
                q = after[p]
                if symbols[p] != a or symbols[q] != b:
                    continue
                symbols[p], symbols[q] = new, DEAD
                right, left = after[q], before[p]
                after[p], before[right] = right, p
                if (s := symbols[left]) >= 0 and (x := rank_of.get(s << 32 | new)) is not None:
                    if x in where:
                        where[x].append(left)
                    else:
                        where[x] = [left]
                        heapq.heappush(active, x)
                if (s := symbols[right]) >= 0 and (x := rank_of.get(new << 32 | s)) is not None:
                    if x in where:
                        where[x].append(p)
                    else:
                        where[x] = [p]
                        heapq.heappush(active, x)
        out = []
        for p in starts:
            ids = []
            while (s := symbols[p]) != END:
                ids.append(s)
                p = after[p]
            out.append(ids)
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODERS: dict[str, tuple[PairIndexBpe, ChunkEncoder]] = {}


def coder(path: str, pattern: str) -> tuple[PairIndexBpe, ChunkEncoder]:
    """The worker's coder and its memo of pieces; kept for later tasks."""
    if path not in _CODERS:
        bpe = PairIndexBpe(path, pattern)
        _CODERS[path] = bpe, ChunkEncoder(bpe.encode_texts, byte_level=True)
    return _CODERS[path]


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded text; without keep_ids only digests of both."""
    prepare(docs.sparkSession)
    kept = "ids binary, decoded string" if keep_ids else "ids_sha256 string, decoded_sha256 string"
    out = schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, {kept}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = coder(path, pattern)
        for batch in batches:
            n, first, second = [], [], []
            for ids in memo.encode_batch(batch.column(1).to_pylist(), GROUP):
                decoded = bpe.decode(ids)
                n.append(len(ids) // 4)
                first.append(ids if keep_ids else hashlib.sha256(ids).hexdigest())
                second.append(decoded if keep_ids else hashlib.sha256(decoded.encode()).hexdigest())
            names = [f.name for f in out]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.binary() if keep_ids else pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip((n, first, second), kinds[1:]))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, out)
