"""Exact, memoised encoding with the tokenizers library.

Both vocabularies split a text at single spaces (and line ends), and between an ASCII letter and the punctuation that ends a word, before any
merge, so a text's ids are the ids of its pieces, one after the other. Pieces repeat, so each worker memoises them; a memo keeps two
generations of bounded size, so what is in use stays. A text in which white space meets white space is not cut, but encoded as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain, filterfalse

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries in a generation of the memo: about 200 MB a worker in both.
PIECES = 500_000
#: Texts that are cut before any is encoded.
GROUP = 16
#: Characters in a generation, however few the entries are.
MEMO_BYTES = 64 << 20
#: A word's end that starts a token of its own after a letter, in both vocabularies: before the cut of one and of the other. Only ASCII letters
#: count, as normalisation makes a letter and a mark, which goes along with the punctuation, of some others. The set comes first, since a pattern is
#: searched fast by its first character.
ENDING = {True: re.compile(r"[.,!|$%&#*](?<=[A-Za-z].)[.,!|$%&#*]*(?=\0|\Z)"), False: re.compile(r"[.,!|$%&#*](?<=[A-Za-z].)[.,!|$%&#*]*(?= |\Z)")}

Pieces = Callable[[list[str]], list]


class Uncut(Exception):
    """The text can't be cut into pieces."""


class ChunkEncoder:
    """Texts to ids, as little-endian unsigned 32-bit integers. whole: encodes uncut pieces. counting: whole gives numbers of ids, and
    so do texts."""

    def __init__(self, whole: Pieces, byte_level: bool, counting: bool = False) -> None:
        self.whole, self.byte_level, self.counting = whole, byte_level, counting
        self.nothing, self.total = (0, sum) if counting else (b"", b"".join)
        # nothing between two line ends is white space that meets white space
        self.always: dict = {} if byte_level else {"": self.nothing}
        self.memo, self.old = dict(self.always), {}
        self.held = 0

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None], group: int = GROUP) -> list:
        """The ids of each text; what is new in any of a group is encoded together."""
        return [ids for lo in range(0, len(texts), group) for ids in self._encode(texts[lo : lo + group])]

    def _encode(self, texts: list[str | None]) -> list:
        if len(self.memo) > PIECES or self.held > MEMO_BYTES:
            self.old, self.memo, self.held = self.memo, dict(self.always), 0
        cuts, uncut = [], []
        for i, text in enumerate(texts):
            try:
                cuts.append(self.cut(text) if text else [])
            except Uncut:
                cuts.append([])
                uncut.append(i)
        new = set(filterfalse(self.memo.__contains__, chain.from_iterable(cuts)))
        if alone := self.inseparable(new):
            uncut += [i for i, cut in enumerate(cuts) if not alone.isdisjoint(cut)]
            for i in uncut:
                cuts[i] = []
            new -= alone
        if new:
            self.learn(new)
        known, total = self.memo.__getitem__, self.total
        out = [total(map(known, cut)) for cut in cuts]
        if uncut:
            for i, ids in zip(uncut, self.whole([texts[i] for i in uncut])):
                out[i] = ids
        return out

    def inseparable(self, new: set[str]) -> set[str]:
        """Pieces with white space of their own, whose texts must stay whole."""
        if not self.byte_level:
            return set()
        cores = ((c, c[1:] if c[:1] == " " else c) for c in new if c != "\n")
        return {c for c, core in cores if not core or core[0].isspace() or core[-1].isspace()}

    def cut(self, text: str) -> list[str]:
        ending = ENDING[self.byte_level].sub
        if not self.byte_level:
            return ending(r" \g<0>", text.replace("\n", " ")).split(" ")
        if "\0" in text:
            raise Uncut
        cut = ending("\0\\g<0>", text.replace("\n", "\0\n\0").replace(" ", "\0 ")).split("\0")
        if not cut[-1]:
            cut.pop()
        return cut[1:] if cut and not cut[0] else cut

    def learn(self, new: set[str]) -> None:
        again = self.old.keys() & new
        self.memo.update((x, self.old[x]) for x in again)
        if wanted := list(new - again):
            self.memo.update(zip(wanted, self.whole(wanted)))
        self.held += sum(map(len, new))


#: Pieces that are encoded in one call, with a special token between them, whose text ends what is before it in any vocabulary.
JOINED = 512


def library_pieces(path: str, counting: bool = False) -> Pieces:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    # a special token that neither normalisation nor its neighbours touch
    plain = [(i, t.content) for i, t in sorted(tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
    between, mark = plain[0] if plain else (None, "")

    def alone(pieces: list[str]) -> list:
        out = []
        for i in range(0, len(pieces), 64):
            out += [len(e) if counting else np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(pieces[i : i + 64], add_special_tokens=False)]
        return out

    def whole(pieces: list[str]) -> list:
        if between is None or len(pieces) < 2:
            return alone(pieces)
        out = []
        for lo in range(0, len(pieces), JOINED):
            some = pieces[lo : lo + JOINED]
            (e,) = tokenizer.encode_batch_fast([mark.join(some)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == between)
            if len(ends) != len(some) - 1:  # the token's own text is in a piece
                out += alone(some)
            elif counting:
                out += (np.diff(np.concatenate(([-1], ends, [len(ids)]))) - 1).tolist()
            else:
                data, ends = ids.tobytes(), (4 * ends).tolist()
                out += [data[a:b] for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(data)])]
        return out

    return whole


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def library_encoder(path: str, byte_level: bool) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file; kept for later tasks of the same worker."""
    key = ("library", path, byte_level)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(library_pieces(path), byte_level)
    return _ENCODERS[key]


#: Bits of each tokenizer's number in a sum of several.
COUNT_BITS = 40


def library_counter(tokenizers: tuple[tuple[str, bool], ...]) -> ChunkEncoder:
    """Numbers of ids by several tokenizers (file, whether byte-level) in one integer each, the first lowest; texts are cut once, as
    byte-level ones want it if there is one, which suits the others too."""
    key = ("counter", tokenizers)
    if key not in _ENCODERS:
        wholes = [library_pieces(path, counting=True) for path, _ in tokenizers]

        def whole(pieces: list[str]) -> list[int]:
            return [sum(n << COUNT_BITS * i for i, n in enumerate(each)) for each in zip(*(w(pieces) for w in wholes))]

        _ENCODERS[key] = ChunkEncoder(whole, any(byte_level for _, byte_level in tokenizers), counting=True)
    return _ENCODERS[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
