"""Corpus operators against brute force, on small tables with every awkward case."""

import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from permeon.llm import ann, bpe, embdedup, kneser, license, minhash, packing, suffix, tokencounts, wavelet
from permeon.llm._blocks import pack
from permeon.llm._encode import library_encoder, public_path

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdeéß"), RNG.integers(1, 7))) for _ in range(400)]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


def texts():
    base, passage = prose(200, 1), prose(25, 2)
    words = base.split(" ")
    edits = [" ".join([*words[:i], "edited", *words[i + 1 :]]) for i in (10, 50, 90)]
    awkward = [None, "", " ", "\n", "a", "Two words", "A b c d E", "a\tb  c\n\nd ", " x\n", "\n\n x", "it's <|endoftext|> isn't<|endoftext|>,", "ﬁ Ⅷ é ñ 你好 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 4, "x" * 60, "nul\0byte \0", "!! !! ... $$$ ,,a,, b..", " nbsp em \x1cfs"]
    return [*awkward, base, base, *edits, prose(40, 3) + " " + passage, passage + " " + prose(60, 4), prose(5000, 5), prose(3, 6), prose(3, 6)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 101, t, ["en", None, "de"][i % 3], "src0" if i % 3 else None, i, 1) for i, t in enumerate(texts())]
    rows += [(None, prose(12, 7), "en", "s", 0, 2), rows[1], rows[18]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def local(df):
    return [r.asDict() for r in df.collect()]


def key(d):
    return (d is not None, d or 0)


@pytest.mark.parametrize(("path", "byte_level"), [(BYTE, True), (WORD, False)])
def test_chunks_encode_as_the_library(path, byte_level):
    encoder, whole = library_encoder(path, byte_level), Tokenizer.from_file(path)
    for t in texts():
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "byte_level"), [(BYTE, True), (WORD, False)])
def test_every_letter_before_punctuation(path, byte_level):
    encoder, whole = library_encoder(path, byte_level), Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    marks = ".,!|$%&#*"
    texts = [f"{c}{marks[i % 9]} x{c}{marks[i // 9 % 9]}{marks[i % 7]}" for i, c in enumerate(letters)]
    texts += [f"a{c}{m}" for c in letters if c.lower() != c or unicodedata.normalize("NFD", c) != c for m in marks if c != m][:: 3 if byte_level else 1]
    texts += ["GELDİ, EVET.", "আমি হয়, বড়. a", "आज़. क़, ड़!", "שּׁ. x", "İ. İİ, aİ!b"]
    for lo in range(0, len(texts), 4096):
        some = texts[lo : lo + 4096]
        want = [e.ids for e in whole.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_batch(some)] == want


def test_bpe(spark, docs, empty):
    t = Tokenizer.from_file(BYTE)
    got = {(r["doc_id"], bytes(r["ids"])): r["decoded"] for r in local(bpe.encode(docs, BYTE, public_tokenizers.PATTERN))}
    for d in local(docs):
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        assert got[d["doc_id"], np.array(ids, "<u4").tobytes()] == t.decode(ids, skip_special_tokens=False)
    digests = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in local(bpe.encode(docs, BYTE, public_tokenizers.PATTERN, keep_ids=False))}
    assert digests == {(i, hashlib.sha256(x).hexdigest(), hashlib.sha256(s.encode()).hexdigest(), len(x) // 4) for (i, x), s in got.items()}
    assert bpe.encode(empty, BYTE, public_tokenizers.PATTERN).count() == 0


def test_wavelet_matrix():
    for ids in (np.array([5, 1, 5, 0, 7, 5, 2]), np.zeros(9, int), RNG.integers(0, 50_000, 3000), np.array([], int), np.array([70_000, 3])):
        file = wavelet.to_file([None, 4], [1, len(ids) - 1], ids) if len(ids) else wavelet.to_file([], [], ids)
        doc_ids, _, m = wavelet.from_file(file)
        assert m.decode().tolist() == ids.tolist() and (not len(ids) or doc_ids == [None, 4])
        for i in RNG.integers(0, max(len(ids), 1), 10) if len(ids) else []:
            token = int(ids[i])
            assert m.access(int(i)) == token and m.rank(token, int(i)) == (ids[:i] == token).sum() and m.count(token) == (ids == token).sum()
            assert m.occurrences(token)[:5] == np.flatnonzero(ids == token)[:5].tolist()
        assert m.count(1 << 20) == 0
        with pytest.raises(IndexError):
            m.access(len(ids))


def test_wavelet_file_is_read_in_pieces():
    ids = RNG.integers(0, 300, 200_000)
    m = wavelet.from_file(wavelet.to_file([1], [len(ids)], ids))[2]
    assert m.access(150_001) == ids[150_001] and len(m._pieces) <= m.depth
    assert m.rank(7, 123_456) == (ids[:123_456] == 7).sum() and m.count(7) == (ids == 7).sum() and m.select(7, 100) == np.flatnonzero(ids == 7)[100]
    assert len(m._pieces) < m.depth * m._a_plane and np.array_equal(m.decode(), ids)


def test_lookups_in_all_files(spark, docs, tmp_path):
    t, folder = Tokenizer.from_file(BYTE), str(tmp_path / "files")
    wavelet.write_files(docs, BYTE, folder, shard_tokens=300)
    held = [(d["doc_id"], [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]) for d in local(docs)]
    tokens = [0, 64, 257, 49_999]
    assert {r["token"]: r["n"] for r in local(wavelet.count_tokens(spark, folder, tokens))} == {x: sum(ids.count(x) for _, ids in held) for x in tokens}
    for x in tokens[:3]:
        got = local(wavelet.occurrences(spark, folder, x))
        assert sorted((key(r["doc_id"]), r["position"]) for r in got) == sorted((key(d), i) for d, ids in held for i, y in enumerate(ids) if y == x)
        assert len({r["place"] for r in got}) == len(got)


def test_token_files(spark, docs, empty):
    t = Tokenizer.from_file(BYTE)
    got = sorted(local(wavelet.token_files(docs, BYTE)), key=lambda r: r["start"])
    ids = sorted(((key(d["doc_id"]), np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")) for d in local(docs)), key=lambda x: x[0])
    assert [key(r["doc_id"]) for r in got] == [k for k, _ in ids]
    assert sorted((r["ids_crc32"], r["n_tokens"]) for r in got) == sorted((zlib.crc32(x.tobytes()), len(x)) for _, x in ids)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert wavelet.token_files(empty, BYTE).count() == 0


def test_packing(spark, docs, empty):
    t, window = Tokenizer.from_file(WORD), 64
    got = local(packing.pack(docs, WORD, window=window))
    held = sorted((key(d["doc_id"]), tuple([*t.encode(d["text"] or "", add_special_tokens=False).ids, 2])) for d in local(docs))
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in held)
    pieces = sorted((key(d), s, zlib.crc32(np.array(x[s : s + window], "<u4").tobytes()), len(x)) for (_, d), x in (((k, k[1] if k[0] else None), x) for k, x in held) for s in range(0, len(x), window))
    assert pieces == sorted((key(r["doc_id"]), r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= window
    assert packing.pack(empty, WORD).count() == 0


def test_closest_multiset():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        counts = {int(x): int(c) for x, c in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5))}
        room, sums = int(rng.integers(1, 60)), {0}
        for x, c in counts.items():
            for _ in range(c):
                sums |= {s + x for s in sums}
        chosen = packing.closest(counts, room)
        assert sum(x * c for x, c in chosen.items()) == max(s for s in sums if s <= room) and all(c <= counts[x] for x, c in chosen.items())
    done = defaultdict(int)
    for repeats, p in packing.patterns({3: 5, 4: 2, 10: 1}, 10):
        for x, c in p.items():
            done[x] += repeats * c
    assert dict(done) == {3: 5, 4: 2, 10: 1}


def sets_of(rows):
    out = []
    for d in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or "")) if x]
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    return out


def components_of(ids, links):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_duplicate_documents(spark, docs, empty):
    more = [(1000 + i, " ".join([*prose(120, 40 + f).split(" ")[: 120 - 3 * k], *[f"tail{f}{k}"] * (k % 5)]), "en", "s", 0, 1) for f in range(4) for k, i in enumerate(range(f * 12, f * 12 + 12))]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    rows = local(docs)
    sets = sets_of(rows)
    known = [(d["doc_id"], s) for d, s in zip(rows, sets) if d["doc_id"] is not None]
    links = [(a, b) for i, (a, s) in enumerate(known) for b, t in known[i + 1 :] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    label = components_of({a for a, _ in known}, links)
    got = local(minhash.near_duplicates(docs))
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == label[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
    assert sorted(r["n_shingles"] for r in got) == sorted(map(len, sets))
    kept = local(minhash.keep_one(docs))
    assert sorted(d["doc_id"] for d in kept if d["doc_id"] is not None) == sorted({i for i, c in label.items() if i == c})
    assert minhash.near_duplicates(empty).count() == 0


def test_links_of_repeated_doc_ids(spark):
    """Two texts under one doc_id, each near another document; and documents that only a repeated doc_id joins."""
    rows = []
    for g in range(20):
        a, b = prose(60, 3000 + g).split(" "), prose(60, 4000 + g).split(" ")
        near = lambda w: " ".join([*w[:-2], "other", "end."])
        rows += [(3 * g, " ".join(a)), (3 * g, " ".join(b)), (3 * g + 1, near(b)), (3 * g + 2, near(a))]
    rows += [(900, "one two three four five six"), (901, "one two three four five six"), (901, "seven eight nine ten"), (902, "seven eight nine ten")]
    got = local(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, i // 3 * 3) for i in range(60)} | {(i, 900) for i in (900, 901, 902)}
    kept = local(minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as node", "'x' as set_print")))
    assert sorted(r["doc_id"] for r in kept) == [*range(0, 60, 3), 900]


def test_hot_keys_of_near_copies(spark, monkeypatch):
    """One large group of near copies, with bounds so low that its keys are salted and its shingles common."""
    monkeypatch.setattr(minhash, "HOT", 1)
    monkeypatch.setattr(minhash, "SALTS", 3)
    monkeypatch.setattr(minhash, "COMMON", 5000)
    words = prose(150, 77).split(" ")
    rows = [(i, " ".join([*words[: 150 - i % 9], f"tail{i % 40}"])) for i in range(150)] + [(500 + i, prose(80, 600 + i)) for i in range(20)]
    got = local(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, 0) for i in range(150)} | {(500 + i, 500 + i) for i in range(20)}


def test_registers():
    a = np.sort(RNG.integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2))
    for share in (0.5, 0.8):
        b = np.sort(np.concatenate((a[: int(2000 * share)], RNG.integers(0, 2**63, int(2000 * (1 - share))).astype(np.uint64))))
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert minhash.estimate(minhash.registers(a), minhash.registers(b)) == pytest.approx(truth, abs=0.1)
    assert len(minhash.registers(a[:1])) == minhash.REGISTERS


def removed(rows):
    out, order = {}, sorted({key(d["doc_id"]) for d in rows})
    seen: set[bytes] = set()
    for k in order:
        own = [(d["text"] or "").encode() for d in rows if key(d["doc_id"]) == k]
        for b in own:
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - 49):
                if b[i : i + 50] in seen:
                    gone[i : i + 50] = True
            out.setdefault(k, []).append((b, gone))
        seen |= {b[i : i + 50] for b in own for i in range(len(b) - 49)}
    return out


def test_suffix_arrays(spark, docs, empty, monkeypatch):
    passage = prose(30, 50)
    more = [(2000 + i, prose(15, 60 + i) + passage[i : 150 + i] + prose(5, 80 + i) + "z" * (40 + i), "en", "s", 0, 1) for i in range(20)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    truth = removed(local(docs))
    got = local(suffix.remove_repeats(docs, with_text=True, shard_bytes=2000))
    assert len(got) == docs.count()
    want = sorted((k, len(b), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for k, x in truth.items() for b, g in x)
    assert want == sorted((key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert suffix.remove_repeats(empty).count() == 0
    cut = suffix.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert sum(r["n_chars"] != len(r["text"] or "") for r in local(cut)) == 0


def test_cut_keeps_columns_of_every_type(spark):
    line = "a line that is long enough to be a repeat of fifty bytes or more"
    docs = spark.createDataFrame([(2, f"x {line}"), (1, f"{line} y"), (3, None)], "doc_id int, text string").selectExpr(
        "doc_id", "timestamp'2020-01-01 00:00:03.123456' as ts", "timestamp_ntz'2020-01-01 00:00:03.123456' as block", "map(1, doc_id, 2, null) as docs", "text",
        "array(named_struct('a', cast(doc_id as decimal(20, 3)), 'b', null)) as carried_0", "cast('ab' as binary) as data", "double('nan') as rest", "date'1500-01-01' as `a b`", "cast(null as string) as grp",
    )
    got, want = ({r["doc_id"]: r for r in local(x)} for x in (suffix.cut_repeats(docs), docs))
    assert suffix.cut_repeats(docs).schema.simpleString() == docs.schema.simpleString()
    assert [got[i]["text"] for i in (1, 2, 3)] == [f"{line} y", "x", ""] or [got[i]["text"] for i in (1, 2, 3)] == [f"{line} y", "x ", ""]
    for i in (1, 2, 3):
        for c in set(docs.columns) - {"text", "rest"}:
            assert got[i][c] == want[i][c], c


def test_log_index():
    windows = [RNG.integers(97, 99, 53).astype(np.uint8).tobytes() for _ in range(40)]
    index, all_keys, all_docs = suffix.LogIndex(160), [], []
    for batch in range(10):
        keys, n = suffix.windows(windows[batch * 4 : batch * 4 + 4])
        doc = RNG.integers(0, 6, len(keys))
        index.add(keys, doc, np.arange(len(keys)) + 16 * batch)
        all_keys += keys.tolist()
        all_docs += doc.tolist()
    least = {}
    for k, d in zip(all_keys, all_docs):
        least[k] = min(d, least.get(k, d))
    assert index.marked.tolist() == [d > least[k] for k, d in zip(all_keys, all_docs)]
    assert len(index.levels) <= 5


def test_log_index_of_windows_that_documents_repeat():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        pool = [(b"%02d" % i) * 25 for i in range(8)]
        index, keys, docs = suffix.LogIndex(120), [], []
        for batch in range(12):
            k, d = [pool[i] for i in rng.integers(0, 8, 10)], rng.integers(0, 30, 10) if batch % 2 else rng.permutation(30)[:5].repeat(2)
            index.add(np.array(k, f"S{suffix.LENGTH}"), d, np.arange(10) + 10 * batch)
            keys += k
            docs += d.tolist()
        assert index.marked.tolist() == [any(k == w and e < d for w, e in zip(keys, docs)) for k, d in zip(keys, docs)]


def test_repeats_inside_a_document_over_batches(monkeypatch):
    """A line that stands several times in a document between different neighbours, with each block a batch of its own."""
    monkeypatch.setattr(suffix, "BATCH", 1)
    line = "this line of some sixty bytes stands in all of the documents ok"
    rows = [{"doc_id": d, "text": " ".join(f"{prose(12, 1000 * d + k)} {line}" for k in range(3 if d % 2 else 2)) + prose(9, 500 + d)} for d in (9, 3, 7, 2, 8, 5, 1, 6)]
    blobs = []
    for number, part in enumerate((rows[:2], rows[2:3], rows[3:6], rows[6:])):
        held = [r["text"].encode() for r in part]
        ids = np.array([r["doc_id"] for r in part], "<i8")
        blobs.append(pd.DataFrame({"block": [number], "docs": [pack(ids, np.ones(len(ids), bool), b"\0" * (len(ids) - 1), np.cumsum([len(t) for t in held], dtype="<i8"), b"".join(held))]}))
    by = lambda f, c: [g for _, g in f.groupby(c)]
    asked = pd.concat(x for b in blobs for x in suffix._ask(2)(iter([b])))
    replies = pd.concat(suffix._answer(g) for g in by(asked, "shard"))
    block = lambda i: suffix.Block(blobs[i]["docs"][0])
    of = lambda f, i: f[f["block"] == i]
    sent = pd.DataFrame([r for i in range(len(blobs)) for r in suffix.send(i, block(i), dict(zip(of(replies, i)["shard"], of(replies, i)["data"])), 2)], columns=["block", "shard", "settled", "data"])
    spans = pd.concat(suffix._resolve(g) for g in by(sent, "shard"))
    got = pd.concat(suffix.finish(block(i), of(spans, i)["data"].tolist(), False).to_pandas() for i in range(len(blobs)))
    want = {k[1]: int(x[0][1].sum()) for k, x in removed(rows).items()}
    assert dict(zip(got["doc_id"], got["n_removed"])) == want and want[9] >= 3 * len(line)


def brute_kneser_ney(train):
    """probability(context of 4 bytes, byte) from counts as the estimate defines them, in dictionaries."""
    counts = {5: defaultdict(int)}
    for t in train:
        data = b"\0" * 4 + t.encode()
        for i in range(len(data) - 4):
            counts[5][data[i : i + 5]] += 1
    for m in (4, 3, 2, 1):
        counts[m] = defaultdict(int)
        for g in counts[m + 1]:
            counts[m][g[1:]] += 1
    tables = {}
    for m, of in counts.items():
        n = [sum(c == i for c in of.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [0] + [max(0, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[1] and i < 4 and i + 1 < 5 else 0.75 for i in (1, 2, 3)]
        total, left = defaultdict(int), defaultdict(float)
        for g, c in of.items():
            total[g[:-1]] += c
            left[g[:-1]] += min(c, d[min(c, 3)])
        tables[m] = of, total, left, d

    def probability(context, byte):
        p = 1 / 256
        for m in range(1, 6):
            of, total, left, d = tables[m]
            c = context[5 - m :]
            if c in total:
                n = of.get(c + byte, 0)
                p = (n - min(n, d[min(n, 3)])) / total[c] + max(left[c] / total[c], np.exp(-28)) * p
        return p

    return probability


def test_perplexity_is_kneser_ney(spark):
    """By a model of the trusted texts that aren't held out, as brute force has it."""
    train = [prose(40, 900 + i) for i in range(12)] + ["abab abc", "abba cab"]
    other = ["bca abc", prose(70, 940), "zzz \0 ééé 你好", "a", prose(3000, 941)]
    rows = [(i, t, "en", i % 2) for i, t in enumerate([*train, *other])] + [(100, None, "en", 7), (101, "", None, 7), (102, "no model", "fr", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, name int").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(train))], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in local(kneser.classify(docs, labels))}
    part = {r["doc_id"]: r["h"] for r in local(docs.selectExpr("doc_id", f"pmod(xxhash64(text), {kneser.HELD_OUT}) as h")) if r["doc_id"] < len(train)}
    assert 0 < sum(h == 0 for h in part.values()) < len(train)
    probability = brute_kneser_ney([t for i, t in enumerate(train) if part[i]])
    for i, t in enumerate([*train, *other]):
        data = b"\0" * 4 + t.encode()
        logs = [np.log(probability(data[j : j + 4], data[j + 4 : j + 5])) for j in range(len(data) - 4)]
        assert got[i]["perplexity"] == pytest.approx(np.exp(-np.mean(logs)), rel=2e-3)
    assert got[100]["perplexity"] is None and got[101]["perplexity"] is None and got[102]["perplexity"] == pytest.approx(256, rel=1e-3)


def test_quality(spark):
    good = [(i, prose(60, 100 + i), "en", 1) for i in range(40)]
    bad = [(100 + i, " ".join(w.upper() + "$$$" for w in prose(60, 200 + i).split(" ")), "en", 0) for i in range(20)]
    odd = [(300, None, "en", None), (301, "", None, None), (None, prose(20, 8), "en", None), (302, "XX$$$ YY$$$", "fr", None)]
    docs = spark.createDataFrame([*good, *bad, *odd, good[0]], "doc_id long, text string, lang string, quality int")
    labels = docs.where("quality is not null").selectExpr("doc_id", "quality", "0 as toxic")
    got = local(kneser.classify(docs.drop("quality"), labels))
    assert len(got) == docs.count()
    rejected = {r["doc_id"] for r in got if r["rejected"]}
    assert rejected <= set(range(100, 120)) and len(rejected) >= 18
    assert kneser.keep_good(docs, labels).count() == docs.count() - len(rejected)
    assert kneser.classify(docs.limit(0), labels).count() == 0
    assert not any(r["rejected"] for r in local(kneser.classify(docs, labels.limit(0))))


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    near = np.concatenate([base[:10] + 0.1 * rng.standard_normal((10, 8)) for _ in range(6)])
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(np.concatenate((base, near, base[:5])))]
    odd = [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] + [1.0] * 7, 1), (503, [float("inf")] + [1.0] * 7, 1), (504, [None] + [1.0] * 7, 1), (505, [1.0, 2.0], 1), (None, [1.0] * 8, 1), (506, [], 1), rows[3], (600, [1e200] * 8, 2), (601, [1e-200] * 8, 2)]
    return spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int").repartition(3).cache()


def usable(r):
    v = r["embedding"]
    return r["vec_id"] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_duplicate_vectors(spark, embeddings, monkeypatch):
    monkeypatch.setattr(embdedup, "CELL_ROWS", 15)
    monkeypatch.setattr(embdedup, "BLOCK", 8)
    monkeypatch.setattr(embdedup, "CHUNK", 3)
    embeddings = embeddings.selectExpr("*", "'x' as cell", "1 as home", "2 as ok", "3 as same", "4 as copies")
    rows = local(embeddings)
    unit = [np.array(r["embedding"]) / np.abs(r["embedding"]).max() if usable(r) else None for r in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    degree = defaultdict(int)
    for i, j in pairs:
        degree[i] += 1
        degree[j] += 1
    label = components_of({r["vec_id"] for r in rows}, [(rows[i]["vec_id"], rows[j]["vec_id"]) for i, j in pairs])
    got = local(embdedup.near_duplicates(embeddings))
    assert sorted((key(r["vec_id"]), r["n_links"], key(r["component_id"])) for r in got) == sorted((key(r["vec_id"]), degree[i], key(label[r["vec_id"]])) for i, r in enumerate(rows))
    assert embdedup.near_duplicates(embeddings.limit(0)).count() == 0


def test_links_of_a_repeated_vec_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (5, b), (6, [1.0, 0.1, 0.0]), (7, [0.0, 1.0, 0.1]), (8, [0.1, 1.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in local(embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))))
    assert got == [(5, 1, 5), (5, 2, 5), (6, 1, 5), (7, 2, 5), (8, 2, 5)]


def test_links_of_a_large_cell():
    """Chains round the threshold whose links lie in different chunks of a task."""
    rng = np.random.default_rng(5)
    n, chains = 1300, 200
    middle = rng.standard_normal((chains, 64))
    side = rng.standard_normal((chains, 64))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    side -= (side * middle).sum(1, keepdims=True) * middle
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    turn = np.radians(15) * np.arange(-3, 4)[:, None, None]
    x = rng.permutation((np.cos(turn) * middle + np.sin(turn) * side).reshape(-1, 64))[:n]
    ids, copies = rng.permutation(10 * n)[:n], rng.integers(1, 4, n)
    link = x @ x.T >= embdedup.COSINE
    np.fill_diagonal(link, False)
    want = components_of(ids.tolist(), [(int(ids[i]), int(ids[j])) for i, j in np.argwhere(np.triu(link))])
    none = np.zeros((n, 1), bool)
    for blocks in (1, 2):
        edges, degree = [], defaultdict(int)
        for i in range(blocks):
            for j in range(i, blocks):
                block = np.arange(n) * blocks // n
                part = lambda b: embdedup.Vectors([embdedup.Vectors.packed(ids[block == b], copies[block == b], np.zeros((block == b).sum()), none[block == b], x[block == b])], 1)
                out = embdedup.compare(0, part(i), None if i == j else part(j))
                assert out["vec_id"].is_unique
                edges += zip(out["vec_id"].tolist(), out["other"].tolist())
                for v, k in zip(out["vec_id"].tolist(), out["n"].tolist()):
                    degree[v] += k
        label = {v: v for v in want}
        while True:
            before = dict(label)
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                break
        assert label == want
        assert [degree[v] for v in ids.tolist()] == (link @ copies).tolist()


def test_nearest(spark, embeddings):
    rows = [r for r in local(embeddings) if usable(r) and len(r["embedding"]) == 8]
    got = defaultdict(list)
    for r in sorted(local(ann.nearest(embeddings, every=7, k=5)), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {r["vec_id"] for r in rows if r["vec_id"] % 7 == 0}
    hits = total = 0
    for q, found in got.items():
        x = np.array(next(r["embedding"] for r in rows if r["vec_id"] == q))
        with np.errstate(over="ignore"):
            truth = sorted((float(np.sqrt(((np.array(r["embedding"]) - x) ** 2).sum())), r["vec_id"]) for r in rows if r["vec_id"] != q)[:5]
        assert [s for _, s in found] == sorted(s for _, s in found)
        hits += len({v for v, _ in found} & {v for _, v in truth})
        total += 5
    assert hits / total >= 0.9
    assert ann.nearest(embeddings.limit(0)).count() == 0


def test_tasks_of_a_search_are_bounded(spark, monkeypatch):
    """Row blocks and query groups of a few rows: nothing is lost, and a repeated query asks its least vector."""
    monkeypatch.setattr(ann, "BLOCK", 60)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ann, "QUERY_GROUP", 2)
    x = RNG.standard_normal((400, 6)).round(3)
    rows = [(i // 2, v.tolist()) for i, v in enumerate(x)]
    got = local(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=4, k=3))
    for q in range(0, 200, 4):
        asked = np.array(min(v for i, v in rows if i == q))
        truth = sorted((float(np.sqrt(((np.array(v) - asked) ** 2).sum())), i) for i, v in rows if i != q)[:3]
        assert [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == truth


def search_of_block(x, ids, q, k=10):
    books = ann.fit(x, books=4, words=32)
    codes, length = ann.encode(x, books)
    rows = pd.DataFrame({"vec_id": ids, "embedding": list(x), "codes": [c.tobytes() for c in codes], "length": length})
    asked = -1 - np.arange(len(q))
    out = ann._search(books, k)((0,), rows, pd.DataFrame({"ids": [asked.astype("<i8").tobytes()], "vectors": [q.astype("<f8").tobytes()]}))
    return {i: set(g["vec_id"]) for i, g in out.groupby("query_id")}, asked


def test_copies_over_the_shortlist():
    """A third of a full block are copies: the smallest ids of the tie are found, whatever their places."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((ann.BLOCK, 16))
    x[rng.permutation(ann.BLOCK)[: ann.BLOCK // 3]] = x[0]
    ids = rng.permutation(10 * ann.BLOCK)[: ann.BLOCK]
    got, asked = search_of_block(x, ids, x[:1] + 1e-3)
    assert got[asked[0]] == set(np.sort(ids[(x == x[0]).all(1)])[:10])


def test_recall(spark):
    """Against brute force, over blocks of full size: vectors without structure, clusters, and close copies of one (a third)."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((9000, 32))
    x[:3000] = x[0] + 1e-3 * rng.standard_normal((3000, 32))
    x[3000:6000] = x[3000:3030].repeat(100, 0) + 0.3 * rng.standard_normal((3000, 32))
    x = rng.permutation(x)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(9000), "embedding": x.tolist()})).selectExpr("*", "1 as block", "'c' as codes", "2 as size", "3 as rank")
    got = ann.nearest(table).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        gap = x - x[q]
        exact = np.sqrt((gap * gap).sum(1))
        exact[q] = np.inf
        assert np.allclose(exact[g["vec_id"]], g["score"], rtol=1e-12) and sorted(g["rank"]) == list(range(1, 11))
        hits += len(set(np.argsort(exact)[:10].tolist()) & set(g["vec_id"].tolist()))
    assert len(got) == 900 and hits / 900 >= 0.9


def test_beam_search_is_no_worse_than_greedy():
    x = RNG.standard_normal((200, 8))
    books = ann.fit(x, books=3, words=16)
    errors = []
    for beam in (1, 8):
        codes, length = ann.encode(x, books, beam)
        sums = books[np.arange(3), codes].sum(1)
        assert length == pytest.approx((sums**2).sum(1))
        errors.append(((x - sums) ** 2).sum())
    assert errors[1] <= errors[0]


def test_licences(spark):
    rows = [
        (1, "a/b/LICENSE", "Released under the MIT License.\n\nsome more words\nand more"),
        (2, "a/b/c/x.py", "code\ncode"),
        (3, "a/y.py", "// Licensed under the Apache License, Version 2.0.\ncode\ncode"),
        (4, "a/z.py", None),
        (5, "COPYING", "All rights reserved."),
        (6, None, "words"),
        (7, "q.py", ""),
        (8, "a/b/d.py", "rights and the license of others"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in local(license.scan(docs.union(docs.limit(0))))}
    assert {i: r["license"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "Proprietary", 5: "Proprietary", 6: None, 7: "Proprietary", 8: "MIT"}
    assert got[2]["license_from"] == "a/b" and got[4]["license_from"] == "" and got[3]["license_from"] == "own"
    assert license.scan(docs.limit(0)).count() == 0


def test_licence_headers_and_files(spark):
    wrapped = lambda name, mark: "\n".join(mark + line.strip() for line in license.TEXTS[name].split("\n"))
    rows = [
        (1, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 Foo\n\n" + wrapped("MIT#file", "").removeprefix("MIT License. ")),
        (2, "a/x.py", "code\ncode"),
        (3, "b/y.py", wrapped("GPL-3.0#header", "# ") + "\n" + "\n".join(f"x{i} = {i}" for i in range(30))),
        (4, "b/z.py", wrapped("Apache-2.0#header", " * ") + "\ncode"),
        (5, "c/COPYING", "Mozilla Public License Version 2.0\n\n1. Definitions"),
        (6, "d/LICENSE", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n" + "terms and conditions of use\n" * 9),
        (7, "e/e.txt", "Copyright 2020 Foo Bar. All rights reserved."),
        (8, "f/g.txt", "words and the like\nof the person"),
        (9, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in local(license.scan(docs))}
    assert got == {1: "MIT", 2: "MIT", 3: "GPL-3.0", 4: "Apache-2.0", 5: "MPL-2.0", 6: "Apache-2.0", 7: "Proprietary", 8: None, 9: None}


def test_licences_that_are_alike(spark):
    """Each text names its own licence; prose and unknown neighbours name none, or none that they aren't."""
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    told = {
        gpl.format("Affero General", "3"): "AGPL-3.0", gpl.format("Lesser General", "2.1").replace("program", "library"): "LGPL-2.1", gpl.format("General", "2"): "GPL-2.0", gpl.format("General", "3"): "GPL-3.0",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
        "Licensed under the Eclipse Public License, Version 2.0.": "EPL-2.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "The rights of all people are reserved.": None, "All of these rights were reserved by the people of the town.": None,
    }
    told |= {text: name.split("#")[0] for name, text in license.TEXTS.items()}
    docs = spark.createDataFrame([(i, f"d{i}/a.txt", text) for i, text in enumerate(told)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["own_license"] for r in local(license.scan(docs))}
    for i, (text, name) in enumerate(told.items()):
        assert got[i] == name, text


def test_licences_of_awkward_files(spark, monkeypatch):
    """Repeated rows, clashing columns, a tie of two licences in a directory, a very long file, many directories."""
    apache, mit = license.TEXTS["Apache-2.0"], license.TEXTS["MIT"]
    rows = [(1, "x/a", apache, "t"), (1, "x/a", apache, "t"), (2, "x/b", mit, None), (3, "x/y/z", "code", "own"), (None, "x/y/z", None, ""), (4, "w/long", " \n".join(prose(300, i) for i in range(40)) + "\n\n" + mit, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string, terms string").selectExpr("*", "1 as dir", "'q' as units", "0 as salt")
    want = [(None, "Apache-2.0", "x"), (1, "Apache-2.0", "own"), (1, "Apache-2.0", "own"), (2, "MIT", "own"), (3, "Apache-2.0", "x"), (4, "MIT", "own")]
    for most in (license.DIRECTORIES, 0):
        monkeypatch.setattr(license, "DIRECTORIES", most)
        got = license.scan(docs)
        assert got.columns == ["doc_id", "path", "own_license", "own_score", "license", "license_from"]
        assert sorted(((r["doc_id"], r["license"], r["license_from"]) for r in local(got)), key=lambda r: key(r[0])) == want


def test_rollup(spark, docs, tmp_path):
    t = Tokenizer.from_file(BYTE)
    counted = tokencounts.counts(docs, {"v1": (BYTE, True)})
    rollup = tokencounts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    assert rollup.commit("a", tokencounts.inserts(counted)) and not rollup.commit("a", tokencounts.inserts(counted))
    want = defaultdict(lambda: [0, 0])
    for d in local(docs):
        want[d["source"], d["lang"]][0] += 1
        want[d["source"], d["lang"]][1] += len(t.encode(d["text"] or "", add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in local(rollup.totals())}
    assert got == dict(want)
    some = counted.where("source = 'src0'")
    rollup.commit("b", tokencounts.revisions(some, some.selectExpr("doc_id", "source", "lang", "'v2' as tokenizer_version", "n_tokens + 1 as n_tokens", "n_bytes")))
    rollup.commit("c", tokencounts.deletes(counted.where("source is null")))
    after = local(rollup.totals())
    assert {r["tokenizer_version"] for r in after if r["source"] == "src0"} == {"v2"} and not [r for r in after if r["source"] is None]
    with pytest.raises(ValueError):
        rollup.commit("x/y", some)
    assert rollup.fold() == 3 and rollup.fold() == 0 and not rollup.commit("a", tokencounts.inserts(counted))
    assert sorted(map(str, local(rollup.totals()))) == sorted(map(str, after))
    rollup.commit("d", tokencounts.deletes(counted.where("source = 's'")))
    assert rollup.fold() == 1 and len(rollup._names()) == 2
    assert {r["source"] for r in local(rollup.totals())} == {r["source"] for r in after} - {"s"}


def test_rollup_of_whole_tables(spark, sf):
    """The query's deltas, out of order, folded and replayed, against a recount with the library."""
    from permeon.llm.queries import op2_token_rollup

    documents, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    toxic, bad = set(labels["doc_id"][labels["toxic"] == 1]), set(labels["doc_id"][labels["quality"] == 0])
    want = defaultdict(lambda: np.zeros(3, int))
    for version, path in (("byte_bpe_50k", BYTE), ("word_bpe_49k", WORD)):
        t = Tokenizer.from_file(path)
        for d in documents.itertuples():
            if d.doc_id not in toxic:
                text = d.text or ""
                want["quarantine" if d.doc_id in bad else d.source, d.lang, version] += (1, len(t.encode(text, add_special_tokens=False).ids), len(text.encode()))
    got = local(op2_token_rollup(spark, sf))
    assert toxic and bad - toxic
    assert {(r["source"], r["lang"], r["tokenizer_version"]): [r["n_docs"], r["n_tokens"], r["n_bytes"]] for r in got} == {k: v.tolist() for k, v in want.items()}
