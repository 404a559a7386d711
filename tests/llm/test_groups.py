"""Shards, spelling variants and source divergence against brute force, on small tables with every awkward case."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from permeon.llm import divergence, sharding, spelling
from permeon.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, row int, shard string, known int, digest int, bucket int, id int, key int, range int, term string, size int"
RNG = np.random.default_rng(5)
STEMS = ["".join(RNG.choice(list("abcdéÿ×"), 9)) for _ in range(60)]


def variant(word, rng):
    at, kind = int(rng.integers(len(word))), rng.integers(4)
    return [word, word[:at] + word[at + 1 :], word[:at] + "q" + word[at:], word[:at] + "Z" + word[at + 1 :]][kind]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(variant(STEMS[int(rng.integers(60) ** 2 / 60)], rng) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " ", "\n", "é", "a1B2c", "x" * 30_000, "x" * 29_999 + " " + "x" * 30_000, "İstanbul ŒUVRES ünïcodeß 你好 🙂🙂 Straße_straßen", "aaaaaaaa aaaaaaa aaaaaaaab", "nul\0bytes{nul}bytes\x7fnul"]
    texts += [prose(300, i) for i in range(40)] + [prose(20, 99)] * 30 + [prose(4000, 7)]
    rows = [(i * 7 % 1000, t, ["en", "de", None, "fr"][i % 4 if i % 9 else 0], [f"s{i % 5}", None, "", "é", "z"][i % 5]) for i, t in enumerate(texts)]
    rows += [(None, prose(50, 8), "en", "s"), rows[20], rows[20], (5000, "only this", "xx", "one"), (5001, "alone", "xx", "two")]
    extra = (3, "w", 1, "s", 1, 2, 3, 4, 5, 6, "t", 7)
    return spark.createDataFrame([r + extra for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def held(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def sql(held):
    con = duckdb.connect()
    ids, texts, langs, sources = zip(*held)
    rows = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": langs, "source": sources})  # noqa: F841
    con.execute("create table documents as select * from rows")
    return lambda name: [dict(zip(r.keys(), r.values())) for r in con.sql(ORACLE_SQL[name]).to_arrow_table().to_pylist()]


def local(df):
    return [r.asDict() for r in df.collect()]


def test_longest_first_is_greedy():
    weights = np.array([9, 7, 6, 5, 5, 4, 4, 2, 2, 1])
    of, loads = sharding.longest_first(weights, 3)
    left = [0, 0, 0]
    for w, b in zip(weights.tolist(), of.tolist()):
        assert left[b] == min(left)
        left[b] += w
    assert left == loads and sum(loads) == weights.sum()


@pytest.mark.parametrize("seed", range(4))
def test_bundles_level_large_groups(seed):
    rng = np.random.default_rng(seed)
    weights = np.sort(rng.pareto(1.1, 20_000) * 1000 + 16).astype(np.int64)[::-1]
    weights[0] = weights[1:].sum() // 2  # a third of all
    of = sharding.bundle(weights, 40)
    loads = np.bincount(of, weights).astype(np.int64)
    loads = np.sort(loads[loads > 0])[::-1]
    _, shards = sharding.longest_first(loads, 40)
    _, best = sharding.longest_first(weights, 40)
    others, best = np.sort(shards)[:-1], np.sort(best)[:-1]  # the largest group fills one
    assert max(shards) == weights[0] and others.max() <= max(best.max(), best.mean() * 1.002)


@pytest.mark.parametrize("shards", [1, 7, 40, 200])
def test_shards(spark, docs, held, shards):
    got = local(sharding.assign(docs, shards))
    text = lambda t: (t or "").encode()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((d or -1, len(text(t)) + 16, zlib.crc32(text(t))) for d, t, *_ in held)
    slots, of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(s) == 1 for s in of.values())
    groups, loads = Counter(), Counter({s: 0 for s in range(shards)})
    for r in got:
        groups[r["text_crc32"]] += r["size"]
        loads[r["shard"]] += r["size"]
    # the bound of longest processing time: 4/3 of the best, which is the mean or the largest group at least
    assert max(loads.values()) <= 4 / 3 * max(sum(groups.values()) / shards, max(groups.values()))


def test_shards_by_a_column_and_files(spark, docs, held, tmp_path):
    got = local(sharding.assign(docs, 5, group="source").join(docs.select("doc_id", "source").distinct(), "doc_id"))
    of = defaultdict(set)
    for r in got:
        of[r["source"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values()) and None in of and "" in of
    folder = sharding.write_shards(docs, str(tmp_path / "shards"), 6)
    files = local(spark.read.parquet(folder))
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["source"] or "") for r in files) == sorted((d or -1, t or "", s or "") for d, t, _, s in held)
    texts = defaultdict(set)
    for r in files:
        texts[r["text"] or ""].add(r["shard"])
    assert all(len(s) == 1 for s in texts.values())


def brute_words(held):
    counts = Counter()
    for d, t, *_ in held:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def test_variants(docs, held, sql):
    words = brute_words(held)
    got = {r["word"]: r for r in local(spelling.variants(docs))}
    assert set(got) == set(words) and any(r["form"] for r in got.values()) and max(map(len, words)) > 29_000
    form = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        r = got[w]
        assert (r["n"], r["n_near"], r["form"], r["form_n"]) == (n, len(others), form[w], words.get(form[w])), w
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        assert got[w]["root"] == root
    short = [r for r in sql("op12_deletion_keys")]
    assert sorted(map(str, short)) == sorted(str({k: got[r["word"]][k] for k in r}) for r in short) and len(short) == len(got)


def test_roots_of_long_chains(spark):
    chain = ["abcdefghij" + "z" * i for i in range(5)]
    rows = [(i, " ".join([w] * (2 * 11**i))) for i, w in enumerate(chain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r for r in local(spelling.variants(docs))}
    for w, r in got.items():
        root = w
        while got[root]["form"]:
            root = got[root]["form"]
        assert r["root"] == root
    assert len({got[w]["form"] for w in got}) >= 4 and len({r["root"] for r in got.values()}) == 1


def test_hash_collisions_are_judged_by_strings():
    rows = pa.table({"run": [2, 2, 2, -1, -1], "lost": [2, 2, 2, -1, 3], "word": ["abxdefgh", "abydefgh", "zzxzzzzz", "qqqqqqq", "other to"], "id": [1, 2, 3, 4, 5], "n": [5, 50, 9, 1, 1]})
    assert sorted(map(str, spelling.neighbours(rows).to_pylist())) == sorted(map(str, [{"id": 1, "near": 1, "best_n": 50, "best": "abydefgh"}, {"id": 2, "near": 1, "best_n": 5, "best": "abxdefgh"}]))


@pytest.mark.parametrize("burst", [2, 2048])
def test_trie(burst, monkeypatch):
    monkeypatch.setattr(divergence, "BURST", burst)
    words = sorted({bytes(RNG.choice(list(b"ab\xc3\xa9"), RNG.integers(1, 9))) for _ in range(500)} | {b"z" * 40 + bytes([i]) for i in range(9)})
    trie, seen = divergence.Trie(), {}
    for w in RNG.permutation(np.array(words, object)):
        seen[w] = trie.leaf(w)
    assert all(trie.leaf(w) == n for w, n in seen.items()) and trie.size == len(words)
    assert list(trie.walk()) == [(w, seen[w]) for w in words]


def test_shares_are_exact():
    for count, total, kept in [(0, 0, 1), (10**12, 10**15, 10**7), (7, 9, 3), (2**50, 2**52, 5), (4, 4, 1)]:
        assert divergence.share(count, total, kept) == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def test_pairs_in_pieces(monkeypatch):
    of = np.repeat(np.arange(30), 4)
    source = np.concatenate([np.sort(RNG.permutation(9)[:4]) for _ in range(30)])
    p, p0 = RNG.integers(100, 9_000, 120), RNG.integers(1, 99, 9)
    dense = np.tile(p0, (30, 1))
    dense[of, source] = p
    want = np.array([[0 if a == b else (divergence.gap(dense[:, a], dense[:, b]) - divergence.gap(p0[a], p0[b])).sum() for b in range(9)] for a in range(9)])
    for cells in (7, 1 << 20):
        monkeypatch.setattr(divergence, "CELLS", cells)
        assert np.array_equal(divergence.pair_sums(of, source, p, p0), want)


@pytest.mark.parametrize("bounds", [{}, {"LEAVES": 20, "RANGE_LEAVES": 30}])
def test_audit(docs, sql, bounds, monkeypatch):
    for name, value in bounds.items():
        monkeypatch.setattr(divergence, name, value)
    got = local(divergence.audit(docs))
    assert sorted(map(str, (sorted(r.items()) for r in got))) == sorted(map(str, (sorted(r.items()) for r in sql("op13_radix_tries"))))
    assert {r["part"] for r in got} == {"pair", "term"} and {r["value"] for r in got if r["lang"] == "xx"} == {0}


def test_audit_by_brute_force(docs, held):
    texts = defaultdict(list)
    for _, t, lang, source in held:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        texts[lang or ""].append((source or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered))))
    want = []
    for lang, rows in texts.items():
        kept = [t for t, n in Counter(t for _, c in rows for t in c).items() if n >= 10]
        of = defaultdict(Counter)
        for s, c in rows:
            of[s].update({t: c[t] for t in kept})
            of[None].update({t: c[t] for t in kept})
        share = lambda s: {t: 1 + 10**9 * (of[s][t] + 2) // (sum(of[s].values()) + 2 * len(kept)) for t in kept}
        p = {s: share(s) for s in of}
        gap = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])
        for s in of.keys() - {None}:
            pairs = sorted((-sum(gap(s, o, t) for t in kept), o.encode(), o) for o in of.keys() - {None, s})
            terms = sorted((-gap(s, None, t), t.encode(), t) for t in kept if of[s][t] and p[s][t] > p[None][t])[:10]
            want += [(lang, s, part, item, -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(found)]
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in local(divergence.audit(docs))]
    assert sorted(got) == sorted(want)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert sharding.assign(none).count() == spelling.variants(none).count() == divergence.audit(none).count() == 0
    nothing = docs.where("text is null or text = ''")
    assert sharding.assign(nothing).count() == nothing.count() and spelling.variants(nothing).count() == 0
