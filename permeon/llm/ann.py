"""Operator 6: nearest neighbours by additive quantisation.

A vector is coded as a sum of one codeword from each of BOOKS full-dimensional codebooks. Codebooks are fitted on at most
SAMPLE vectors: residual k-means gives a start, least squares over all codewords together refines it. Every row is encoded by
beam search over the codebooks and indexed with its codes and the squared length of its sum.

Search: |q - x|^2 is |q|^2 - 2 * (sum of q's table entries at x's codes) + the stored length. Rows lie in blocks of about BLOCK;
each block meets the queries in groups of QUERY_GROUP blocks (some 8,000 queries), so a task's share of them is bounded too. It computes exact distances on the original vectors for the SHORTLIST rows that the
tables put nearest, and learns from these by how much the tables err; then also for all rows that, by DEVIATIONS times that
error, may be nearer than the k-th found (in a group of close copies that is the group). It returns its nearest k of each query; a
grouped limit takes the nearest k of all. Nothing of the table is broadcast but the codebooks. SHORTLIST and BLOCK are the same at every size.

Queries are rows whose vec_id is divisible by `every`; a query's own row is no candidate. Null, zero or non-finite vectors
and null vec_ids take no part, nor do vectors of another length than most of the sample. Ties go to the smaller vec_id. Repeated
vec_ids: each row is a candidate of its own, and of a repeated query the least vector is asked. Fewer candidates than k: all of them. Empty table: no
rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._session import prepare, schema, shuffle_partitions, written
from ._vectors import matrix, sample, vectors

BOOKS, WORDS, BEAM, SAMPLE = 8, 256, 4, 20_000
BLOCK, QUERY_BLOCK, SHORTLIST, DEVIATIONS = 4_096, 512, 128, 3
#: Blocks of queries that a task gets, about.
QUERY_GROUP = 16


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        own = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(own, minlength=len(centres))[:, None]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres, ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """Codebooks (books, words, dimensions). Vectors a thousand times longer than usual don't count."""
    length = np.abs(x).max(1)
    x = x[length <= 1000 * np.median(length)]
    rng, rest, out, codes = np.random.default_rng(seed), x.copy(), [], []
    k = max(1, min(words, len(x)))
    for _ in range(books):
        book, own = kmeans(rest, k, rng)
        out.append(book)
        codes.append(own)
        rest = rest - book[own]
    c = np.stack(out)
    # all codewords together, by least squares with a small ridge towards the start
    at = np.stack(codes, 1) + np.arange(books) * k
    gram = np.zeros((books * k, books * k))
    for a in range(books):
        for b in range(books):
            np.add.at(gram, (at[:, a], at[:, b]), 1.0)
    target = np.zeros((books * k, x.shape[1]))
    for a in range(books):
        np.add.at(target, at[:, a], x)
    start = c.reshape(books * k, -1)
    return np.linalg.solve(gram + np.eye(books * k), target + start).reshape(c.shape)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes by beam search, and the squared length of each sum of codewords."""
    n, (m, k, d) = len(x), books.shape
    rest, loss = x[:, None, :], np.zeros((n, 1))
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        score = (book * book).sum(1) - 2 * rest @ book.T  # how much a codeword changes the squared residual
        total = (loss[:, :, None] + score).reshape(n, -1)
        width = min(beam, total.shape[1])
        best = np.argpartition(total, width - 1, axis=1)[:, :width] if width < total.shape[1] else np.tile(np.arange(width), (n, 1))
        came, word = best // k, best % k
        rows = np.arange(n)[:, None]
        rest = rest[rows, came] - book[word]
        loss = total[rows, best]
        codes = np.concatenate((codes[rows, came], word[:, :, None].astype(np.uint8)), 2)
    best = loss.argmin(1)
    codes, rest = codes[np.arange(n), best], rest[np.arange(n), best]
    sums = x - rest
    return codes, (sums * sums).sum(1)


def _index(books: np.ndarray):
    def run(frames):
        for f in frames:
            f = f[f["embedding"].map(len) == books.shape[2]]
            out = []
            for lo in range(0, len(f), 1024):
                part = f.iloc[lo : lo + 1024]
                with np.errstate(over="ignore", invalid="ignore"):
                    codes, length = encode(matrix(part["embedding"]), books)
                out.append(part.assign(codes=[c.tobytes() for c in codes], length=length))
            yield pd.concat(out) if out else f.assign(codes=pd.Series([], dtype=object), length=pd.Series([], dtype=float))

    return run


def _search(books: np.ndarray, k: int):
    m = len(books)

    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(over="ignore", invalid="ignore"):
            return search(rows, queries)

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            x = matrix(rows["embedding"])
            codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(-1, m)
            length, ids = rows["length"].to_numpy(), rows["vec_id"].to_numpy()
            for blob_ids, blob in zip(queries["ids"], queries["vectors"]):
                asked, q = np.frombuffer(blob_ids, "<i8"), np.frombuffer(blob, "<f8").reshape(-1, x.shape[1])
                tables = np.einsum("qd,mkd->qmk", q, books)
                short = min(len(x), SHORTLIST)
                for i, query in enumerate(asked.tolist()):
                    near = length - 2 * tables[i][np.arange(m), codes].sum(1)
                    own = ids == query
                    near[own] = np.inf
                    pick = np.argpartition(near, short - 1)[:short] if short < len(x) else np.arange(len(x))
                    cut, first = near[pick].max(), pick[np.isfinite(near[pick])]
                    if len(first) > k:
                        gap = x[first] - q[i]
                        exact = (gap * gap).sum(1)
                        error = exact - near[first]
                        cut = max(cut, np.partition(exact, k - 1)[k - 1] - np.median(error) + DEVIATIONS * error.std())
                    # with all that the tables put as near as the last of them, such as copies
                    pick = np.union1d(pick, np.flatnonzero(near <= cut + 1e-9 * np.abs(cut)))
                    # what overflows in the tables is always looked at exactly
                    pick = np.union1d(pick, np.flatnonzero(~np.isfinite(near)))
                    pick = pick[~own[pick]]
                    gap = x[pick] - q[i]
                    exact = np.sqrt((gap * gap).sum(1))
                    best = np.lexsort((ids[pick], exact))[:k]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[pick][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype=float)})

    return run


def _query_blocks(size: int):
    def run(frames):
        for f in frames:
            f = f[f["embedding"].map(len) == size]
            for lo in range(0, len(f), QUERY_BLOCK):
                part = f.iloc[lo : lo + QUERY_BLOCK]
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy("<i8").tobytes()], "vectors": [matrix(part["embedding"]).astype("<f8").tobytes()]})

    return run


def _each(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    spark = embeddings.sparkSession
    prepare(spark)
    rows = vectors(embeddings).where("ok").select("vec_id", "embedding")
    known = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = known["size"] if known else 0
    if not size:
        return spark.createDataFrame([], schema("query_id bigint, rank int, vec_id bigint, score double"))
    books = fit(sample(rows.where(F.size("embedding") == size), SAMPLE))  # a bounded sample; every row is indexed
    index = written(rows.mapInPandas(_index(books), schema("vec_id bigint, embedding array<double>, codes binary, length double")).withColumn("row", F.monotonically_increasing_id()), "codes")
    count = max(1, -(-index.count() // BLOCK))
    index = index.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")).drop("row")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = written(queries.coalesce(max(1, shuffle_partitions(spark) // 16)).mapInPandas(_query_blocks(size), schema("ids binary, vectors binary")).withColumn("row", F.monotonically_increasing_id()), "queries")
    # a task has one block of rows and QUERY_GROUP blocks of queries at most
    groups = max(1, -(-queries.count() // QUERY_GROUP))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).drop("row")
    index, queries = index.withColumn("part", _each(groups)), queries.withColumn("block", _each(count))
    found = index.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(_search(books, k), schema("query_id bigint, vec_id bigint, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
