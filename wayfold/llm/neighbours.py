"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors less their mean, turned by learned rotations (alternating sign assignment and orthogonal Procrustes on a bounded
sample), one bit per coordinate's sign, ``BITS`` in all. A shard of rows keeps one table per substring of 16 bits, over its
different codes. Probing goes by levels: with r flips in every table, the pigeonhole principle finds every code within
m * (r + 1) - 1 bits, m the number of substrings. Levels end when ``SHARE`` of the shard's codes (``CANDIDATES`` at least) lie within
that radius; the least radius that holds so many is the one retrieved, whole, and its rows are reranked by inner product on
the original vectors in double precision. Codes are never scanned: only what the tables return is looked at.

Rows are dealt to shards of about ``SHARD_ROWS`` and queries to blocks of about ``BLOCK_QUERIES``; each block meets each shard,
and only the best k of a query leave a shard.

Defined results: vectors that are null, zero, of another length than the commonest, or hold null or non-finite components
take no part; a query never finds rows of its own vec_id; of rows that share a vec_id the one with the least vector asks, and each can
be found; ties go to the smaller vec_id; fewer than k candidates give them all; null vec_ids take no part; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize

SAMPLE_ROWS, ROUNDS, SEED = 10_000, 25, 5
BITS, SUBSTRING = 128, 16
SHARD_ROWS, BLOCK_QUERIES, CANDIDATES, SHARE = 16_384, 16_384, 400, 0.08


def learn_rotations(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and a (d, BITS) matrix: orthogonal matrices side by side, as many as give that many bits."""
    rng = np.random.default_rng(SEED)
    mean = sample.mean(axis=0)
    x, d = sample - mean, sample.shape[1]
    found = []
    for _ in range(-(-BITS // d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = vt.T @ u.T
        found.append(r)
    return mean, np.hstack(found)[:, :BITS]


def binary_codes(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, words) uint64."""
    mean, r = model
    return np.packbits((vectors - mean) @ r >= 0, axis=1).view(np.uint64)


class MultiIndex:
    """One table per 16-bit substring over the different codes of a shard."""

    flips = [np.array([v for v in range(1 << SUBSTRING) if v.bit_count() == n], np.int64) for n in range(SUBSTRING + 1)]

    def __init__(self, codes: np.ndarray):
        order = np.lexsort(codes.T)
        new = np.r_[True, np.any(codes[order[1:]] != codes[order[:-1]], axis=1)][: len(codes)]
        self.codes, self.members = codes[order][new], order  # rows of a code: members[first : first of the next]
        self.first = np.r_[np.flatnonzero(new), len(codes)]
        self.n, parts = len(self.codes), self.codes.view(np.uint16)
        self.m = parts.shape[1]
        self.rows = np.argsort(parts, axis=0, kind="stable").T.astype(np.int32).copy()
        self.probed = self.visited = self.asked = 0  # values, codes that they found, queries
        # the tables end to end: entry j * 65536 + value has the rows from its start up to the next entry's
        self.base = np.arange(self.m) << SUBSTRING
        sizes = np.bincount((parts + self.base).ravel(), minlength=self.m << SUBSTRING)
        self.held, self.starts = sizes > 0, np.r_[0, np.cumsum(sizes)].astype(np.int32)
        self.rows, self.words = self.rows.ravel(), self.codes.T.copy()

    def _found(self, entries: np.ndarray) -> np.ndarray:
        """Codes that the tables have at ``entries``, once for each table that has them."""
        entries = entries[np.flatnonzero(self.held.take(entries))]  # most have no code: a small table tells them
        a = self.starts[entries].astype(np.int64)
        counts = self.starts[entries + 1] - a
        return self.rows[np.repeat(a - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]

    def within(self, code: np.ndarray, want: int) -> np.ndarray:
        """All rows within the smallest radius that holds at least ``want`` codes (or all)."""
        own = (code.view(np.uint16) + self.base)[:, None]  # flips stay within an entry's 16 low bits
        marked = np.zeros(self.n, bool)
        want, bits, rows, distance = min(want, self.n), 64 * self.codes.shape[1], [], []
        held = np.zeros(bits + 1, np.int64)  # codes found, by distance
        self.asked += 1
        for r, masks in enumerate(self.flips):
            new = np.zeros(self.n, bool)
            new[self._found((own ^ masks).ravel())] = True
            self.probed += self.m * len(masks)
            found = np.flatnonzero(new & ~marked)
            marked[found] = True
            rows.append(found)
            distance.append(sum(np.bitwise_count(w[found] ^ c).astype(np.int16) for w, c in zip(self.words, code)))
            held += np.bincount(distance[-1], minlength=bits + 1)
            if held[: self.m * (r + 1)].sum() >= want:
                break
        radius = int(np.searchsorted(np.cumsum(held), want))
        rows, distance = np.concatenate(rows), np.concatenate(distance)
        self.visited += len(rows)
        near = rows[distance <= radius]
        size = self.first[near + 1] - self.first[near]
        return self.members[np.repeat(self.first[near] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _matrix(table: pa.Table, dtype) -> np.ndarray:
    flat = table.column("embedding").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).astype(dtype)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_shard(queries: pa.Table, rows: pa.Table, model, k: int, candidates: int, share: float = SHARE) -> pa.Table:
    """The best k of the shard for each query of the block."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not len(queries) or not len(rows):
        return schema.empty_table()
    ids, vectors = rows.column("vec_id").to_numpy(), _matrix(rows, np.float64)
    index = MultiIndex(binary_codes(vectors, model))
    asked, points = queries.column("vec_id").to_numpy(), _matrix(queries, np.float64)
    want = max(candidates, int(share * index.n)) + 1
    out = []
    for q, point, code in zip(asked, points, binary_codes(points, model)):
        near = index.within(code, want)
        near = near[ids[near] != q]
        scores = vectors[near] @ point
        best = _best(ids[near], scores, k)
        out.append((np.full(len(best), q), ids[near][best], scores[best]))
    return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that take part."""
    v = rows.select(rows["vec_id"], rows["embedding"].cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(~odd & F.exists("embedding", lambda x: x != 0))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of ``rows`` that is a query."""
    spark = rows.sparkSession
    valid = usable(rows)
    lengths = valid.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], empty)
    valid = materialize(valid.where(F.size("embedding") == lengths["d"]), "ann-vectors")
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").toPandas()["embedding"]
    model = learn_rotations(np.stack(sample.to_numpy()).astype(np.float64))
    shared = spark.sparkContext.broadcast(model)  # d x BITS numbers
    queries = valid.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards = max(1, -(-lengths["n"] // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(queries, "block", blocks, "shard", shards).groupBy("shard", "block")
    right = dealt(valid, "shard", shards, "block", blocks).groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(lambda q, r: search_shard(q, r, shared.value, k, candidates), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # limited to k before and after its shuffle
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
