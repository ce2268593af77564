"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, asymmetric distances, exact cosines.

1. A bounded sample gives the coarse centroids (about the square root of the number of rows, ``MAX_LISTS`` at most), the codebooks of
   ``SUBSPACES`` parts of the residuals, and the probe margin; every row goes to its nearest list.
2. Rows of a list that lie within a quarter of the threshold's angle of a leader form a ball: they link with each other by the triangle
   inequality, so a group of copies becomes one ball and its pairs are never formed. A list is worked on in chunks of ``CHUNK`` rows;
   balls of lists with more than ``RESIDENTS`` merge again while that helps.
3. Leaders visit, as codes, each list whose centroid is nearly as near as their own. There the residents' table lookups
   estimate the cosine; the code's stored error bounds it from above, so no pair of a probed list is lost.
4. Exact angles of leaders decide pairs of balls: all rows link, none, or the rows are compared in tiles, which give counts.

A pair is missed only if neither side visits the other's list. The margin is the least that finds ``COVERAGE`` of sampled rows
turned by exactly the threshold's angle in random directions; nearer pairs are found more often.

Defined results: vectors that are null, zero, of another length than the commonest, or hold null or non-finite components link with
nothing, and so do rows without vec_id (component_id null, kept false); each row is a vector of its own, so rows that share a
vec_id link like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from math import acos, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, sized_broadcast
from wayfold.llm.components import components

THRESHOLD = 0.9
SAMPLE_ROWS, MAX_LISTS, ROUNDS, SEED = 32_768, 4_096, 12, 11
SUBSPACES, WORDS, COVERAGE = 16, 256, 0.998
CHUNK, RESIDENTS, VISITORS = 256, 2_048, 8_192
#: Radians allowed for rounding where angles decide without comparing vectors.
SLACK = 1e-6


def _matrix(column) -> np.ndarray:
    """Unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow below
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _k_means(x: np.ndarray, k: int, rng, sphere: bool = False) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)] if len(x) > k else x
    for _ in range(ROUNDS if len(x) > k else 0):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        if sphere:
            centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(part @ centres.T - half, axis=1) for part in np.array_split(x, len(x) // 4096 + 1)])


class Quantiser:
    """Coarse centroids, codebooks and the probe margin, learned from a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float):
        rng = np.random.default_rng(SEED)
        self.dim = sample.shape[1]
        self.centres = _k_means(sample, lists, rng, sphere=True)
        self.parts = min(SUBSPACES, self.dim)
        rest = self._split(sample - self.centres[self.home(sample)])
        self.books = [_k_means(rest[:, m], WORDS, rng) for m in range(self.parts)]
        turned = rng.normal(size=sample.shape)
        turned -= (turned * sample).sum(axis=1, keepdims=True) * sample
        turned = threshold * sample + np.sqrt(1 - threshold**2) * turned / np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-12)
        a, b = sample @ self.centres.T, turned @ self.centres.T
        i, own, other = np.arange(len(sample)), a.argmax(axis=1), b.argmax(axis=1)
        self.margin = float(np.quantile(np.minimum(a[i, own] - a[i, other], b[i, other] - b[i, own]), COVERAGE)) + 1e-9

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centres.T, axis=1)

    def _split(self, rest: np.ndarray) -> np.ndarray:
        width = -(-self.dim // self.parts)
        return np.pad(rest, ((0, 0), (0, width * self.parts - self.dim))).reshape(len(rest), self.parts, width)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they leave out."""
        rest = self._split(x - self.centres[home])
        codes = np.stack([_nearest(rest[:, m], book) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)
        left = sum(((rest[:, m] - book[codes[:, m]]) ** 2).sum(axis=1) for m, book in enumerate(self.books))
        return codes, np.sqrt(left)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part, the inner products of the queries with its code words."""
        parts = self._split(q)
        return [(parts[:, m] @ book.T).astype(np.float32) for m, book in enumerate(self.books)]


def gather(x: np.ndarray, radii: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's leader, and by row the radius of the ball that it leads: the angle to its farthest member plus that one's own radius, ``limit`` at most."""
    leader, radius = np.full(len(x), -1), np.zeros(len(x))
    free = np.arange(len(x))
    while len(free):
        i = free[0]
        reach = np.arccos(np.clip(x[free] @ x[i], -1, 1)) + radii[free]
        reach[0] = radii[i]
        own = (reach <= limit) | (free == i)
        leader[free[own]], radius[i] = i, reach[own].max()
        free = free[~own]
    return leader, radius


def _balls(table: pa.Table, limit: float) -> pa.Table:
    """One row per member; those of leaders carry the ball's vector, radius, size and least vec_id."""
    table = table.sort_by("ball")
    leader, radius = gather(_matrix(table.column("embedding")), table.column("radius").to_numpy(), limit)
    ids, n, least = (table.column(c).to_numpy() for c in ("ball", "n", "least"))
    total, smallest = np.bincount(leader, n, minlength=len(ids)).astype(np.int64), least.copy()
    np.minimum.at(smallest, leader, least)
    leads = leader == np.arange(len(ids))
    vectors = table.column("embedding").combine_chunks().take(pa.array(np.arange(len(ids)), mask=~leads))
    return pa.table({"ball": ids, "parent": ids[leader], "list": table.column("list").to_numpy(), "embedding": vectors, "radius": radius, "n": total, "least": smallest})


BALL = "ball long, list int, embedding array<double>, radius double, n long, least long"


def _merged(tops: DataFrame, counts: DataFrame, limit: float, level: int) -> DataFrame:
    """``tops`` gathered chunk by chunk within their lists; counts: list, rows."""
    chunks = F.ceil(F.col("rows") / CHUNK)
    dealt = tops.join(F.broadcast(counts), "list").withColumn("chunk", F.pmod(F.xxhash64("ball", F.lit(level)), chunks).cast("int"))  # MAX_LISTS rows at most
    return dealt.groupBy("list", "chunk").applyInArrow(lambda t: _balls(t, limit), "ball long, parent long, list int, embedding array<double>, radius double, n long, least long")


def _leaders(merged: DataFrame) -> DataFrame:
    return merged.where("ball = parent").select("ball", "list", "embedding", "radius", "n", "least")


def balls(rows: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """``rows``: BALL, each its own ball. Returns rid -> ball, and the balls."""
    merged = materialize(_merged(rows, rows.groupBy("list").agg(F.count("*").alias("rows")), limit / 2, 0), "pq-balls")
    members, tops, level = merged.select(F.col("ball").alias("rid"), F.col("parent").alias("ball")), _leaders(merged), 0
    while True:
        counts = tops.groupBy("list").agg(F.count("*").alias("rows")).where(F.col("rows") > RESIDENTS)
        before = counts.agg(F.sum("rows")).first()[0] or 0
        if not before:
            return members, tops
        level += 1
        merged = materialize(_merged(tops, counts, limit, level), "pq-balls")
        ups = merged.select("ball", "parent")
        members = materialize(members.join(ups, "ball", "left").select("rid", F.coalesce("parent", "ball").alias("ball")), "pq-members")
        after = _leaders(merged)
        tops = materialize(tops.join(F.broadcast(counts.select("list")), "list", "left_anti").select(after.columns).unionByName(after), "pq-tops")
        if after.count() > 0.9 * before:
            return members, tops


def _visits(batches, model):
    """The lists that each leader visits, with its code."""
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch.column("embedding"))
        home = batch.column("list").to_numpy()
        codes, left = model.encode(x, home)
        dots = x @ model.centres.T
        row, probe = np.nonzero(dots >= dots.max(axis=1, keepdims=True) - model.margin)
        for at in range(0, len(row), 65_536):
            i, ids = row[at : at + 65_536], batch.column("ball").to_numpy()
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(model.parts), len(i), [None, pa.py_buffer(np.ascontiguousarray(codes[i]))]).cast(pa.binary())
            yield pa.RecordBatch.from_pydict({"list": probe[at : at + 65_536].astype(np.int32), "visitor": ids[i], "home": home[i], "code": code, "left": left[i].astype(np.float32), "radius": batch.column("radius").to_numpy()[i]})


def candidates(residents: pa.Table, visitors: pa.Table, model: Quantiser, theta: float) -> pa.Table:
    """Pairs (a < b) of a list's residents and visitors that the codes don't exclude."""
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(residents) and len(visitors):
        q_ids, v_ids, home = residents.column("ball").to_numpy(), visitors.column("visitor").to_numpy(), visitors.column("home").to_numpy()
        codes = np.frombuffer(b"".join(visitors.column("code").to_pylist()), np.uint8).reshape(len(v_ids), model.parts)
        q, r, lists = _matrix(residents.column("embedding")), residents.column("radius").to_numpy(), residents.column("list").to_numpy()
        rv, left = visitors.column("radius").to_numpy(), visitors.column("left").to_numpy()
        homes, at = np.unique(home, return_inverse=True)
        columns = np.ascontiguousarray(codes.T)
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            held = (part @ model.centres[homes].T).astype(np.float32)[:, at]
            for table, code in zip(model.tables(part), columns):
                held += table[:, code]
            need = np.cos(np.minimum(np.pi, theta + r[i : i + 256].max() + rv)) - left - 1e-4
            a, b = np.nonzero(held >= need.astype(np.float32))
            a += i
            keep = (q_ids[a] != v_ids[b]) & ((lists[a] != home[b]) | (q_ids[a] < v_ids[b]))
            out_a.append(np.minimum(q_ids[a], v_ids[b])[keep])
            out_b.append(np.maximum(q_ids[a], v_ids[b])[keep])
    return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def _decide(batches, threshold: float):
    """Pairs of balls by exact cosine of the leaders: kind 2 all rows link, 1 rows must be compared; others go."""
    theta = acos(threshold)
    for batch in batches:
        if not len(batch):
            continue
        cosine = (_matrix(batch.column("va")) * _matrix(batch.column("vb"))).sum(axis=1)
        angle, ra, rb = np.arccos(np.clip(cosine, -1, 1)), batch.column("ra").to_numpy(), batch.column("rb").to_numpy()
        alone = (batch.column("na").to_numpy() == 1) & (batch.column("nb").to_numpy() == 1)
        all_link = np.where(alone, cosine >= threshold, angle + ra + rb <= theta - SLACK)
        some = ~alone & ~all_link & (angle - ra - rb <= theta + SLACK)
        kind = np.where(all_link, 2, np.where(some, 1, 0)).astype(np.int32)
        keep = np.flatnonzero(kind)
        yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(pa.array(keep)), "b": batch.column("b").take(pa.array(keep)), "na": batch.column("na").take(pa.array(keep)), "nb": batch.column("nb").take(pa.array(keep)), "kind": kind[keep]})


def _tile(left: pa.Table, right: pa.Table, threshold: float) -> pa.Table:
    """For each row of two balls' chunks, how many of the other chunk it links with."""
    if not len(left) or not len(right):
        return pa.table({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "rid": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
    near = _matrix(left.column("embedding")) @ _matrix(right.column("embedding")).T >= threshold
    rid = np.concatenate([left.column("rid").to_numpy(), right.column("rid").to_numpy()])
    links = np.concatenate([near.sum(axis=1), near.sum(axis=0)]).astype(np.int64)
    keep = links > 0
    a, b = left.column("a")[0].as_py(), left.column("b")[0].as_py()
    return pa.table({"a": np.full(keep.sum(), a), "b": np.full(keep.sum(), b), "rid": rid[keep], "links": links[keep]})


def compared(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """a, b, rid, links: rows of pairs of balls compared in tiles. members: rid, ball, embedding."""
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / RESIDENTS)).cast("int")
    dealt = pairs.select("a", "b", pieces("na").alias("ca"), pieces("nb").alias("cb"))

    def side(ball: str, own: str, n: str, other: str, m: str) -> DataFrame:
        rows = dealt.join(members.withColumnRenamed("ball", ball), ball)
        rows = rows.withColumn(own, F.pmod(F.xxhash64("rid"), F.col(n)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).select(*[F.col(c).alias(c) for c in ("a", "b", "ia", "ib", "rid", "embedding")]).groupBy("a", "b", "ia", "ib")

    left, right = side("a", "ia", "ca", "ib", "cb"), side("b", "ib", "cb", "ia", "ca")  # both read the same tables, so columns are named anew
    return left.cogroup(right).applyInArrow(lambda x, y: _tile(x, y, threshold), "a long, b long, rid long, links long")


def near_classes(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding)."""
    spark, theta = rows.sparkSession, acos(threshold)
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)
    every = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].cast("array<double>").alias("embedding"))
    every = materialize(every.withColumn("d", F.when(F.coalesce(ok, F.lit(False)), F.size("embedding"))).withColumn("rid", F.monotonically_increasing_id()), "pq-rows")
    usual = every.where("d IS NOT NULL").groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    alone = F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    if usual is None:
        return every.select("vec_id", *alone)
    valid = every.where(F.col("d") == usual["d"])
    others = every.where(F.col("d").isNull() | (F.col("d") != usual["d"])).select("vec_id", *alone)

    sample = valid.orderBy(F.xxhash64("rid")).limit(SAMPLE_ROWS).select("embedding").toArrow()
    model = Quantiser(_matrix(sample.column("embedding")), max(1, min(MAX_LISTS, isqrt(usual["n"]))), threshold)
    shared = spark.sparkContext.broadcast(model)  # at most MAX_LISTS + WORDS vectors

    def assign(batches):
        for b in batches:
            if len(b):
                ids = b.column("rid")
                yield pa.RecordBatch.from_pydict({"ball": ids, "list": shared.value.home(_matrix(b.column("embedding"))).astype(np.int32), "embedding": b.column("embedding"), "radius": np.zeros(len(b)), "n": np.ones(len(b), np.int64), "least": b.column("vec_id")})

    assigned = valid.select("rid", "vec_id", "embedding").mapInArrow(assign, BALL)
    members, tops = balls(assigned, theta / 2 - SLACK)

    visits = tops.select("ball", "list", "embedding", "radius").mapInArrow(lambda it: _visits(it, shared.value), "list int, visitor long, home int, code binary, left float, radius double")
    sizes = tops.groupBy("list").agg(F.ceil(F.count("*") / RESIDENTS).cast("int").alias("nr")).join(visits.groupBy("list").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("nv")), "list")
    sizes = F.broadcast(materialize(sizes, "pq-sizes"))  # MAX_LISTS rows at most
    dealt = lambda df, key, own, n, other, m: df.join(sizes, "list").withColumn(own, F.pmod(F.xxhash64(key), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("nr", "nv").groupBy("list", "ir", "iv")
    residents = dealt(tops.select("ball", "list", "embedding", "radius"), "ball", "ir", "nr", "iv", "nv")
    found = residents.cogroup(dealt(visits, "visitor", "iv", "nv", "ir", "nr")).applyInArrow(lambda r, w: candidates(r, w, shared.value, theta), "a long, b long").distinct()

    end = lambda x: tops.select(F.col("ball").alias(x), F.col("embedding").alias(f"v{x}"), F.col("radius").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    exact = found.join(end("a"), "a").join(end("b"), "b").select("a", "b", "va", "vb", "ra", "rb", "na", "nb")
    pairs = materialize(exact.mapInArrow(lambda it: _decide(it, threshold), "a long, b long, na long, nb long, kind int"), "pq-pairs")

    whole, some = pairs.where("kind = 2"), pairs.where("kind = 1")
    links = whole.select(F.col("a").alias("u"), F.col("b").alias("v"))
    extra = whole.select(F.col("a").alias("ball"), F.col("nb").alias("more")).unionByName(whole.select(F.col("b").alias("ball"), F.col("na").alias("more")))
    extra = extra.groupBy("ball").agg(F.sum("more").alias("more"))
    own = None
    if not some.isEmpty():
        tiles = materialize(compared(some, members.join(valid.select("rid", "embedding"), "rid"), threshold), "pq-tiles")
        links = links.unionByName(tiles.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        own = tiles.groupBy("rid").agg(F.sum("links").alias("own"))
    roots = components(links)
    info = tops.select("ball", "n", "least").join(extra, "ball", "left").join(roots.withColumnRenamed("node", "ball"), "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    least = info.groupBy("root").agg(F.min("least").alias("component_id"))
    info = materialize(info.join(least, "root").select("ball", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id"), "pq-info")
    result = members.join(valid.select("rid", "vec_id"), "rid").join(sized_broadcast(info, info.count(), 24), "ball")
    if own is not None:
        result = result.join(own, "rid", "left").withColumn("n_links", F.col("n_links") + F.coalesce("own", F.lit(0)))
    return result.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(others)
