"""Ranked lexical search over bit-sliced Bloom signatures.

``build_index(docs)`` reads every whole text once. Documents of like numbers of different terms share a block; a block's signature
is a matrix of bits, one row for each bit position and one column for each document, so that a term's few rows, combined by AND,
are the bitmap of the documents that may hold it. A document enters a term once for each of the steps ``STEPS`` that its
occurrences reach, so the bitmaps also bound the occurrences. Bitmaps only ever overestimate. The index also holds the number of
documents of each term and the documents' lengths.

``search(index, docs, items)`` sums the items' weights over the bitmaps of each step, which bounds every document's score from above.
The documents of the best bounds are scored from their texts; the k-th best of those scores is a floor, and every document whose bound reaches
the floor is scored from its text in turn. What stays unscored is provably below. Items are taken in blocks of about ``ITEM_TERMS`` terms,
each of which is broadcast; the index does not move.

Defined results: null and empty texts hold no terms; null item_ids ask nothing and rows that share an item_id are one item with the
terms of all; rows of documents that repeat are documents each; a null doc_id ranks after the others of its score; an item that no
document scores for has no rows; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, sized_broadcast, text_of, trimmed

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Signature bits of an entry, rows of bits that each sets, documents and cells of a block.
ENTRY_BITS, HASHES, BLOCK_DOCS, BLOCK_CELLS = 22, 5, 2_048, 1 << 23
#: Occurrences that a term enters a signature at.
STEPS = (1, 2, 3, 4, 6, 10, 20, 50)
SEEDS, ITEM_TERMS, COUNTED_TERMS = 32, 100_000, 200_000

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
INDEX = "term string, df long, width int, ids array<long>, hashes array<long>, lengths array<long>, slices binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: only A-Z lower-cased; every other byte outside the terms separates."""
    return text.translate(_TERM_BYTES).split()


def _hashes(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64)


def bit_rows(hashes: np.ndarray, step: int, width: int) -> np.ndarray:
    """(n, HASHES) rows of the signature that entries of a step set."""
    x = hashes + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    first, turn = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * turn[:, None]) % np.uint64(width)).astype(np.int64)


class _Block:
    """Documents of one class that wait for their signature."""

    def __init__(self):
        self.ids, self.texts, self.lengths, self.sizes, self.terms, self.counts, self.widest = [], [], [], [], [], [], 0

    def add(self, doc_id, text_hash: int, counted: Counter, n: int) -> None:
        self.ids.append(doc_id)
        self.texts.append(text_hash)
        self.lengths.append(n)
        self.sizes.append(len(counted))
        self.terms.append(_hashes(counted))
        self.counts.append(np.fromiter(counted.values(), np.int32))
        self.widest = max(self.widest, len(counted))

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or len(self.ids) * self.widest * ENTRY_BITS >= BLOCK_CELLS

    def row(self) -> dict:
        terms, counts, docs = np.concatenate(self.terms), np.concatenate(self.counts), np.repeat(np.arange(len(self.ids)), self.sizes)
        entries = [counts >= s for s in STEPS]
        most = sum(np.bincount(docs[e], minlength=len(self.ids)) for e in entries).max()
        width = max(64, int(most) * ENTRY_BITS)
        cells = np.zeros((width, len(self.ids)), bool)
        for k, e in enumerate(entries):
            own = np.flatnonzero(e)
            for at in range(0, len(own), 1 << 16):  # the rows of all entries at once would outweigh the cells
                some = own[at : at + (1 << 16)]
                cells[bit_rows(terms[some], k, width), docs[some][:, None]] = True
        return {"width": width, "ids": self.ids, "hashes": self.texts, "lengths": self.lengths, "slices": np.packbits(cells, axis=1).tobytes()}


def _texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    for at in range(0, len(batch), 64):
        yield from batch.column(column).slice(at, 64).cast(pa.binary()).to_pylist()


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("term", pa.string()), ("df", pa.int64()), ("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("slices", pa.binary())])
    blocks, held = {}, Counter()
    whole = lambda b: pa.RecordBatch.from_pylist([{"term": None, "df": None} | b.row()], schema)

    def counted() -> pa.RecordBatch:
        none = {f.name: pa.nulls(len(held), f.type) for f in schema if f.name not in ("term", "df")}
        found = pa.RecordBatch.from_pydict({"term": pa.array(list(held), pa.binary()).cast(pa.string()), "df": pa.array(list(held.values()), pa.int64())} | none, schema)
        held.clear()
        return found

    for batch in batches:
        for doc_id, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), _texts(batch)):
            if not (terms := terms_of(text)):
                continue
            own = Counter(terms)
            held.update(own.keys())
            block = blocks.setdefault(len(own).bit_length(), _Block())
            block.add(doc_id, th, own, len(terms))
            if block.full():
                yield whole(blocks.pop(len(own).bit_length()))
            if len(held) >= COUNTED_TERMS:
                yield counted()
    yield from map(whole, blocks.values())
    if held:
        yield counted()


def _hashed(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def build_index(docs: DataFrame) -> DataFrame:
    """INDEX: one row per block of documents; and rows of term and df, partial counts of the documents that hold it."""
    return materialize(_hashed(docs).mapInArrow(trimmed(_indexed), INDEX), "lexical-index")


class Items:
    """A block of items: their terms' hashes and weights."""

    def __init__(self, rows: list):
        terms = sorted({r["term"] for r in rows})
        at = {t: i for i, t in enumerate(terms)}
        self.hashes = _hashes(t.encode() for t in terms) if terms else np.empty(0, np.uint64)
        self.weights: dict[int, dict[bytes, int]] = {}
        for r in rows:
            self.weights.setdefault(r["item_id"], {})[r["term"].encode()] = r["w"]
        self.ids = sorted(self.weights)
        self.terms = [(np.array([at[t.decode()] for t in self.weights[i]]), np.array(list(self.weights[i].values()), np.float64)) for i in self.ids]


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def damping(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 10 + (90 * lengths * documents) // total


def bounds(block: dict, items: Items, documents: int, total: int) -> np.ndarray:
    """(items, documents) upper bounds of the scores. Sums of weights stay far below 2^53, so doubles hold them exactly."""
    lengths = np.asarray(block["lengths"], np.int64)
    m, n = damping(lengths, documents, total), len(lengths)
    slices = np.frombuffer(block["slices"], np.uint8).reshape(block["width"], -1)
    out, before, maps = np.zeros((len(items.ids), n)), np.zeros(n), None
    for k in range(len(STEPS)):
        live = np.arange(len(items.hashes)) if maps is None else np.flatnonzero(maps.any(axis=1))
        if not len(live):
            break
        new = np.zeros((len(items.hashes), slices.shape[1]), np.uint8)
        for at in range(0, len(live), 4_096):
            own = live[at : at + 4_096]
            new[own] = np.bitwise_and.reduce(slices[bit_rows(items.hashes[own], k, block["width"])], axis=1)
        maps = new if maps is None else maps & new
        most = lengths if k + 1 == len(STEPS) else np.minimum(lengths, STEPS[k + 1] - 1)
        reach = saturation(most, m).astype(np.float64)
        some = maps.any(axis=1)
        for i, (terms, weights) in enumerate(items.terms):
            own = some[terms]
            if own.any():
                out[i] += weights[own] @ np.unpackbits(maps[terms[own]], axis=1, count=n) * (reach - before)
        before = reach
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


PLACE = "item_id long, doc_id long, th long, bound double"


def _places(item, i: np.ndarray, block: dict, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"item_id": pa.array(item, pa.int64()), "doc_id": pa.array([block["ids"][k] for k in i], pa.int64()), "th": pa.array([block["hashes"][k] for k in i], pa.int64()), "bound": pa.array(bound, pa.float64())})


def _best_bounds(items: Items, documents: int, total: int):
    """For each item, the documents of the ``SEEDS`` highest bounds of the task."""

    def run(batches):
        held: dict[int, list] = {}
        for block in _blocks(batches):
            found = bounds(block, items, documents, total)
            for i, row in zip(items.ids, found):
                top = np.argpartition(-row, SEEDS)[:SEEDS] if len(row) > SEEDS else np.arange(len(row))
                own = held.get(i, []) + [(-row[k], block["ids"][k], block["hashes"][k]) for k in top if row[k] > 0]
                held[i] = sorted(own, key=lambda x: x[0])[:SEEDS]
        rows = [(i, d, t, -b) for i, own in held.items() for b, d, t in own]
        for at in range(0, len(rows), 8_192):
            columns = list(zip(*rows[at : at + 8_192]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["item_id", "doc_id", "th", "bound"])

    return run


def _not_excluded(items: Items, floors: dict[int, int], documents: int, total: int):
    """Every document whose bound for an item reaches the item's floor."""

    def run(batches):
        for block in _blocks(batches):
            found = bounds(block, items, documents, total)
            for i, row in zip(items.ids, found):
                if len(keep := np.flatnonzero(row >= floors.get(i, 1))):
                    yield _places([i] * len(keep), keep, block, row[keep])

    return run


def _scored(items: Items, documents: int, total: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, asked, text in zip(batch.column("doc_id").to_pylist(), batch.column("asked").to_pylist(), _texts(batch)):
                terms = terms_of(text)
                tf, m = Counter(terms), int(damping(np.int64(len(terms)), documents, total))
                for i in asked:
                    score = sum(w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t, w in items.weights[i].items() if t in tf)
                    if score > 0:
                        out.append((i, doc_id, score))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return run


def scores(places: DataFrame, docs: DataFrame, items: Items, documents: int, total: int) -> DataFrame:
    """item_id, doc_id, score: exact scores of the documents in ``places``, from their whole texts."""
    asked = places.groupBy("doc_id", "th").agg(F.collect_set("item_id").alias("asked"))
    asked = materialize(asked.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "asked"), "lexical-asked")
    size = asked.agg(F.sum(8 * F.size("asked") + 64)).first()[0] or 0
    rows = _hashed(docs)
    rows = rows.join(sized_broadcast(asked, size, 1), (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return rows.select("doc_id", "asked", "text").mapInArrow(trimmed(_scored(items, documents, total)), "item_id long, doc_id long, score long")


def search(index: DataFrame, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, highest score first, ties by doc_id."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = index.where("width IS NOT NULL")
    size = blocks.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("l")).first()
    documents, total = size["n"] or 0, size["l"] or 0
    lower = F.translate(text_of(items), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.where(items["item_id"].isNotNull()).select(items["item_id"].cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    held = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighed = materialize(asked.join(held, "term").select("item_id", "term", weight.alias("w")).where("w > 0"), "lexical-items")
    parts = -(-weighed.count() // ITEM_TERMS)
    result = empty
    for part in range(parts):
        own = Items(weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect())  # about ITEM_TERMS rows
        if not own.ids:
            continue
        shared = own  # sent with the tasks' function, within ITEM_TERMS terms
        best = blocks.drop("term", "df").mapInArrow(_best_bounds(shared, documents, total), PLACE)
        first = best.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "doc_id", "th"))).where(F.col("r") <= SEEDS)
        seeds = scores(first, docs, own, documents, total).withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"))))
        floors = {r["item_id"]: r["score"] for r in seeds.where(F.col("r") == k).collect()}  # one row per item of the block
        left = blocks.drop("term", "df").mapInArrow(_not_excluded(shared, floors, documents, total), PLACE)
        final = scores(left, docs, own, documents, total)
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        result = result.unionByName(final.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return result


ORACLE_SQL = r"""
    WITH own AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    held AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM own WHERE len(terms) > 0),
    whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM held),
    asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
    tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
    scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
               FROM asked JOIN tf USING (term) JOIN w USING (term), whole GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
