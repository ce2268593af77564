"""Quality classifier: supervised subword embeddings trained by numpy stochastic gradient descent.

A document is the average of learned vectors: one per word, one per character n-gram of the word in ``<`` and ``>``, one per
pair of neighbouring words, all hashed into a table; a pair of equal words hashes to one shared entry, so that
repetition is visible whatever is repeated. A softmax over two classes follows. Training takes at most
``TRAIN_ROWS`` labelled rows and ``TRAIN_BYTES`` of text (those with the smallest hashes of doc_id, whole texts), and the steps are normalised by the
length of the document's feature vector, so that long and short documents move the average alike.

Scoring is linear after averaging: each table entry reduces to one number, the log odds it adds, and a word to a
sum and a count, found for all different words of a slice of rows at once. Every row is scored in one pass, without a shuffle.

Defined results: a null or blank text has no features and gets the model's bias; rows with a null label or doc_id do not
train; an id labelled twice counts with its lower label; without both classes the model is flat and every score is the share
of label 1 (0.5 without labels); repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, text_of, trimmed, without

TRAIN_ROWS, TRAIN_BYTES = 3_000, 64 << 20
BITS, DIM, GRAMS = 18, 8, (3, 4, 5)
STEPS, RATE, SEED = 12_000, 0.25, 7
#: Bytes of text, and rows, that a worker scores at once; a longer text is scored alone.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 2_000
THRESHOLD = 0.7

_SIZE = 1 << BITS
_SAME = 2 * _SIZE - 1  # the entry of a pair of equal words
_CRC = np.array([zlib.crc32(bytes([255 ^ k])) ^ 0xFF000000 for k in range(256)], np.uint32)  # what a byte adds to the register


def word_entries(word: str) -> list[int]:
    """Table entries of a word: itself and its character n-grams."""
    marked = f"<{word}>"
    found = [zlib.crc32(marked.encode()) & (_SIZE - 1)]
    for n in GRAMS:
        found += [zlib.crc32(marked[k : k + n].encode(), n) & (_SIZE - 1) for k in range(len(marked) - n + 1)]
    return found


def pair_entries(hashes: np.ndarray) -> np.ndarray:
    """Table entries of neighbouring words, from the words' hashes."""
    a, b = hashes[:-1], hashes[1:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
    return np.where(a == b, _SAME, _SIZE + np.minimum(mixed.astype(np.int64), _SIZE - 2))


def _hash(word: str) -> int:
    return zlib.crc32(word.encode()) + 1


class Features:
    """Distinct table entries of a document and their shares."""

    def __init__(self) -> None:
        self.words: dict[str, tuple[np.ndarray, int]] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        parts, hashes = [], []
        for w in text.split():
            got = self.words.get(w)
            if got is None:
                if len(self.words) > 50_000:
                    self.words.clear()
                got = self.words[w] = (np.array(word_entries(w), np.int32), _hash(w))
            parts.append(got[0])
            hashes.append(got[1])
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        entries = np.concatenate([*parts, pair_entries(np.array(hashes, np.uint64)).astype(np.int32)])
        ids, counts = np.unique(entries, return_counts=True)
        return ids, (counts / len(entries)).astype(np.float32)


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """Log odds that each table entry adds, and the bias."""
    share = float(np.mean(labels)) if labels else 0.5
    if len(set(labels)) < 2:
        share = min(max(share, 1e-3), 1 - 1e-3) if labels else 0.5
        return np.zeros(2 * _SIZE, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(SEED)
    of = Features()
    docs = [of(t) for t in texts]
    of.words.clear()
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (2 * _SIZE, DIM)).astype(np.float32)
    weights = rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    done, total = 0, max(STEPS, len(docs))
    while done < total:
        for k in rng.permutation(len(docs)):
            rate = RATE * (1 - done / total)
            if rate <= 0:
                break
            ids, part = docs[k]
            hidden = part @ vectors[ids]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            step = weights @ p
            weights -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            if len(ids):
                vectors[ids] -= np.outer(part * (rate / float(part @ part)), step) * min(1.0, 50 * float(part @ part))
            done += 1
    return (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def labelled(labels: DataFrame, held_out: Column, column: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` ids and labels outside ``held_out``, those with the smallest hashes."""
    chosen = labels.where(~held_out & F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.min(column).alias("label"))
    return chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> tuple[np.ndarray, float]:
    """The model. Of rows that share a doc_id one trains; texts go to the driver while they stay within TRAIN_BYTES."""
    chosen = materialize(labelled(labels, held_out(), column), "quality-labels")
    # at most TRAIN_ROWS rows, so the side is small by its parameter
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.octet_length("text"), F.md5("text"))).alias("text"))
    rows = materialize(rows, "quality-rows")
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("size"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id")  # TRAIN_ROWS numbers at most
    fits = sizes.withColumn("sum", F.sum("size").over(before)).where(F.col("sum") <= TRAIN_BYTES).select("doc_id")
    frame = rows.join(F.broadcast(fits), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "label").toPandas()
    return train(frame["text"].tolist(), [int(x > 0) for x in frame["label"]])


def _crc_steps(state: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """zlib.crc32 of each string ``data[begin:end]``, carried on from ``state``."""
    crc, longest = ~state, int((end - begin).max(initial=0))
    least = int((end - begin).min(initial=longest))
    for k in range(longest):
        at = slice(None) if k < least else np.flatnonzero(end - begin > k)
        c = crc[at]
        crc[at] = _CRC[(c ^ data[begin[at] + k]) & 255] ^ (c >> np.uint32(8))
    return ~crc


def word_odds(words: pa.Array, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By word: the sum of ``odds`` over its ``word_entries``, how many these are, and its ``_hash``."""
    plain = [w.encode() for w in words.to_pylist()]
    crc = zlib.crc32
    hashes = np.fromiter(map(crc, plain), np.int64, len(plain)) + 1
    marked = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x.cast(pa.large_string()) for x in ("<", words, ">", "")))
    ends = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)
    first = np.flatnonzero((data[: ends[-1]] & 0xC0) != 0x80)  # byte of each character
    start = np.searchsorted(first, ends)  # characters before each word
    size = np.diff(start)
    first = np.r_[first, ends[-1:]]
    opened = crc(b"<")
    whole = np.fromiter((crc(b">", crc(w, opened)) for w in plain), np.int64, len(plain)) & (_SIZE - 1)
    sums, counts = odds[whole].astype(np.float64), np.ones(len(plain), np.int64)
    owner = np.repeat(np.arange(len(plain)), size)
    place = np.arange(len(owner)) - np.repeat(start[:-1], size)
    for n in GRAMS:
        at = np.flatnonzero(place + n <= size[owner])
        entries = _crc_steps(np.full(len(at), n, np.uint32), data, first[at], first[at + n]) & np.uint32(_SIZE - 1)
        sums += np.bincount(owner[at], odds[entries], len(plain))
        counts += np.maximum(size - n + 1, 0)
    return sums, counts, hashes.astype(np.uint64)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most SLICE_ROWS rows and SLICE_BYTES of text (column 1), or one row."""
    before = np.r_[0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))]
    a = 0
    while a < batch.num_rows:
        b = min(a + SLICE_ROWS, max(a + 1, int(np.searchsorted(before, before[a] + SLICE_BYTES, side="right")) - 1), batch.num_rows)
        yield batch.slice(a, b - a)
        a = b


def log_odds(texts: pa.Array, odds: np.ndarray) -> np.ndarray:
    """The mean of ``odds`` over the entries of each text's words and pairs; 0 without words."""
    n = len(texts)
    split = pc.utf8_split_whitespace(texts)  # at the characters of str.split
    coded = split.flatten().dictionary_encode()
    at, doc = coded.indices.to_numpy(), np.repeat(np.arange(n), pc.list_value_length(split).to_numpy())
    empty = pc.index(coded.dictionary, "").as_py()  # before leading and after trailing white space
    if empty >= 0:
        at, doc = at[kept := at != empty], doc[kept]
    if not len(at):
        return np.zeros(n)
    sums, counts, hashes = word_odds(coded.dictionary, odds)
    total = np.bincount(doc, sums[at], n)
    size = np.bincount(doc, counts[at], n)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    total += np.bincount(doc[inside], odds[pair_entries(hashes[at])[inside]], n)
    size += np.bincount(doc[inside], minlength=n)
    return total / np.maximum(size, 1)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: str = "doc_id") -> DataFrame:
    """``keep`` and score (0 to 1: how likely label 1 is) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, fixed by BITS
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, bias = shared.value
        for part in (p for b in batches for p in slices(b)):
            z = log_odds(part.column(1), odds) + bias
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=[keep, "score"])

    return docs.select(docs[keep], text_of(docs).alias("text")).mapInArrow(trimmed(run), f"{keep} {kind}, score double")


def judged(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, each judged by its own text, with or without doc_id."""
    text = text_of(docs)
    rows = docs.select(F.struct(docs["doc_id"], F.xxhash64(text).alias("th")).alias("row"), text.alias("text"))
    found = score(rows, fit(docs, labels), "row").where(F.col("score") < THRESHOLD)
    return without(docs, found.select("row.doc_id", "row.th"))
