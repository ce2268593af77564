"""Spelling variants by Bloom-guided neighbourhoods.

``vocabulary(docs)`` counts words; ``variants(words)`` gives each word its near words (one code point inserted, deleted or replaced), its form
and its root. Words are hashed as polynomials of their code points, so the hash of every edit follows from the word's by
arithmetic on whole arrays. Each word generates its deletions and its replacements by later letters, which reaches every near pair
from one of its ends; each edit probes one 64-bit word of a Bloom filter of the vocabulary, sharded by length. Only edits that the
filter holds become strings and move, to an exact join with the vocabulary, which removes the false ones.

Filters take 4 bytes a word in shards of about ``SHARD_WORDS``; they are broadcast in rounds of ``ROUND_BYTES`` at most, and the words that can
reach a round's lengths probe it, so no broadcast grows with the vocabulary.

Defined results: null and empty texts have no words; a row without doc_id keeps its runs whole; rows that repeat count each; empty tables
give no rows; extra columns are ignored; of near words with the same count the least in code-point order is the form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, text_of, trimmed

MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2
DROP = 97
LONG, SHARD_WORDS, ROUND_BYTES, WORD_BYTES, BITS = 64, 1 << 20, 32 << 20, 4, 5
COUNTED_WORDS, EDITS = 400_000, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # a-z and U+00C0 to U+00FF in UTF-8; no other character holds the byte C3


def runs(doc_id: int | None, text: bytes) -> Counter:
    """Words of one document with their counts: runs, A-Z lower-cased, one code point less where the checksum says so."""
    found = Counter(_RUN.findall(text.lower()))  # bytes: lower() leaves all but A-Z
    if doc_id is None:
        return found
    start = crc32(b"%d:" % doc_id)
    cut = [(run, n) for run, n in found.items() if not crc32(run, start) % DROP]
    found.subtract(dict(cut))
    for run, n in cut:
        letters = run.decode()
        k = crc32(run, start) % len(letters)
        found[(letters[:k] + letters[k + 1 :]).encode()] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Counter()

    def out() -> pa.RecordBatch:
        some = [(w, n) for w, n in held.items() if n and len(w) >= MIN_LETTERS]
        held.clear()
        return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in some], pa.binary()).cast(pa.string()), "n": pa.array([n for _, n in some], pa.int64())})

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for at in range(0, len(batch), 64):
            for doc_id, text in zip(ids[at : at + 64], batch.column("text").slice(at, 64).cast(pa.binary()).to_pylist()):
                held.update(runs(doc_id, text))
                if len(held) >= COUNTED_WORDS:
                    yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of ``MIN_LETTERS`` code points and ``MIN_COUNT`` occurrences at least."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    counted = rows.mapInArrow(trimmed(_counted), "word string, n long").where(F.length("word") >= MIN_LETTERS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _powers(length: int) -> np.ndarray:
    """BASE to the power of length - 1, ..., 1, 0, modulo 2^64."""
    return np.r_[np.uint64(1), np.cumprod(np.full(max(length - 1, 0), BASE), dtype=np.uint64)][::-1][-length:] if length else np.empty(0, np.uint64)


def _letters(words: list[str]) -> np.ndarray:
    """(n, length) code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def polynomial(letters: np.ndarray) -> np.ndarray:
    return (letters * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _mask(x: np.ndarray) -> np.ndarray:
    """The bits of one 64-bit word that a mixed hash sets."""
    out = np.zeros(len(x), np.uint64)
    for k in range(BITS):
        out |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _slot(x: np.ndarray, words: int) -> np.ndarray:
    return ((x >> np.uint64(32)) % np.uint64(words)).astype(np.int64)


def build_filter(x: np.ndarray) -> np.ndarray:
    """Blocked Bloom filter of mixed hashes: blocks of one 64-bit word each."""
    held = np.zeros(max(1, -(-len(x) * WORD_BYTES // 8)), np.uint64)
    np.bitwise_or.at(held, _slot(x, len(held)), _mask(x))
    return held


class Filters:
    """The shards of one round: (length, part) -> filter; parts: length -> number of parts."""

    def __init__(self, shards: dict[tuple[int, int], np.ndarray], parts: dict[int, int]):
        self.shards, self.parts = shards, parts

    def holds(self, h: np.ndarray, length: int) -> np.ndarray:
        """Whether words of a length with polynomial hashes ``h`` may be in the vocabulary (false for shards of other rounds)."""
        x, length = mixed(h), min(length, LONG)
        n = self.parts.get(length, 0)
        part = x % np.uint64(n) if n > 1 else None
        found = np.zeros(len(x), bool)
        for s in range(n):
            if (length, s) in self.shards:
                own = np.flatnonzero(part == s) if part is not None else slice(None)
                held, y = self.shards[length, s], x[own]
                mask = _mask(y)
                found[own] = held[_slot(y, len(held))] & mask == mask
        return found


def edits(words: list[str], alphabet: list[str], filters: Filters) -> Iterator[tuple[int, str]]:
    """(index of the word, edit) of words of one length: deletions and replacements by later letters that the filters hold."""
    letters = _letters(words)
    n, length = letters.shape
    power = _powers(length)
    whole = letters * power
    h = whole.sum(axis=1, dtype=np.uint64)
    if length > 1:
        shifted = np.zeros_like(whole)  # what stands before the gap counts one power less
        shifted[:, 1:] = np.cumsum(letters[:, :-1] * power[1:], axis=1, dtype=np.uint64)
        gap = shifted + (h[:, None] - np.cumsum(whole, axis=1, dtype=np.uint64))
        new = np.ones((n, length), bool)
        new[:, 1:] = letters[:, 1:] != letters[:, :-1]  # equal neighbours give the same word
        i, k = np.nonzero(new)
        for at in np.flatnonzero(filters.holds(gap[i, k], length - 1)):
            yield i[at], words[i[at]][: k[at]] + words[i[at]][k[at] + 1 :]
    codes = np.array([ord(a) for a in alphabet], np.uint64)
    for start in range(0, length, max(1, EDITS // max(1, len(codes)))):  # a slice of places where a word is very long
        own = letters[:, start : start + max(1, EDITS // max(1, len(codes)))]
        i, k, a = np.nonzero(codes[None, None, :] > own[:, :, None])
        k += start
        edited = h[i] + (codes[a] - letters[i, k]) * power[k]
        for at in np.flatnonzero(filters.holds(edited, length)):
            word = words[i[at]]
            yield i[at], word[: k[at]] + alphabet[a[at]] + word[k[at] + 1 :]


def _by_length(words: list[str], alphabet: int) -> Iterator[list[int]]:
    """Indexes of words of one length, in pieces of about EDITS edits."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        step = max(1, EDITS // (int(length) * (alphabet + 1)))
        for at in range(0, len(own), step):
            yield own[at : at + step].tolist()


def _probed(filters, alphabet: list[str]):
    def run(batches):
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for own in _by_length(words, len(alphabet)):
                found = list(edits([words[i] for i in own], alphabet, filters.value))
                if found:
                    yield pa.RecordBatch.from_pydict({"word": [words[own[i]] for i, _ in found], "n": pa.array([counts[own[i]] for i, _ in found], pa.int64()), "other": [e for _, e in found]})

    return run


def _hashed(batches):
    for batch in batches:
        words = batch.column("word").to_pylist()
        lengths, x = np.array([len(w) for w in words], np.int32), np.empty(len(words), np.uint64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            x[own] = mixed(polynomial(_letters([words[i] for i in own])))
        yield pa.RecordBatch.from_pydict({"length": np.minimum(lengths, LONG).astype(np.int32), "x": x.view(np.int64)})


def _shard(table: pa.Table) -> pa.Table:
    held = build_filter(table.column("x").to_numpy().view(np.uint64))
    return pa.table({"length": table.column("length")[:1], "part": table.column("part")[:1], "held": [held.tobytes()]})


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each pair of near words once, from ``words`` (word, n)."""
    spark = words.sparkSession
    alphabet = sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())  # 90 letters at most
    hashed = words.select("word").mapInArrow(_hashed, "length int, x long")
    sizes = {r["length"]: r["count"] for r in hashed.groupBy("length").count().collect()}  # LONG rows at most
    parts = {length: -(-n // SHARD_WORDS) for length, n in sizes.items()}
    todo, rounds, room = [(length, s) for length in sorted(parts) for s in range(parts[length])], [], 0
    for length, s in todo:
        if not rounds or room < SHARD_WORDS * WORD_BYTES:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append((length, s))
        room -= -(-sizes[length] // parts[length]) * WORD_BYTES
    n_parts = F.lit(1)
    for length, n in parts.items():
        n_parts = F.when(F.col("length") == length, F.lit(n)).otherwise(n_parts)
    # the hash is unsigned: its remainder is put together from its upper and lower half
    part = ((F.shiftrightunsigned("x", 32) % n_parts) * (F.lit(1 << 32) % n_parts) + F.col("x").bitwiseAND(0xFFFFFFFF) % n_parts) % n_parts
    shards = hashed.withColumn("part", part.cast("int")).groupBy("length", "part").applyInArrow(_shard, "length int, part int, held binary")
    shards = materialize(shards, "spell-filters") if todo else shards
    found = None
    for own in rounds:
        lengths = sorted({length for length, _ in own})
        held = shards.where(F.col("length").isin(lengths)).collect()  # ROUND_BYTES at most, and what one length has beside
        filters = Filters({(r["length"], r["part"]): np.frombuffer(r["held"], np.uint64) for r in held if (r["length"], r["part"]) in own}, parts)
        reach = sorted({*lengths, *(length + 1 for length in lengths)})
        askers = words.where(F.least(F.length("word"), F.lit(LONG)).isin(reach))
        hits = materialize(askers.mapInArrow(_probed(spark.sparkContext.broadcast(filters), alphabet), "word string, n long, other string"), "spell-hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    return found.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: each round follows twice as many forms; counts at least double along them, so few rounds suffice."""
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for each of ``words`` (word, n; a materialised table of distinct words)."""
    pairs = near_pairs(words)
    both = pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    formed = (-F.col("best.less")) >= RATIO * F.col("n")
    table = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    table = materialize(table, "spell-forms")
    roots = _roots(table.where("form IS NOT NULL"))
    return table.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the ``vocabulary`` of ``docs`` (doc_id, text)."""
    return variants(materialize(vocabulary(docs), "spell-words"))
