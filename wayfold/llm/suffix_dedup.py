"""Repeated-substring removal with a column-wise multi-document suffix order.

Every byte covered by a ``length``-byte string that also starts anywhere else in the collection is removed. Beside it, passages
of at least ``words`` words that also stand elsewhere are found by the same steps over words instead of bytes (white space between
words does not matter) and are reported, not removed.

1. Anchors. The least hash of a ``gram``-byte string inside a ``length``-byte string is a function of its content, so two
   equal strings hold equal anchors at equal offsets. A document falls into pieces: runs of starts that share their anchor.
   Anchors are counted over all documents, and only pieces whose anchor occurs twice go on (a bitmap of fixed
   size, put together by Spark's aggregates, says which; its false hits only add work).
2. Pieces of equal content collapse to one, so a group of copies is one piece however large it is. Repeated pieces are
   repeated throughout and need no comparison for themselves.
3. Pieces are dealt by anchor and laid out on it, and the suffix order is built column by column from the right: each round
   inserts one symbol per piece before its suffix, which permutes the collection's order stably by that symbol
   (the positional Burrows-Wheeler order), and updates where neighbours first differ. A start is repeated exactly when
   a neighbour agrees for ``length`` symbols. The external files are Spark's: pieces are written in the shared scratch
   folder and dealt in groups of bounded size, whose columns fit in memory.
4. An anchor with more than ``HOT_PIECES`` different pieces does not go to one task: each start of its pieces is named by
   128 bits of hash of its ``length`` symbols, and names are counted by a partially aggregated grouping.
5. Repeated starts return to their documents as intervals; the texts are cut where they are scanned.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing (and have no passage with fewer than ``words`` words); rows that repeat doc_id and text are
separate documents and repeat each other; matches never cross documents; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import BROADCAST_BYTES, materialize, sliced, text_of, trim, trimmed

LENGTH, GRAM = 400, 64
#: Least words of a passage, and words of its anchor.
WORDS, WORD_GRAM = 50, 8
#: Bits of the anchor bitmap (16 MB).
BITMAP_BITS = 27
#: Pieces aimed at in one task of the column-wise stage, and different pieces of one anchor above which its starts are counted by name.
GROUP_PIECES, HOT_PIECES = 20_000, 4096
#: Positions handled at once in one document.
CHUNK = 1 << 22
#: Rows of documents, and found pieces, that a worker holds at a time; an Arrow batch may have ten times as many rows.
SLICE_ROWS, SLICE_PIECES = 1_000, 8_192

_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full((1 << 16) - 1, _BASE, np.uint64)])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, over at most CHUNK bytes of them at once."""
    out = np.zeros(len(begin), np.uint64)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + CHUNK, side="right")))
        size = end[a:b] - begin[a:b]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        h = _TABLE[data[at + np.repeat(begin[a:b], size)]] * _POWERS[at & 0xFFFF]
        h = np.add.reduceat(h, first)
        out[a:b] = (h ^ (h >> np.uint64(31))) * _MIX
        a = b
    return out


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hashes of all strings of ``gram`` symbols, by doubling. Symbols: bytes, or 64-bit hashes."""
    data = symbols
    whole, done, h, width, power = None, 0, _TABLE[data] if data.dtype == np.uint8 else data, 1, _BASE
    rest = gram
    while rest:
        if rest & 1:
            part = h[: len(data) - gram + 1 + (gram - done - width)]
            if whole is None:
                whole, done = part, width
            else:
                n = len(data) - done - width + 1
                whole = whole[:n] * np.uint64(power) + h[done : done + n]
                done += width
        rest >>= 1
        if rest:
            n = len(h) - width
            h = h[:n] * np.uint64(power) + h[width : width + n]
            width, power = width * 2, power * power % 2**64
    whole = whole[: len(data) - gram + 1]
    return (whole ^ (whole >> np.uint64(29))) * _MIX


def _window_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by block prefixes and suffixes."""
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def pieces(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, anchor position, first start and number of starts of each piece of a document."""
    w = length - gram + 1
    found = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        if len(part) < length:
            break
        h = gram_hashes(part, gram)
        keys = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)  # ties: leftmost
        where = (_window_min(keys, w) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        p = where[first]
        found.append((h[p], p + at, first + at, np.diff(np.r_[first, len(where)])))
    if not found:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(c) for c in zip(*found))


def _bit(anchors: np.ndarray) -> np.ndarray:
    return ((anchors * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _bytes(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    column = batch.column(k).cast(pa.large_binary())
    for value in column:
        yield np.frombuffer(value.as_buffer() or b"", np.uint8)


class Unit:
    """What a text is made of: bytes, or words. ``length`` and ``gram`` count its symbols."""

    def __init__(self, number: int, length: int, gram: int):
        self.number, self.length, self.gram = number, length, gram

    def symbols(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        if self.number == 0:
            return data, None, None
        begin, end = word_bounds(data)
        return word_hashes(data, begin, end), begin, end

    def pieces(self, data: np.ndarray):
        """Anchor, its position, first start and number of starts of each piece, and a function that cuts out symbols a to b."""
        symbols, begin, end = self.symbols(data)
        anchors, at, first, n = pieces(symbols, self.length, self.gram)
        anchors = anchors ^ np.uint64(self.number * _BASE % 2**64)

        def body(a: int, b: int) -> bytes:
            if begin is None:
                return data[a:b].tobytes()
            return b" ".join(data[begin[a] : end[b - 1]].tobytes().split())

        return anchors, at, first, n, body

    def windows(self, body: bytes) -> np.ndarray:
        """(starts, 2): 128 bits that name each string of ``length`` symbols."""
        symbols = self.symbols(np.frombuffer(body, np.uint8))[0]
        other = (_TABLE[symbols] if symbols.dtype == np.uint8 else symbols) * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.stack([gram_hashes(symbols, self.length), gram_hashes(other ^ (other >> np.uint64(32)), self.length)], axis=1)

    def numbers(self, bodies: list[bytes]) -> tuple[list[np.ndarray], int]:
        """Symbols of pieces as small numbers, and how many there are."""
        if self.number == 0:
            return [np.frombuffer(b, np.uint8) for b in bodies], 256
        known: dict[bytes, int] = {}
        return [np.array([known.setdefault(w, len(known)) for w in b.split()], np.int32) for b in bodies], len(known)


def _anchor_counts(units: list[Unit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE_ROWS):
            found = [u.pieces(d)[0] for d in _bytes(batch, 0) for u in units]
            if found:
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(_bit(keys) >> 6), pa.array(np.left_shift(np.int64(1), _bit(keys) & 63))], names=["anchor", "n", "word", "mask"])

    return run


def _bitmap(counted: DataFrame) -> bytes:
    """The bits of anchors that occur more than once: at most 2 ** BITMAP_BITS / 64 rows reach the driver."""
    twice = counted.groupBy("anchor", "word", "mask").agg(F.sum("n").alias("n")).where("n > 1")
    rows = twice.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros((1 << BITMAP_BITS) // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return words.tobytes()


def _emit(units: list[Unit], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.int64)
        sent: set[bytes] = set()
        names = ["doc_id", "h", "unit", "first", "n", "key", "anchor", "offset", "body"]

        def held(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            take, unit, first, n, key, anchor, offset, body = zip(*rows)
            kept = batch.select([0, 1]).take(pa.array(take))
            return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(unit, pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(anchor, pa.int64()), pa.array(offset, pa.int32()), pa.array(body, pa.binary())], names=names)

        for batch in sliced(batches, SLICE_ROWS):
            rows: list[tuple] = []
            for k, data in enumerate(_bytes(batch, 2)):
                for u in units:
                    anchors, at, first, n, cut = u.pieces(data)
                    bit = _bit(anchors)
                    for j in np.flatnonzero(bitmap[bit >> 6] >> (bit & 63) & 1):
                        body, offset = cut(int(first[j]), int(first[j] + n[j] + u.length - 1)), int(at[j] - first[j])
                        key = hashlib.blake2b(body, digest_size=16, salt=(2 * offset + u.number).to_bytes(16, "big")).digest()
                        new = key not in sent
                        if new:
                            if len(sent) > 500_000:
                                sent.clear()
                            sent.add(key)
                        rows.append((k, u.number, int(first[j]), int(n[j]), key, int(anchors[j].view(np.int64)), offset, body if new else None))
                        if len(rows) >= SLICE_PIECES:
                            yield held(batch, rows)
                            rows = []
            if rows:
                yield held(batch, rows)

    return run


def repeated_starts(group: np.ndarray, offset: np.ndarray, starts: np.ndarray, bodies: list[np.ndarray], alphabet: int, length: int, left: int) -> np.ndarray:
    """For pieces aligned on their anchors (column ``left``): a (pieces, left + 1) matrix of repeated starts by column.

    ``group`` must ascend; ``offset``: the anchor's place in the piece; ``starts``: number of starts of the piece;
    ``bodies``: symbols from 0 to ``alphabet`` - 1.
    """
    m, width = len(bodies), left + length
    begin = left - offset
    inside = np.stack([begin, begin + np.array([len(b) for b in bodies])], axis=1)
    columns = np.zeros((width, m), np.uint8 if alphabet <= 256 else np.int32)
    for k, body in enumerate(bodies):  # no symbol: told apart by ``inside``
        columns[inside[k, 0] : inside[k, 1], k] = body
    order = np.arange(m)  # suffixes that start at the current column, sorted within each group
    differ = np.full(m, width, np.int64)  # first column in which a suffix differs from the one before it
    wall = np.r_[True, group[1:] != group[:-1]]
    differ[wall] = -1
    repeated = np.zeros((m, left + 1), bool)
    edge = group * (alphabet + 1)
    for col in range(width - 1, -1, -1):
        symbol = columns[col].astype(np.int64) + 1
        symbol[(col < inside[:, 0]) | (col >= inside[:, 1])] = 0
        key = edge + symbol
        held = key[order]
        place = np.argsort(held, kind="stable")
        if m > 1:
            # neighbours of equal symbol differ where the least of those between them did; others differ here
            same = held[place][1:] == held[place][:-1]
            same &= symbol[order[place[1:]]] > 0
            new = np.full(m, col, np.int64)
            pairs = np.flatnonzero(same)
            if len(pairs):
                a, b = place[pairs] + 1, place[pairs + 1] + 1
                near = b - a == 1
                least = differ[a].copy()
                far = np.flatnonzero(~near)
                if len(far):
                    cut = np.stack([a[far], b[far]], axis=1).ravel()
                    least[far] = np.minimum.reduceat(np.r_[differ, width], cut)[::2]
                new[pairs + 1] = least
            differ = new
        order = order[place]
        differ[wall] = -1  # groups keep their places
        if col <= left:
            long = differ >= col + length
            hit = long | np.r_[long[1:], False]
            repeated[order[hit], col] = True
    cols = np.arange(left + 1)
    return repeated & (cols >= begin[:, None]) & (cols < (begin + starts)[:, None])


def _intervals(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end of each run of marks in a row."""
    edges = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, a = np.nonzero(edges == 1)
    return rows, a, np.nonzero(edges == -1)[1]


def _compare(units: list[Unit]):
    """Pieces of one bucket to the intervals of their repeated starts."""

    def run(table: pa.Table) -> pa.Table:
        keys, out = table.column("key").to_pylist(), []
        for u in units:
            seen: dict[bytes, int] = {}
            for k in np.flatnonzero(table.column("unit").to_numpy() == u.number).tolist():
                seen.setdefault(keys[k], k)
            take = np.fromiter(seen.values(), np.int64, len(seen))
            anchors = table.column("anchor").to_numpy()[take]
            order = np.argsort(anchors, kind="stable")
            take, group, counts = take[order], *np.unique(anchors[order], return_inverse=True, return_counts=True)[1:]
            take = take[counts[group] > 1]
            if not len(take):
                continue
            part, left = table.take(pa.array(take)), u.length - u.gram
            group = np.unique(part.column("anchor").to_numpy(), return_inverse=True)[1]
            offset, n = part.column("offset").to_numpy().astype(np.int64), part.column("n").to_numpy()
            bodies, alphabet = u.numbers(part.column("body").to_pylist())
            rows, a, b = _intervals(repeated_starts(group, offset, n, bodies, alphabet, u.length, left))
            shift = left - offset[rows]
            out += zip([keys[take[r]] for r in rows], (a - shift).tolist(), (b - shift).tolist())
        cols = list(zip(*out)) or [[], [], []]
        trim()
        return pa.table({"key": pa.array(cols[0], pa.binary()), "a": pa.array(cols[1], pa.int64()), "b": pa.array(cols[2], pa.int64())})

    return run


def _named_starts(units: list[Unit]):
    """key, unit, body to one row per start: its place and 128 bits that name its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                found = [units[k].windows(body) for k, body in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                if found:
                    sizes = [len(f) for f in found]
                    flat, at = np.concatenate(found).view(np.int64), np.concatenate([np.arange(n) for n in sizes])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(at), pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["key", "at", "x", "y"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, places of one piece to intervals."""
    for batch in batches:
        out = []
        for key, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            marks = np.zeros((1, max(places) + 1), bool)
            marks[0, places] = True
            out += [(key, a, b) for a, b in zip(*(x.tolist() for x in _intervals(marks)[1:]))]
        cols = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["key", "a", "b"])


def _repeats_of_hot(bodies: DataFrame, units: list[Unit]) -> DataFrame:
    """key, a, b for the pieces of anchors that have too many to compare in one task; no group is held anywhere."""
    pieces_ = bodies.groupBy("key").agg(F.first("unit").alias("unit"), F.first("body").alias("body"))
    starts = materialize(pieces_.mapInArrow(trimmed(_named_starts(units)), "key binary, at long, x long, y long"), "suffix-starts")
    twice = starts.groupBy("x", "y").agg(F.count("*").alias("c")).where("c > 1").select("x", "y")
    places = starts.join(twice, ["x", "y"], "left_semi").groupBy("key").agg(F.collect_list("at").alias("places"))  # at most length - gram + 1 each
    return places.mapInArrow(trimmed(_runs), "key binary, a long, b long")


def _merge_cuts(lengths: dict[int, int]):
    """Intervals of starts of a document to those whose symbols do not meet, by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cuts in batch.column(2).to_pylist():
                merged: list[dict] = []
                for c in sorted(cuts, key=lambda c: (c["unit"], c["a"])):
                    if merged and c["unit"] == merged[-1]["unit"] and c["a"] <= merged[-1]["b"] + lengths[c["unit"]] - 1:
                        merged[-1]["b"] = max(merged[-1]["b"], c["b"])
                    else:
                        merged.append(dict(c))
                out.append(merged)
            kind = pa.list_(pa.struct([("unit", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "h", "cuts"])

    return run


def _cut(lengths: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words", "kept"]
        for batch in sliced(batches, SLICE_ROWS):
            numbers, digest, kept = [], [], []
            for data, cuts in zip(_bytes(batch, 1), batch.column(2).to_pylist()):
                out, at, spans, passages, words = [], 0, 0, 0, 0
                for c in cuts or ():  # they ascend and do not meet
                    if c["unit"]:
                        passages += 1
                        words += c["b"] - c["a"] + lengths[1] - 1
                    else:
                        spans += 1
                        out.append(data[at : c["a"]])
                        at = c["b"] + lengths[0] - 1
                out = b"".join(x.tobytes() for x in [*out, data[at:]])
                numbers.append((len(data), len(data) - len(out), spans, passages, words))
                digest.append(hashlib.sha256(out).hexdigest())
                kept.append(out)
            cols = [pa.array(c, pa.int64()) for c in (zip(*numbers) if numbers else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols[:3], pa.array(digest, pa.string()), *cols[3:], pa.array(kept, pa.binary())], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words, kept (the bytes that stay).

    ``n_passages`` and ``passage_words``: maximal runs of words that lie in strings of ``words`` words which also start elsewhere, and
    their words.
    """
    spark = docs.sparkSession
    units, lengths = [Unit(0, length, gram), Unit(1, words, word_gram)], {0: length, 1: words}
    text = text_of(docs)
    rows = docs.select(docs["doc_id"], F.xxhash64(text).alias("h"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.select("text").mapInArrow(trimmed(_anchor_counts(units)), "anchor long, n long, word long, mask long")
    shared = spark.sparkContext.broadcast(_bitmap(counted))
    schema = f"doc_id {kind}, h long, unit int, first long, n long, key binary, anchor long, offset int, body binary"
    listed = materialize(rows.mapInArrow(trimmed(_emit(units, shared)), schema), "suffix-pieces")
    bodies = listed.where("body IS NOT NULL").select("unit", "key", "anchor", "offset", "n", "body")
    buckets = max(1, bodies.count() // GROUP_PIECES)
    hot = materialize(bodies.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > HOT_PIECES).select("anchor"), "suffix-hot")
    some = hot.count()  # each stands for more than HOT_PIECES pieces
    cool = bodies.join(F.broadcast(hot), "anchor", "left_anti") if some else bodies
    dealt = cool.select(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"), "unit", "key", "anchor", "offset", "n", "body")
    partial = dealt.groupBy("bucket").applyInArrow(_compare(units), "key binary, a long, b long")
    if some:
        partial = partial.unionByName(_repeats_of_hot(bodies.join(F.broadcast(hot), "anchor", "left_semi"), units))
    whole = listed.groupBy("key").agg(F.count("*").alias("c"), F.first("n").alias("n")).where("c > 1")
    spans = materialize(whole.select("key", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")).unionByName(partial.join(whole.select("key"), "key", "left_anti")), "suffix-repeats")
    places = listed.select("doc_id", "h", "unit", "first", "key").join(spans, "key").select("doc_id", "h", "unit", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    cuts = places.groupBy("doc_id", "h").agg(F.collect_list(F.struct("unit", "a", "b")).alias("cuts"))
    cuts = materialize(cuts.mapInArrow(trimmed(_merge_cuts(lengths)), f"doc_id {kind}, h long, cuts array<struct<unit:int,a:long,b:long>>"), "suffix-cuts")
    n = cuts.agg(F.sum(48 + 24 * F.size("cuts"))).first()[0] or 0
    cuts = cuts.withColumnsRenamed({"doc_id": "d", "h": "g"})
    cuts = F.broadcast(cuts) if n <= BROADCAST_BYTES else cuts
    joined = rows.join(cuts, rows["doc_id"].eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long, kept binary"
    return joined.select("doc_id", "text", "cuts").mapInArrow(trimmed(_cut(lengths)), schema)
