"""N-gram Jaccard join with a token-group matrix.

Documents link when their sets of word shingles have a Jaccard similarity of at least 3/4; the result is each
document's component of links. Equal sets collapse first, so copies are one node.

1. Partition. Nodes that share a minimum hash form groups of similar documents (a node joins the commonest of its minima;
   large groups are dealt by salt around a node that is in every part). A group is opened once: a search spreads from each node to the nodes not yet reached,
   through postings of those only, and yields links that span its components. What is linked so becomes one unit.
2. Matrix. Each unit's documents are dealt to groups of bounded size, and the matrix holds for each token the groups whose
   union of prefix tokens has it. The prefix of a set of n tokens is its first n - ceil(3n/4) + 1 in one
   order for all (by a sketch of document frequencies, rare first, then by hash): sets that link share a prefix token.
3. Bound. A query document meets the groups of other units under its prefix tokens, if sizes and places still
   allow the needed overlap. Groups are opened only if the query shares at least 3/4 of its tokens with the group's
   token union; then the exact similarity with each member decides. Nothing is capped: every pair of documents in different
   units that could link is met, and pairs within a unit add nothing to the components.

Tokens are 64-bit hashes of the whole shingles. The sketch has a fixed size (4 MB) and is summed over all documents, in two steps:
tasks to SKETCH_HALVES sums, those to one.

Defined results: a null, empty or blank text has no shingles and is its own component; with fewer words than a shingle has, the
whole sequence is the one shingle; a null doc_id gets the least non-null doc_id of its component, or null; repeated rows are
separate rows of one node; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, sized_broadcast, text_of, trimmed, without
from wayfold.llm.components import components

WORDS, PERCENT = 5, 75
MINIMA = 6
SKETCH_BITS, SKETCH_PARTS, SKETCH_HALVES = 20, 64, 256
#: Sizes that tasks are dealt by; none drops anything. Groups are bounded by documents and by tokens (8 bytes each).
GROUP_NODES, CHUNK_NODES, CHUNK_QUERIES, GROUP_TOKENS, BUCKET_TOKENS, PAIR_BLOCK = 512, 256, 1024, 4_000_000, 1_000_000, 1_000_000
CACHE_WORDS, SLICE_BYTES = 250_000, 2 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(3).integers(1, 2**63, MINIMA, dtype=np.uint64) | np.uint64(1)


class _Slots(dict):
    """Word -> position of its hash; a missing word is added."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return at


def _distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    return s[np.r_[True, s[1:] != s[:-1]]]


class Shingler:
    """Texts in UTF-8 to sorted distinct shingle hashes. Words are remembered in a table of bounded size."""

    def __init__(self, words: int = WORDS):
        self.k, self.slots = words, _Slots()

    def _roll(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k words."""
        n = len(h) - k + 1
        s = h[:n] + np.uint64(k)
        for j in range(1, k):
            s = (s ^ (s >> np.uint64(31))) * _B + h[j : n + j]
        return (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.slots) > CACHE_WORDS:
            self.slots = _Slots()
        split = [t.lower().split() for t in texts]  # of bytes: A-Z and ASCII white space only
        sizes = [len(ws) for ws in split]
        at = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        h = np.frombuffer(self.slots.hashes, np.uint64)[at] if len(at) else np.zeros(0, np.uint64)
        rolled = self._roll(h, self.k) if len(h) >= self.k else h[:0]
        out, begin = [], 0
        for n in sizes:
            if n >= self.k:
                out.append(_distinct(rolled[begin : begin + n - self.k + 1]))
            else:
                out.append(self._roll(h[begin : begin + n], n) if n else h[:0])
            begin += n
        return out


def _slices(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that the texts of column ``k`` stay below SLICE_BYTES (or are one text)."""
    for batch in batches:
        column = batch.column(k).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1])
        begin = np.cumsum(sizes) - sizes
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(begin, begin[a] + SLICE_BYTES)))
            yield batch.slice(a, b - a), column.slice(a, b - a).to_pylist()
            a = b


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def links(o: np.ndarray, a, b, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of sizes a and b with overlap o link."""
    return 100 * o >= percent * (a + b - o)


def _needed(n, percent: int = PERCENT):
    """Least overlap with anything that a set of size n needs."""
    return -(-percent * n // 100)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sketch = Shingler(words), np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "th", "n", "key", "mins", "part", "counts"]
        kind = None
        for batch, texts in _slices(batches, 2):
            kind = batch.column(0).type
            sets = shingle(texts)
            n = np.array([len(s) for s in sets], np.int64)
            mins = np.zeros((len(sets), MINIMA), np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                flat = np.concatenate([sets[k] for k in full])
                sketch += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                begin = np.r_[0, np.cumsum(n[full])[:-1]]
                for j in range(MINIMA):
                    mins[full, j] = np.minimum.reduceat(flat * _MIX[j], begin)
            keys = [_key(s) if len(s) else None for s in sets]
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * MINIMA), pa.array(mins.view(np.int64).ravel()))
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(keys, pa.binary()), wide, *none], names=names)
        if kind is not None:
            m, each = SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS
            parts = [sketch[k * each : (k + 1) * each].tobytes() for k in range(m)]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(pa.int64())), pa.array(range(m), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _sum_sketch(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
    for counts in table.column("counts"):
        total += np.frombuffer(counts.as_buffer(), np.int64)
    return pa.table([*(table.column(c).slice(0, 1) for c in table.column_names[:-1]), pa.array([total.tobytes()], pa.binary())], names=table.column_names)


def _parts_of(documents: Column, tokens: Column, most: int) -> Column:
    """Into how many parts a group is dealt: at most about ``most`` documents and GROUP_TOKENS tokens each."""
    return F.greatest(F.ceil(documents / most), F.ceil(tokens / GROUP_TOKENS)).cast("long")


def _grouped_sets(words: int):
    """text, places array<struct<group, member>> -> a row with the set for each group that its document takes part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sent = Shingler(words), set()
        for batch, texts in _slices(batches, 0):
            rows = []
            for s, places in zip(shingle(texts), batch.column(1).to_pylist()):
                key = _key(s)
                if key not in sent:
                    if len(sent) > 1_000_000:
                        sent.clear()
                    sent.add(key)
                    data = s.tobytes()
                    rows += [(p["group"], p["member"], key, data) for p in places]
            if rows:
                group, member, keys, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(member, pa.bool_()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["group", "member", "key", "tokens"])

    return run


class Postings:
    """Token -> positions of the sets in a list; gives overlaps of a set with all of them."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.tokens, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(flat)]
        self.owner, self.n = owner[order], len(sets)

    def rows(self, s: np.ndarray) -> np.ndarray:
        """Rows of the tokens of ``s`` that the union has."""
        at = np.searchsorted(self.tokens, s)
        at[at == len(self.tokens)] = 0
        return at[self.tokens[at] == s]

    def overlaps(self, at: np.ndarray) -> np.ndarray:
        counts = self.ends[at] - self.starts[at]
        if not len(at):
            return np.zeros(self.n, np.int64)
        where = np.repeat(self.starts[at] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        return np.bincount(self.owner[where], minlength=self.n)


def spanning_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that span the components of a group: a search from each set over the sets not yet reached."""
    size = np.array([len(s) for s in sets])
    left = np.ones(len(sets), bool)
    held = np.arange(len(sets))
    postings = Postings(sets)
    out = []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            if 2 * int(left[held].sum()) < len(held):
                held = held[left[held]]
                if not len(held):
                    return out
                postings = Postings([sets[k] for k in held])
            o = postings.overlaps(postings.rows(sets[x]))
            got = held[links(o, size[x], size[held], percent) & left[held]]
            left[got] = False
            queue.extend(got.tolist())
            out.extend((x, y) for y in got.tolist())
    return out


def _open_group(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys, tokens = table.column("key").to_pylist(), table.column("tokens").to_pylist()
        one = {k: t for k, t in zip(keys, tokens)}
        keys, sets = list(one), [np.frombuffer(t, np.uint64) for t in one.values()]
        pairs = spanning_links(sets, percent) if len(keys) > 1 else []
        return pa.table({"u": pa.array([keys[a] for a, _ in pairs], pa.binary()), "v": pa.array([keys[b] for _, b in pairs], pa.binary())})

    return run


_TOKEN = np.dtype([("token", "<u8"), ("doc", "<u2"), ("at", "<u2")])
_DOC = np.dtype([("node", "<u8"), ("unit", "<u8"), ("n", "<u4"), ("chunk", "<u4")])


def _matrix(words: int, percent: int, buckets: int, shared):
    """text, unit, chunk -> packed matrix entries by bucket of the token: prefix tokens, and the documents they point to.

    Places above 65535 are stored as 65535, which only weakens the bound that uses them.
    """

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        keys, units, n, chunks, prefix = zip(*rows)
        sizes = np.array([len(p) for p in prefix])
        docs = np.empty(len(rows), _DOC)
        docs["node"], docs["unit"] = (np.frombuffer(b"".join(k[:8] for k in c), np.uint64) for c in (keys, units))
        docs["n"], docs["chunk"] = n, chunks
        flat = np.empty(int(sizes.sum()), _TOKEN)
        flat["token"] = np.concatenate(prefix)
        flat["doc"] = np.repeat(np.arange(len(rows)), sizes)
        flat["at"] = np.minimum(np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), 65535)
        bucket = (flat["token"] * _B >> np.uint64(40)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        flat, bucket = flat[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        packs, owners = [], []
        for i, j in zip(cut, [*cut[1:], len(flat)]):
            part = flat[i:j].copy()
            used, part["doc"] = np.unique(part["doc"], return_inverse=True)
            packs.append(part.tobytes())
            owners.append(docs[used].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(packs, pa.binary()), pa.array(owners, pa.binary())], names=["bucket", "entries", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, shingle, sent, rows = np.frombuffer(shared.value, np.int64), Shingler(words), set(), []
        for batch, texts in _slices(batches, 0):
            units, chunks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k, s in enumerate(shingle(texts)):
                if not len(s):
                    continue
                key = _key(s)
                if key in sent:
                    continue
                if len(sent) > 1_000_000:
                    sent.clear()
                sent.add(key)
                p = len(s) - int(_needed(len(s), percent)) + 1
                order = np.argsort(sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")  # s ascends: ties by hash
                rows.append((key, units[k] or key, len(s), chunks[k] or 0, s[order[:p]]))
            if len(rows) >= 2048:
                yield pack(rows)
                rows = []
        if rows:
            yield pack(rows)

    return run


def _unpack(table: pa.Table) -> np.ndarray:
    """Entries of one bucket whose token is there more than once."""
    entries = [np.frombuffer(b, _TOKEN) for b in table.column("entries").to_pylist()]
    docs = [np.frombuffer(b, _DOC) for b in table.column("docs").to_pylist()]
    first = np.cumsum([0, *map(len, docs)])[:-1]
    flat = np.concatenate(entries)
    doc = flat["doc"].astype(np.int64) + np.repeat(first, [len(e) for e in entries])
    order = np.argsort(flat["token"], kind="stable")
    same = np.diff(flat["token"][order]) == 0
    order = order[np.r_[False, same] | np.r_[same, False]] if len(order) > 1 else order[:0]
    owner = np.concatenate(docs)[doc[order]]
    out = np.empty(len(order), np.dtype([*_TOKEN.descr[:1], *_DOC.descr, ("at", "<u4")]))
    out["token"], out["at"] = flat["token"][order], flat["at"][order]
    for name in _DOC.names:
        out[name] = owner[name]
    return out


def _meet(percent: int):
    """Matrix rows of one bucket to the (query, group) pairs that the sizes and places allow."""

    def run(table: pa.Table) -> pa.Table:
        e = _unpack(table)
        e = e[np.lexsort((e["node"], e["chunk"], e["unit"], e["token"]))]
        out = np.zeros(0, np.dtype([("x", "<u8"), ("unit", "<u8"), ("chunk", "<u4")]))
        if len(e):
            # groups under a token: first and last size, first place
            new_token = np.r_[True, e["token"][1:] != e["token"][:-1]]
            new_unit = new_token | np.r_[True, e["unit"][1:] != e["unit"][:-1]]
            new_group = np.flatnonzero(new_unit | np.r_[True, e["chunk"][1:] != e["chunk"][:-1]])
            low, high = np.minimum.reduceat(e["n"], new_group).astype(np.int64), np.maximum.reduceat(e["n"], new_group).astype(np.int64)
            place = np.minimum.reduceat(e["at"], new_group).astype(np.int64)
            g = e[new_group]
            # a document queries the groups of later units under the same token
            group_end = np.searchsorted(np.cumsum(new_token)[new_group], np.cumsum(new_token), side="right")
            unit_first = np.flatnonzero(new_unit)
            unit_of = np.cumsum(new_unit) - 1
            entry_end = np.r_[unit_first[1:], len(e)][unit_of]  # first entry of the next unit
            group_begin = np.searchsorted(new_group, entry_end, side="left")
            span = np.maximum(group_end - group_begin, 0)
            parts, done = [], np.r_[0, np.cumsum(span)]
            a = 0
            while a < len(e):
                b = max(a + 1, int(np.searchsorted(done, done[a] + PAIR_BLOCK, side="right")) - 1)
                k = span[a:b]
                x = np.repeat(np.arange(a, b), k)
                y = np.repeat(group_begin[a:b] - (done[a:b] - done[a]), k) + np.arange(int(k.sum()))
                n, at = e["n"][x].astype(np.int64), e["at"][x].astype(np.int64)
                least, most = np.maximum(low[y], _needed(n, percent)), np.minimum(high[y], 100 * n // percent)
                need = -(-percent * (n + least) // (100 + percent))
                ok = (least <= most) & (np.minimum(n - at, most - place[y]) >= need)
                found = np.empty(int(ok.sum()), out.dtype)
                found["x"], found["unit"], found["chunk"] = e["node"][x[ok]], g["unit"][y[ok]], g["chunk"][y[ok]]
                parts.append(np.unique(found))
                a = b
            out = np.unique(np.concatenate(parts))
        return pa.table({"x": pa.array(out["x"].view(np.int64)), "unit": pa.array(out["unit"].view(np.int64)), "chunk": pa.array(out["chunk"].astype(np.int64))})

    return run


def _verify(percent: int):
    """Members and queries of one group to a link of each query that has one."""

    def run(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy(zero_copy_only=False)
        keys, tokens = table.column("key").to_pylist(), table.column("tokens").to_pylist()
        inside = {keys[k]: np.frombuffer(tokens[k], np.uint64) for k in np.flatnonzero(member)}
        asked = {keys[k]: np.frombuffer(tokens[k], np.uint64) for k in np.flatnonzero(~member)}
        found = []
        if inside and asked:
            names, union = list(inside), Postings(list(inside.values()))
            size = np.array([len(s) for s in inside.values()])
            for key, s in asked.items():
                rows = union.rows(s)
                if len(rows) < _needed(len(s), percent):  # the bound: no member can have more of it than the union
                    continue
                hit = np.flatnonzero(links(union.overlaps(rows), len(s), size, percent))
                if len(hit):
                    found.append((key, names[hit[0]]))
        return pa.table({"u": pa.array([a for a, _ in found], pa.binary()), "v": pa.array([b for _, b in found], pa.binary())})

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the first 8 bytes of key and unit as longs."""
    for batch in batches:
        heads = [pa.array(np.frombuffer(b"".join(k[:8] for k in batch.column(c).to_pylist()), np.int64)) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *heads], names=[*batch.schema.names, "x", "unit8"])


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    return _components(docs, words, percent).drop("th")


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The same with th, the text's hash."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_of(docs)
    rows = docs.select(docs["doc_id"], F.xxhash64(text).alias("th"), text.alias("text"))
    sig = rows.mapInArrow(trimmed(_signatures(words)), f"doc_id {kind}, th long, n long, key binary, mins array<long>, part int, counts binary")
    sig = materialize(sig, "join-signatures")
    listed = sig.where("part IS NULL").select("doc_id", "th", "n", "key", "mins")
    parts = sig.where("part IS NOT NULL").select("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SKETCH_HALVES)).alias("half"), "counts")
    parts = parts.groupBy("part", "half").applyInArrow(_sum_sketch, "part int, half long, counts binary")
    parts = parts.select("part", "counts").groupBy("part").applyInArrow(_sum_sketch, "part int, counts binary")
    held = {r["part"]: bytes(r["counts"]) for r in parts.collect()}  # SKETCH_PARTS rows, 8 MB in all
    if not held:
        return listed.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    sketch = spark.sparkContext.broadcast(b"".join(held[k] for k in range(SKETCH_PARTS)))

    nodes = listed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.first("mins").alias("mins"), F.first("n").alias("n"))
    nodes = materialize(nodes, "join-nodes")

    def grouped_sets(places: DataFrame) -> DataFrame:
        """``places``: th, group, member. The sets are made where the texts are scanned and move once, to their groups."""
        places = places.groupBy("th").agg(F.collect_list(F.struct("group", "member")).alias("places"))
        places = materialize(places, "join-places")
        return rows.join(sized_broadcast(places, places.count() * 2), "th").select("text", "places").mapInArrow(trimmed(_grouped_sets(words)), "group long, member boolean, key binary, tokens binary")

    # a node joins the commonest of its minima; a large group is dealt by salt, and its first node is in every part
    minima = nodes.select("key", "th", "n", F.posexplode("mins").alias("j", "v"))
    shared = minima.groupBy("j", "v").agg(F.count("*").alias("c"), F.min("key").alias("leader"), F.sum("n").alias("tokens")).where("c > 1")
    joined = minima.drop("n").join(shared, ["j", "v"]).groupBy("key", "th").agg(F.max(F.struct("c", "j", "v", "leader", "tokens")).alias("g"))
    parts = _parts_of(F.col("g.c"), F.col("g.tokens"), GROUP_NODES)
    part = F.when(F.col("key") == F.col("g.leader"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), parts)))
    play = joined.select("th", "g", F.explode(part).alias("s")).select("th", F.xxhash64("g.j", "g.v", "s").alias("group"), F.lit(True).alias("member"))
    first = materialize(grouped_sets(play).groupBy("group").applyInArrow(_open_group(percent), "u binary, v binary").distinct(), "join-first")
    units = materialize(components(first), "join-units")
    units = units.join(nodes.select(F.col("key").alias("node"), "n"), "node")
    sizes = units.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    chunk = F.pmod(F.xxhash64("node"), _parts_of(F.col("size"), F.col("tokens"), CHUNK_NODES))
    units = materialize(units.join(sizes, "root").select(F.col("node").alias("key"), F.col("root").alias("unit"), chunk.alias("chunk")), "join-chunks")
    n_units = units.count()
    placed = listed.where("n > 0").select("th", "key").distinct().join(sized_broadcast(units, n_units), "key").select("th", "unit", "chunk")
    placed = materialize(placed, "join-placed")
    units = sized_broadcast(units, n_units)

    tokens = listed.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, tokens * (100 - percent) // 100 // BUCKET_TOKENS)
    dealt = rows.join(sized_broadcast(placed, placed.count()), "th", "left").select("text", "unit", "chunk").mapInArrow(trimmed(_matrix(words, percent, buckets, sketch)), "bucket long, entries binary, docs binary")
    met = dealt.groupBy("bucket").applyInArrow(_meet(percent), "x long, unit long, chunk long")
    met = materialize(met.distinct(), "join-met")

    named = nodes.select("key", "th", "n").join(units, "key", "left").select("key", F.coalesce("unit", "key").alias("unit"), F.coalesce("chunk", F.lit(0)).alias("chunk"), "th", "n")
    named = named.mapInArrow(_keyed, "key binary, unit binary, chunk long, th long, n long, x long, unit8 long")
    named = materialize(named, "join-named")
    groups = met.join(named.select("x", "n"), "x").groupBy("unit", "chunk").agg(_parts_of(F.count("*"), F.sum("n"), CHUNK_QUERIES).alias("salts"))
    groups = materialize(groups, "join-salts")
    groups = sized_broadcast(groups, groups.count(), 24)  # else a unit that many meet would be one key of a join
    asked = met.join(groups, ["unit", "chunk"]).select("x", F.xxhash64("unit", "chunk", F.pmod(F.xxhash64("x"), "salts")).alias("group"))
    asked = asked.join(named.select("x", "th"), "x").select("th", "group", F.lit(False).alias("member"))
    inside = named.join(groups.withColumnRenamed("unit", "unit8"), ["unit8", "chunk"])
    inside = inside.select("unit8", "chunk", "th", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("s"))
    inside = inside.select("th", F.xxhash64("unit8", "chunk", "s").alias("group"), F.lit(True).alias("member"))
    opened = grouped_sets(asked.unionByName(inside))
    second = opened.groupBy("group").applyInArrow(_verify(percent), "u binary, v binary")

    everything = materialize(second.unionByName(first), "join-links")
    final = components(everything)
    least = final.join(nodes.select(F.col("key").alias("node"), "least"), "node")
    least = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("node").alias("key"), "component_id")
    least = nodes.select("key", "least").join(least, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id"))
    least = materialize(least, "join-components")
    return listed.join(least, "key", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the least of their component. A row without doc_id goes if its component has one; rows of one
    doc_id are judged by their own texts."""
    found = materialize(_components(docs, WORDS, PERCENT), "join-result")
    return without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))
