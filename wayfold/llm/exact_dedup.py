"""Exact dedup: counting quotient filters per partition, merged by sorted remainders, then byte verification.

``duplicate_classes(docs)`` decides for every row; ``drop_duplicates(docs)`` keeps one row of each class.

Plan: (1) one scan hashes each normalised text and keeps ids and hashes only; (2) every partition packs its
fingerprints into counting quotient filters, cut into blocks of the fingerprint space, and the blocks of all
partitions merge (a fingerprint crosses the network once per partition, however many copies it has);
(3) fingerprints with a count above one select the texts whose bytes are compared, by a partially aggregated
grouping on the text itself; (4) the verified classes join back to the ids. Unique texts never move.

Defined results: a null text counts as empty, and empty texts equal each other; a null doc_id sorts first; rows that
repeat doc_id and text are separate rows of one class, of which the first written stays; an empty table gives no rows;
extra columns are ignored here and kept by ``drop_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import WS, fresh, materialize, sized_broadcast, text_of, with_ids
from wayfold.llm.quotient_filter import CountingQuotientFilter

#: Fingerprints packed into one filter before it is emitted: bounds a task's memory, loses nothing.
FILTER_ROWS = 1_000_000
#: Distinct fingerprints aimed at in one merged block.
BLOCK_ROWS = 65_536

_BLOCKS = "block long, occupied binary, runends binary, remainders binary, counts binary"


def normalised(text: Column) -> Column:
    """Runs of white space become one space; texts are equal when these are."""
    return F.regexp_replace(text, WS, " ")


def _pack(block_bits: int, bits: int):
    """Arrow batches of fingerprints to one row per filter block."""
    q = max(0, min(14, bits - block_bits - 1))

    def blocks(values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(values), return_counts=True)
        low = bits - block_bits
        home = (keys >> np.uint64(low)).astype(np.int64) if block_bits else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            inner = keys[a:b] & np.uint64((1 << low) - 1)
            rows.append((int(home[a]), *CountingQuotientFilter.build(inner, q, counts[a:b].astype(np.int64), low).to_bytes()))
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["block", "occupied", "runends", "remainders", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append(values >> np.uint64(64 - bits) if bits < 64 else values)
            n += len(values)
            if n >= FILTER_ROWS:
                yield from blocks(held)
                held, n = [], 0
        if n:
            yield from blocks(held)

    return run


def _merge(block_bits: int, bits: int):
    """The filters of one block to its repeated fingerprints."""
    q = max(0, min(14, bits - block_bits - 1))

    def run(table: pa.Table) -> pa.Table:
        low = bits - block_bits
        parts = zip(*(table.column(c).to_pylist() for c in ("occupied", "runends", "remainders", "counts")))
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(q, p, low) for p in parts], q, low)
        keys, counts = merged.items()
        block = table.column("block")[0].as_py()
        keys = keys | np.uint64(block << low) if block_bits else keys
        many = counts > 1
        return pa.table({"fp": pa.array(keys[many].view(np.int64)), "n": pa.array(counts[many])})

    return run


def repeated_fingerprints(light: DataFrame, rows: int, bits: int = 64) -> DataFrame:
    """Fingerprints of ``light.fp`` that occur more than once, by merged counting quotient filters."""
    block_bits = min(24, max(0, bits - 16, 0), max(0, (max(1, rows) // BLOCK_ROWS).bit_length()))
    packed = light.select("fp").mapInArrow(_pack(block_bits, bits), _BLOCKS)
    return packed.groupBy("block").applyInArrow(_merge(block_bits, bits), "fp long, n long")


def _hashed(docs: DataFrame) -> DataFrame:
    norm = normalised(text_of(docs))
    return docs.select(docs["doc_id"], norm.alias("norm"), F.xxhash64(norm).alias("fp"), F.sha2(norm, 256).alias("sha"))


def duplicate_classes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. ``bits``: fingerprint width (small in tests)."""
    hashed = _hashed(docs)
    light = materialize(hashed.select("doc_id", "fp", "sha", F.monotonically_increasing_id().alias("row")), "exact-light")
    cut = F.col("fp") if bits == 64 else F.shiftrightunsigned("fp", 64 - bits)
    repeated = materialize(repeated_fingerprints(light, light.count(), bits).select("fp"), "exact-fps")
    repeated = sized_broadcast(repeated.select(F.col("fp").alias("cut")), repeated.count())
    # byte verification: the grouping key is the text; a class counts only if its texts are byte for byte the same
    texts = hashed.withColumn("cut", cut).join(repeated, "cut", "left_semi").groupBy("sha", "norm").agg(F.count("*").alias("n"))
    verified = texts.groupBy("sha").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where("n > 1")
    verified = verified.select("sha", F.when(F.col("texts") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).alias("same"))
    first = F.min(F.struct("doc_id", "row")).alias("first")
    groups = light.groupBy("sha").agg(first, F.count("*").alias("n")).where("n > 1").join(verified, "sha").where("same")
    groups = materialize(groups.select("sha", "first", "n"), "exact-groups")
    joined = light.join(sized_broadcast(groups, groups.count() * 4), "sha", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    classes = materialize(duplicate_classes(docs), "exact-classes")
    gone = materialize(classes.where("not kept").select("doc_id", "text_sha256").distinct(), "exact-gone")
    also = classes.where("kept").select("doc_id", "text_sha256")
    twice = materialize(with_ids(gone, also.select("doc_id"), "left_semi").select("doc_id").distinct(), "exact-twice")
    kept = with_ids(docs, materialize(with_ids(gone, twice, "left_anti").select("doc_id").distinct(), "exact-ids"), "left_anti")
    if twice.isEmpty():
        return kept
    # an id that both stays and goes is an id on several rows: those few rows are settled by their text
    rows = with_ids(docs, twice, "left_semi")
    own, hashed, sha = fresh(docs, "id", "t", "sha")
    stay = also.select(F.col("doc_id").alias(own), F.col("text_sha256").alias(hashed))
    rows = rows.withColumn(sha, F.sha2(normalised(text_of(rows)), 256))
    chosen = rows.join(stay, rows["doc_id"].eqNullSafe(F.col(own)) & (F.col(sha) == F.col(hashed)), "left_semi").dropDuplicates(["doc_id", sha])
    return with_ids(kept, twice, "left_anti").unionByName(chosen.drop(sha))
