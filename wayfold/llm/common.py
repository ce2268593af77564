"""Shared plumbing of the corpus operators: scratch tables, word rules and row removal."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space, tab, newline, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
#: Bytes up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

_paths: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset a session on one machine gets a local one; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/wayfold"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared scratch folder and read it back.

    The table survives lost executors, because it is on shared storage and not in an executor's cache.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _paths:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            return  # the session has ended


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(df[col], F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_broadcast(df: DataFrame, rows: int, row_bytes: int = 16) -> DataFrame:
    """Broadcast hint for a table of ``rows`` counted rows of about ``row_bytes`` bytes each, if within BROADCAST_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def broadcast_by_bytes(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast hint for a written table whose rows' ``size`` sums to no more than BROADCAST_BYTES."""
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes to clash with no column of ``docs``, letter case aside."""
    taken, lead = {c.lower() for c in docs.columns}, "_"
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def with_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """``docs`` left_semi or left_anti ``ids`` (a materialised table of one id column ``key``); nulls equal each other."""
    (own,) = fresh(docs, "id")
    named = ids.select(F.col(key).alias(own))
    return docs.join(sized_broadcast(named, ids.count()), docs[key].eqNullSafe(F.col(own)), how)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``gone`` names by doc_id and th (xxhash64 of the text); null ids equal each other."""
    own, th = fresh(docs, "id", "th")
    named = materialize(gone.select(F.col("doc_id").alias(own), F.col("th").alias(th)).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(F.col(own)) & (F.xxhash64(text_of(docs)) == F.col(th))
    return docs.join(sized_broadcast(named, named.count()), same, "left_anti")


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows; what is made from a part can be freed before the next."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def trim() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, and then what its task has freed goes back to the system: workers outlive their tasks, and idle ones count too."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole
