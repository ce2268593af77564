"""Registered queries that run as streams over the given tables. Importing it adds them to the registry.

Points are written to the shared folder in order of time, a few folders one after the other, and played from there; a last fix of an object that no
table has moves the watermark past every other object's end.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.plans import network, pipelines  # noqa: F401  (network's SQL comes first)
from wayfold.plans import registry as r
from wayfold.plans.registry import CAPACITY, _micros, _query
from wayfold.schema import Compression
from wayfold.sources.points import from_events
from wayfold.streaming.online_stream import online_stream

FOLDERS, BEGIN, LAST = 3, 1_700_000_000, "\U0010ffff"


def shared_folder(spark: SparkSession) -> str:
    """A new folder where spark.checkpoint.dir says; on one machine that names none, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/wayfold"
    return f"{root}/stream-{uuid.uuid4().hex}"


def played(spark: SparkSession, points: DataFrame, config: Compression) -> DataFrame:
    """The segments of ``points`` as the online stream gives them."""
    folder = shared_folder(spark)
    # a stream starts with a watermark at 0; each folder takes its share of the same points, which are made once
    moved = points.withColumn("t", F.col("t") + BEGIN).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lo, hi = moved.agg(F.min("t"), F.max("t")).first()
        if lo is None:
            return pipelines.online(points, config)
        step = (hi - lo) / FOLDERS + 1
        for k in range(FOLDERS):
            moved.where((F.col("t") >= lo + k * step) & (F.col("t") < lo + (k + 1) * step)).write.parquet(f"{folder}/in/{k}")
        idle = 2 * (hi - lo) + 60
        for k in (0, 1):  # the second one comes when the first has moved the watermark
            end = moved.limit(1).select(F.lit(LAST).alias("obj_id"), "seq", "lat", "lon", F.lit(hi + 4 * idle + 4 * step + k).alias("t"), "road_id")
            end.write.parquet(f"{folder}/in/{FOLDERS + k}")
    finally:
        moved.unpersist()
    stream = spark.readStream.schema(moved.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 16).parquet(f"{folder}/in")
    out = online_stream(stream, config, delay_s=step + 1, idle_s=idle).where(F.col("obj_id") != LAST)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@_query("p3_online_stream", r.ORACLES[r.FLAGSHIP])
def p3_online_stream(spark: SparkSession, d: str) -> DataFrame:
    """The geometric pipeline's summary from its stream."""
    p = from_events(spark, d)
    return _micros(pipelines.trajectory_results(p, played(spark, p, Compression(capacity=CAPACITY))))


@_query("p5_online_stream", r.ORACLES["p5_network_stored"])
def p5_online_stream(spark: SparkSession, d: str) -> DataFrame:
    """The network pipeline's summary from its stream, but for the coded bytes."""
    p = from_events(spark, d)
    found = pipelines.trajectory_results(p, played(spark, p, Compression(strategy="network_semantic")))
    return _micros(found.drop("encoded_bytes", "compression_ratio"))
