"""The whole online pipeline as a stream against the batch pipeline: late and out-of-order rows, idle objects, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.plans import pipelines
from wayfold.schema import Compression, ReferenceCoding
from wayfold.sources.points import from_events
from wayfold.streaming.online_stream import online_stream

D = "/root/testdata/sf0.001"
CONFIGS = {"geometric": Compression(capacity=8), "network": Compression(strategy="network_semantic", coding=ReferenceCoding(gamma=3.8))}


def canonical(rows):
    return sorted((r.obj_id, r.seg_id, r.kind, round(r.start_t, 6), round(r.end_t, 6), r.encoded_bytes, tuple(tuple(round(x, 9) for x in k) for k in r.keypoints)) for r in rows)


def drain(spark, tmp_path, schema, config, name, **options):
    """All that the files so far give; state and output stay for the next call."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = online_stream(stream, config, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
        return q.recentProgress
    finally:
        q.stop()


def put(frame, tmp_path, k):
    frame.coalesce(1).write.parquet(str(tmp_path / f"in/{k:02}"))


@pytest.mark.parametrize("name", CONFIGS)
def test_stream_equals_batch(spark, tmp_path, name):
    config = CONFIGS[name]
    p = from_events(spark, D).withColumn("t", F.col("t") + 1_700_000_000).cache()  # a stream starts with a watermark of 0
    lo, hi = p.agg(F.min("t"), F.max("t")).first()
    cut = [lo + (hi - lo) * k / 3 for k in range(4)]
    rng = random.Random(1)
    for k in range(3):  # within a file rows come in any order
        put(p.where((F.col("t") >= cut[k]) & ((F.col("t") < cut[k + 1]) if k < 2 else F.lit(True))).orderBy(F.xxhash64("seq", F.lit(rng.random()))), tmp_path, k)
        if k == 1:
            drain(spark, tmp_path, p.schema, config, name, delay_s=30, idle_s=2 * (hi - lo))  # stops here, and goes on from the checkpoint
    far = p.limit(1).select(F.lit("zz").alias("obj_id"), "seq", "lat", "lon", F.lit(hi + 10 * (hi - lo)).alias("t"), "road_id")
    put(far, tmp_path, 3)
    put(far.withColumn("seq", F.lit(99).cast("long")).withColumn("t", F.col("t") + 1), tmp_path, 4)
    progress = drain(spark, tmp_path, p.schema, config, name, delay_s=30, idle_s=2 * (hi - lo))
    got = spark.read.parquet(str(tmp_path / "out")).where("obj_id <> 'zz'")
    want = pipelines.online(p, config)
    assert canonical(got.collect()) == canonical(want.collect())
    assert sum(o["numRowsDroppedByWatermark"] for x in progress for o in x["stateOperators"]) == 0
    assert got.agg(F.sum("n_points")).first()[0] == p.count()


def test_idle_objects_end_and_late_rows_are_dropped(spark, tmp_path):
    schema = "obj_id string, seq long, lat double, lon double, t double, road_id string"
    track = lambda obj, start, n, t0: spark.createDataFrame([(obj, i, 0.0, 0.001 * i, float(t0 + 10 * i), "r") for i in range(start, start + n)], schema)
    put(track("a", 0, 5, 1000).unionByName(track("b", 0, 5, 1000)), tmp_path, 0)
    put(track("b", 5, 60, 1000), tmp_path, 1)  # the watermark passes a's silence
    put(track("b", 65, 2, 1000), tmp_path, 2)
    put(track("a", 5, 3, 1000).unionByName(track("b", 67, 2, 1000)), tmp_path, 3)  # too late by far for a
    put(track("a", 900, 4, 1000).unionByName(spark.createDataFrame([(None, 1, 0.0, 0.0, 1.0, "r"), ("a", 1, None, 0.0, 1.0, "r")], schema)), tmp_path, 4)  # b ends, a begins anew
    put(track("c", 1000, 1, 1000), tmp_path, 5)
    put(track("c", 2000, 1, 1000), tmp_path, 6)
    progress = drain(spark, tmp_path, spark.createDataFrame([], schema).schema, Compression(), "idle", delay_s=20, idle_s=100)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.obj_id, r.seg_id, r.n_points) for r in rows if r.obj_id != "c") == [("a", 0, 4), ("a", 0, 5), ("b", 0, 69)]
    assert sum(o["numRowsDroppedByWatermark"] for x in progress for o in x["stateOperators"]) == 3


def test_what_the_stream_refuses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("obj_id string, seq long, lat double, lon double, t double, road_id string").parquet(str(tmp_path / "in"))
    for config in (Compression(stop_strategy="medoid"), Compression(strategy="network_semantic", map_matching=True)):
        with pytest.raises(ValueError):
            online_stream(stream, config)
