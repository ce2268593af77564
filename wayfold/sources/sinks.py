"""Sinks: point and segment files, metric records and bundles, graph tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUNDLE_SCHEMA = "trajectory-eval-contract-v1"


def _time(c):
    return F.date_format(F.timestamp_micros((F.col(c) * 1_000_000).cast("long")), "yyyy-MM-dd HH:mm:ss")


def write_points(points: DataFrame, path: str, roads: bool = False) -> None:
    """lat, lon, time (and road_id)."""
    points.select("lat", "lon", _time("t").alias("time"), *(["road_id"] if roads else [])).write.option("header", True).csv(path)


def write_compressed(stops: DataFrame, moves: DataFrame, path: str) -> None:
    """Stops and kept move points: type, lat, lon, start_time, end_time."""
    s = stops.select("obj_id", F.lit("STOP").alias("type"), "lat", "lon", _time("start_t").alias("start_time"), _time("end_t").alias("end_time"))
    m = moves.select("obj_id", F.lit("MOVE").alias("type"), "lat", "lon", _time("t").alias("start_time"), _time("t").alias("end_time"))
    s.unionByName(m).write.option("header", True).csv(path)


def write_road_changes(points: DataFrame, path: str) -> None:
    points.select("lat", "lon", _time("t").alias("time"), "road_id", F.lit("CHUNK_START").alias("type")).write.option("header", True).csv(path)


def write_keypoints(keypoints: DataFrame, path: str, strategy: str) -> None:
    """One folder per strategy and object."""
    keypoints.withColumn("strategy", F.lit(strategy)).write.partitionBy("strategy", "obj_id").option("header", True).csv(path)


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities become nulls."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[F.when(~bad(F.col(f.name)), F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def write_metrics_json(records: DataFrame, path: str) -> None:
    """One JSON object per row."""
    clean(records).select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_metrics_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def evaluation_bundle(records: DataFrame, aggregate: DataFrame, run_config: dict) -> DataFrame:
    """part, value: one JSON text per row. A header with the schema's name and the run's configuration, one row per object
    (obj_id, n_raw_points, pipelines with their metrics), and one per row of the aggregate."""
    per = clean(records).groupBy("obj_id", "n_raw_points", "pipeline").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    per = per.groupBy("obj_id", "n_raw_points").agg(F.map_from_entries(F.collect_list(F.struct("pipeline", "m"))).alias("pipelines"))
    head = records.sparkSession.createDataFrame([("header", json.dumps({"schema": BUNDLE_SCHEMA, "run_config": {str(k): str(v) for k, v in run_config.items()}}))], "part string, value string")
    rows = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("value"))
    return head.unionByName(rows(per, "per_file")).unionByName(rows(clean(aggregate), "aggregate"))


def put_batch(records: DataFrame, number: int, path: str) -> None:
    """One micro-batch of metric records as JSON lines in a folder of its number; the same number again replaces what it wrote before."""
    clean(records).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")


def stream_metrics_json(records: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """A stream of metric records to ``path``, one JSON object a line. A micro-batch that is run again after a failure is written once: its
    number names its folder, and the checkpoint keeps numbers and rows together."""
    writer = records.writeStream.foreachBatch(lambda frame, number: put_batch(frame, number, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_bundle(segments: DataFrame, path: str, checkpoint: str, run_config: dict, available_now: bool = False) -> StreamingQuery:
    """The evaluation bundle of a stream of segments (``online_stream``): for each micro-batch the header and a row per object with
    what closed in it: segments, points, stored keypoints and bytes. Sums over micro-batches are those of the whole."""

    def put(frame: DataFrame, number: int) -> None:
        per = frame.groupBy("obj_id").agg(F.count("*").alias("segments"), F.sum("n_points").alias("n_raw_points"), F.sum(F.size("keypoints")).alias("stored_points"), F.sum("encoded_bytes").alias("encoded_bytes"))
        head = frame.sparkSession.createDataFrame([("header", json.dumps({"schema": BUNDLE_SCHEMA, "run_config": {str(k): str(v) for k, v in run_config.items()}}))], "part string, value string")
        rows = head.unionByName(clean(per).select(F.lit("per_file").alias("part"), F.to_json(F.struct("*")).alias("value")))
        rows.write.mode("overwrite").json(f"{path}/batch={number}")

    writer = segments.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Node and edge tables as Parquet, and a metadata record beside them: nodes, edges and bytes."""
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
    spark = nodes.sparkSession
    size = sum(spark.read.format("binaryFile").load(f"{path}/{x}").agg(F.sum("length")).first()[0] or 0 for x in ("nodes", "edges"))
    found = {"nodes": spark.read.parquet(f"{path}/nodes").count(), "edges": spark.read.parquet(f"{path}/edges").count(), "bytes": int(size)}
    spark.createDataFrame([(json.dumps(found),)], "value string").write.text(f"{path}/metadata")
    return found


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
