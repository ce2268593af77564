"""Whole pipelines: segmentation, stop and move compression, reconstruction and metrics over all objects at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import kernels, metrics, moves, segmentation, stops
from wayfold.operators.segmentation import arrays, ordered
from wayfold.schema import BYTES_PER_POINT, XI, Compression


def compress_segments(segmented: DataFrame, config: Compression) -> DataFrame:
    """obj_id, seg_id, kind, start_t, end_t, keypoints array<struct<t,lat,lon>>, encoded_bytes: one row per segment."""
    key = F.struct("t", "lat", "lon")
    if config.compress_stops:
        reps = stops.compress(segmented, config.stop_strategy)
        held = reps.select("obj_id", "seg_id", F.lit("stop").alias("kind"), "start_t", "end_t", F.array(F.struct(F.col("start_t").alias("t"), "lat", "lon")).alias("keypoints"), F.lit(BYTES_PER_POINT).cast("long").alias("encoded_bytes"))
    else:
        held = _collect(segmentation.stops(segmented), key)
    moving = segmentation.moves(segmented)
    if config.strategy == "geometric":
        kept = moves.chain_simplify(moving, moves.PER_SEGMENT, config.capacity, config.dp_epsilon_m)
        return held.unionByName(_collect(kept, key))
    kept = _collect(moves.retained_points(moving, moves.PER_SEGMENT, config.coding), key).drop("encoded_bytes")
    coded = moves.referential_coding(moving, config.coding).select("obj_id", "seg_id", "encoded_bytes")
    return held.unionByName(kept.join(coded, ["obj_id", "seg_id"]))


def segment_rows(marked: DataFrame) -> DataFrame:
    """One row per segment of points with ``keep``: obj_id, seg_id, kind, start_t, end_t, lat, lon (centroid), kept (timed points of a move)."""
    point = F.when(F.col("keep"), F.struct("t", "lat", "lon"))  # collect_list leaves nulls out
    return marked.groupBy("obj_id", "seg_id", "kind").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.array_sort(F.collect_list(point)).alias("kept"))


def reconstruction(rows: DataFrame) -> DataFrame:
    """Timed points of ``segment_rows`` with ``stored``: a stop at its start and at its end, stored once; moves as kept."""
    at = lambda t, n: F.struct(F.col(t).alias("t"), "lat", "lon", F.lit(n).alias("stored"))
    kept = F.transform("kept", lambda k: F.struct(k["t"].alias("t"), k["lat"].alias("lat"), k["lon"].alias("lon"), F.lit(1).alias("stored")))
    points = F.when(F.col("kind") == "stop", F.array(at("start_t", 1), at("end_t", 0))).otherwise(kept)
    return rows.select("obj_id", F.explode(points).alias("p")).select("obj_id", "p.*")


def _collect(points: DataFrame, key) -> DataFrame:
    grouped = points.groupBy("obj_id", "seg_id", "kind").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.transform(F.array_sort(F.collect_list(F.struct("seq", key.alias("k")))), lambda x: x["k"]).alias("keypoints"))
    return grouped.withColumn("encoded_bytes", F.size("keypoints").cast("long") * BYTES_PER_POINT)


def check(config: Compression, edges: DataFrame | None = None) -> None:
    if config.strategy == "network_semantic" and config.map_matching and edges is None:
        raise ValueError("map matching needs a road graph")


def online(points: DataFrame, config: Compression | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Online pipeline: (matching,) stay points, stops to one fix, moves simplified or coded."""
    config = config or Compression()
    check(config, edges)
    if config.map_matching and config.strategy == "network_semantic":
        from wayfold.operators.matching import match

        points = match(points, nodes, edges)
    if config.strategy == "geometric" and config.compress_stops and config.stop_strategy == "centroid":
        rows = segment_rows(segmentation.kept_segments(points, *_online_kernels(config)))
        stop = F.array(F.struct(F.col("start_t").alias("t"), "lat", "lon"))
        rows = rows.withColumn("keypoints", F.when(F.col("kind") == "stop", stop).otherwise(F.col("kept")))
        return rows.select("obj_id", "seg_id", "kind", "start_t", "end_t", "keypoints", (F.size("keypoints").cast("long") * BYTES_PER_POINT).alias("encoded_bytes"))
    return compress_segments(segmentation.stay_points(points, config.stop_distance_m, config.stop_duration_s), config)


def _online_kernels(config: Compression):
    """Segmentation of an object and simplification of a move, for one pass over each object."""
    return (
        lambda lat, lon, t: kernels.stay_segments(lat, lon, t, config.stop_distance_m, config.stop_duration_s),
        lambda lat, lon, t, road: kernels.chained(lat, lon, t, config.capacity, config.dp_epsilon_m),
    )


def _offline_kernels(config: Compression, min_samples: int, backend: str, simplify):
    return lambda lat, lon, t: kernels.density_segments(lat, lon, t, config.stop_distance_m, config.stop_duration_s, min_samples, backend, XI), simplify


def offline_evaluation(points: DataFrame, config: Compression | None = None, min_samples: int = 15, backend: str = "optics", network: bool = False) -> DataFrame:
    """Metric records of the offline pipelines, geometric or by road changes, in one pass over each object."""
    config = config or Compression()
    simplify = (lambda lat, lon, t, road: kernels.road_change_places(road)) if network else (lambda lat, lon, t, road: kernels.douglas_peucker(lat, lon, config.dp_epsilon_m))
    marked = segmentation.kept_segments(points, *_offline_kernels(config, min_samples, backend, simplify))
    return metrics.evaluation(points, reconstruction(segment_rows(marked)))


def offline_geometric(points: DataFrame, config: Compression | None = None, min_samples: int = 15, backend: str = "optics") -> tuple[DataFrame, DataFrame]:
    """Offline pipeline: density segments; stops and line-simplified moves."""
    config = config or Compression()
    seg = segmentation.density_segments(points, config.stop_distance_m, config.stop_duration_s, min_samples, backend)
    return stops.compress(seg, config.stop_strategy), moves.line_simplify(segmentation.moves(seg), moves.PER_SEGMENT, config.dp_epsilon_m)


def offline_network(points: DataFrame, config: Compression | None = None, min_samples: int = 15, backend: str = "optics", nodes: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Offline pipeline on roads: density segments; stops and road changes of each move (matched per move, if a graph is given)."""
    config = config or Compression()
    seg = segmentation.density_segments(points, config.stop_distance_m, config.stop_duration_s, min_samples, backend)
    moving = segmentation.moves(seg)
    if edges is not None:
        from wayfold.operators.matching import match

        moving = match(moving, nodes, edges, keys=moves.PER_SEGMENT)
    return stops.compress(seg, config.stop_strategy), moves.road_changes(moving, moves.PER_SEGMENT)


def stop_only(segmented: DataFrame, strategy: str = "centroid") -> tuple[DataFrame, DataFrame]:
    """Stops to one fix, moves as they are."""
    return stops.compress(segmented, strategy), segmentation.moves(segmented)


def keypoints(results: DataFrame) -> DataFrame:
    """obj_id, seg_id, kind, t, lat, lon of all results."""
    return results.select("obj_id", "seg_id", "kind", F.explode("keypoints").alias("k")).select("obj_id", "seg_id", "kind", "k.t", "k.lat", "k.lon")


def trajectory_results(points: DataFrame, results: DataFrame) -> DataFrame:
    """Per object: points, bytes, ratio, stops and moves."""
    n = points.groupBy("obj_id").agg(F.count("*").alias("original_points"))
    r = results.groupBy("obj_id").agg(F.sum("encoded_bytes").alias("encoded_bytes"), F.sum(F.size("keypoints")).alias("stored_points"), F.sum(F.when(F.col("kind") == "stop", 1).otherwise(0)).alias("stops"), F.sum(F.when(F.col("kind") == "move", 1).otherwise(0)).alias("moves"))
    joined = n.join(r, "obj_id", "left").fillna(0)
    return joined.withColumn("original_bytes", F.col("original_points") * BYTES_PER_POINT).withColumn("compression_ratio", metrics.byte_ratio(F.col("original_points"), F.col("encoded_bytes")))


def stored_counts(stop_rows: DataFrame, move_points: DataFrame) -> DataFrame:
    """obj_id, n: one per stop and one per kept move point."""
    return stop_rows.select("obj_id").unionByName(move_points.select("obj_id")).groupBy("obj_id").agg(F.count("*").alias("n"))


ABLATION = ("full_line", "full_buffer", "full_hybrid", *(f"{side}_{name}" for side in ("offline", "online") for name in ("none", "line", "buffer", "hybrid", "hybrid_refined") if (side, name) != ("online", "none")))


def ablation(points: DataFrame, config: Compression | None = None, min_samples: int = 5, backend: str = "manual") -> DataFrame:
    """Twelve variants in one table (variant, obj_id, metrics): three on whole runs, five offline, four online.

    One pass over each object segments it once per side and gives the timed points of every variant.
    """
    c = config or Compression(capacity=10)
    simplify = {
        "none": lambda lat, lon, t: np.arange(len(t)),
        "line": lambda lat, lon, t: kernels.douglas_peucker(lat, lon, c.dp_epsilon_m),
        "buffer": lambda lat, lon, t: kernels.squish(lat, lon, t, c.capacity),
        "hybrid": lambda lat, lon, t: kernels.hybrid(lat, lon, t, c.capacity, c.dp_epsilon_m),
        "hybrid_refined": lambda lat, lon, t: kernels.hybrid(lat, lon, t, c.capacity, c.dp_epsilon_m, True),
    }

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        lat, lon, t = arrays(table, "lat", "lon", "t")
        sides = {
            "full": [(0, len(t) - 1, False)],
            "offline": kernels.density_segments(lat, lon, t, c.stop_distance_m, c.stop_duration_s, min_samples, backend, XI),
            "online": kernels.stay_segments(lat, lon, t, c.stop_distance_m, c.stop_duration_s),
        }
        rows: list[tuple] = []
        for variant in ABLATION:
            side, name = variant.split("_", 1)
            for a, b, stop in sides[side]:
                if stop:
                    y, x = float(lat[a : b + 1].mean()), float(lon[a : b + 1].mean())
                    rows += [(variant, t[a], y, x, 1), (variant, t[b], y, x, 0)]
                else:
                    kept = a + simplify[name](lat[a : b + 1], lon[a : b + 1], t[a : b + 1])
                    rows += zip([variant] * len(kept), t[kept], lat[kept], lon[kept], [1] * len(kept))
        cols = list(zip(*rows))
        obj = pa.array([table.column("obj_id")[0].as_py()] * len(rows), pa.string())
        return pa.table([pa.array(cols[0], pa.string()), obj, *(pa.array(x, pa.float64()) for x in cols[1:4]), pa.array(cols[4], pa.int32())], names=["variant", "obj_id", "t", "lat", "lon", "stored"])

    timed = points.groupBy("obj_id").applyInArrow(run, "variant string, obj_id string, t double, lat double, lon double, stored int")
    raw = points.withColumn("variant", F.explode(F.array(*map(F.lit, ABLATION))))
    return metrics.evaluation(raw, timed, ("variant", "obj_id"))
