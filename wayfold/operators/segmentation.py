"""Stop and move segmentation. One shuffle on obj_id; kernels only where a fix depends on the outcome of earlier ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import kernels
from wayfold.schema import MIN_SAMPLES, POINT_COLUMNS, POINTS, SEGMENTED, STOP_DISTANCE_M, STOP_DURATION_S, XI

BACKENDS = ("manual", "optics")


def by_object():
    return Window.partitionBy("obj_id").orderBy("seq")


def arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("seq")


def _segmented(table: pa.Table, segments: list[tuple[int, int, bool]]) -> pa.Table:
    sizes = [b - a + 1 for a, b, _ in segments]
    seg = np.repeat(np.arange(len(segments)), sizes)
    kind = np.repeat(np.array(["stop" if s else "move" for *_, s in segments], object), sizes)
    return table.append_column("seg_id", pa.array(seg, pa.int64())).append_column("kind", pa.array(kind, pa.string()))


def stay_points(points: DataFrame, eps: float = STOP_DISTANCE_M, min_s: float = STOP_DURATION_S, grid: float | None = None) -> DataFrame:
    """Online stay-point segmentation: points with seg_id and kind. Segments tile each object's history. ``grid``: metres of the cells by
    which most distances are settled without being computed."""

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        return _segmented(table, kernels.stay_segments(*arrays(table, "lat", "lon", "t"), eps, min_s, grid))

    return points.select(*POINT_COLUMNS).groupBy("obj_id").applyInArrow(run, SEGMENTED)


def kept_segments(points: DataFrame, segment, choose) -> DataFrame:
    """Points with seg_id, kind and ``keep`` from one pass over each object: ``segment(lat, lon, t)`` gives the segments,
    ``choose(lat, lon, t, road_id)`` the places in a move that stay; ``keep`` is false in stops."""

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        lat, lon, t = arrays(table, "lat", "lon", "t")
        road, found = table.column("road_id").to_pylist(), segment(lat, lon, t)
        keep = np.zeros(len(t), bool)
        for a, b, stop in found:
            if not stop:
                keep[a + np.asarray(choose(lat[a : b + 1], lon[a : b + 1], t[a : b + 1], road[a : b + 1]))] = True
        return _segmented(table, found).append_column("keep", pa.array(keep))

    return points.select(*POINT_COLUMNS).groupBy("obj_id").applyInArrow(run, SEGMENTED + ", keep boolean")


def min_samples_for(seconds) -> Column:
    """Samples that make a core: half the dwell seconds, halves to even, at least 5."""
    return F.greatest(F.lit(5), F.rint(F.lit(seconds) * 0.5 if not isinstance(seconds, Column) else seconds * 0.5).cast("int"))


def density_clusters(points: DataFrame, eps: float = STOP_DISTANCE_M, min_samples: int = MIN_SAMPLES, backend: str = "manual", xi: float = XI) -> DataFrame:
    """Points with ``label``: clusters by density ('manual') or by the reachability plot ('optics'); -1 is noise."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}")

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        lat, lon = arrays(table, "lat", "lon")
        labels = kernels.cluster_labels(lat, lon, eps, min_samples, backend, xi)
        return table.append_column("label", pa.array(labels, pa.int64()))

    return points.select(*POINT_COLUMNS).groupBy("obj_id").applyInArrow(run, POINTS + ", label long")


def label_runs(labelled: DataFrame) -> DataFrame:
    """Runs of equal labels become segments: noise moves, clusters stops (two for an interrupted cluster)."""
    changed = F.when(F.col("label") == F.lag("label").over(by_object()), 0).otherwise(1)
    seg = F.sum(changed).over(by_object()) - 1
    return labelled.withColumn("seg_id", seg.cast("long")).withColumn("kind", F.when(F.col("label") == -1, "move").otherwise("stop"))


def post_process(segmented: DataFrame, min_s: float = STOP_DURATION_S) -> DataFrame:
    """Stops shorter than ``min_s`` become moves, then adjacent moves merge; adjacent stops do not."""
    one = Window.partitionBy("obj_id", "seg_id")
    short = F.max("t").over(one) - F.min("t").over(one) < min_s
    kept = segmented.withColumn("kind", F.when((F.col("kind") == "stop") & ~short, "stop").otherwise("move"))
    same = (F.col("seg_id") == F.lag("seg_id").over(by_object())) | ((F.col("kind") == "move") & (F.lag("kind").over(by_object()) == "move"))
    return kept.withColumn("seg_id", (F.sum(F.when(same, 0).otherwise(1)).over(by_object()) - 1).cast("long"))


def density_segments(points: DataFrame, eps: float = STOP_DISTANCE_M, min_s: float = STOP_DURATION_S, min_samples: int = MIN_SAMPLES, backend: str = "optics") -> DataFrame:
    """Offline segmentation: clusters, their runs, short stops dissolved; in one pass over each object."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}")

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        return _segmented(table, kernels.density_segments(*arrays(table, "lat", "lon", "t"), eps, min_s, min_samples, backend, XI))

    return points.select(*POINT_COLUMNS).groupBy("obj_id").applyInArrow(run, SEGMENTED)


def segments(segmented: DataFrame) -> DataFrame:
    """One row per segment: obj_id, seg_id, kind, start_t, end_t, n_points."""
    return segmented.groupBy("obj_id", "seg_id", "kind").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n_points"))


def stops(segmented: DataFrame) -> DataFrame:
    return segmented.where("kind = 'stop'")


def moves(segmented: DataFrame) -> DataFrame:
    return segmented.where("kind = 'move'")
