"""One representative fix per stop. Its time is the stop's start; the road id is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import degree_distance

STRATEGIES = ("centroid", "snap_to_nearest", "medoid", "first_point")
_SEG = ("obj_id", "seg_id")


def compress(segmented: DataFrame, strategy: str = "centroid") -> DataFrame:
    """obj_id, seg_id, lat, lon, start_t, end_t, n_points: one row per stop of a segmented table."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown stop strategy {strategy!r}")
    fixes = segmented.where("kind = 'stop'")
    span = [F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n_points")]
    if strategy == "centroid":
        return fixes.groupBy(*_SEG).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), *span)
    place = F.struct("lat", "lon")
    if strategy == "first_point":
        chosen = fixes.groupBy(*_SEG).agg(F.min_by(place, "seq").alias("p"), *span)
    elif strategy == "snap_to_nearest":
        one = Window.partitionBy(*_SEG)
        d = degree_distance(F.col("lat"), F.col("lon"), F.avg("lat").over(one), F.avg("lon").over(one), squared=True)
        chosen = fixes.withColumn("d", d).groupBy(*_SEG).agg(F.min_by(place, F.struct("d", "seq")).alias("p"), *span)
    else:
        # the sum over the stop's fixes of each fix, inside one row per stop: quadratic in a stop as the medoid is, without a join
        held = fixes.groupBy(*_SEG).agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("a"), *span)
        cost = F.transform("a", lambda x: F.struct(F.aggregate("a", F.lit(0.0), lambda s, y: s + degree_distance(x["lat"], x["lon"], y["lat"], y["lon"])).alias("c"), x["seq"].alias("seq"), x["lat"].alias("lat"), x["lon"].alias("lon")))
        chosen = held.select(*_SEG, F.array_min(cost).alias("p"), "start_t", "end_t", "n_points")
    return chosen.select(*_SEG, F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), "start_t", "end_t", "n_points")
