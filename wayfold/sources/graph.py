"""Road graphs as two tables: nodes (node_id, lat, lon) and edges (u, v, key, osmid array<string>, geometry array<struct<lat,lon>>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.geo import bounding_box


def _line(wkt: Column) -> Column:
    """array<struct<lat, lon>> of a LINESTRING in well-known text; null without one."""
    pairs = F.split(F.trim(F.regexp_extract(wkt, r"LINESTRING\s*\(([^)]*)\)", 1)), r"\s*,\s*")
    point = lambda p: F.struct(F.get(F.split(p, r"\s+"), 1).cast("double").alias("lat"), F.get(F.split(p, r"\s+"), 0).cast("double").alias("lon"))
    return F.when(F.upper(wkt).startswith("LINESTRING"), F.transform(pairs, point))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file with data keys named y, x and osmid (or keys declared under such names)."""
    keys = spark.read.format("xml").option("rowTag", "key").load(path)
    names = {r["_id"]: r["_attr.name"] for r in keys.collect()}  # the declarations, a dozen rows
    data = "data array<struct<_key:string,_VALUE:string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, _id string, {data}").load(path)

    def cell(name: str):
        ids = [k for k, v in names.items() if v == name] or [name]
        return F.get(F.filter("data", lambda d: d["_key"].isin(*ids)), 0)["_VALUE"]

    nodes = nodes.select(F.col("_id").alias("node_id"), cell("y").cast("double").alias("lat"), cell("x").cast("double").alias("lon"))
    osmid = F.split(F.regexp_replace(cell("osmid"), r"[\[\]\s]", ""), ",")
    edges = edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.coalesce("_id", F.lit("0")).alias("key"), osmid.alias("osmid"), _line(cell("geometry")).alias("geometry"))
    return nodes, edges


def box_of(points: DataFrame, pad: float = 0.01) -> DataFrame:
    return points.agg(*bounding_box(F.col("lat"), F.col("lon"), pad))


def clip(nodes: DataFrame, edges: DataFrame, points: DataFrame, pad: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The part of a graph inside the points' box."""
    b = box_of(points, pad).first()
    inside = nodes.where(F.col("lat").between(b["south"], b["north"]) & F.col("lon").between(b["west"], b["east"]))
    ids = inside.select("node_id")
    return inside, edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")
