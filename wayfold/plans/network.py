"""Registered queries of coded and matched moves. Importing it adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import matching, moves, segmentation
from wayfold.plans import pipelines
from wayfold.plans import registry as r
from wayfold.plans.records import _roads
from wayfold.plans.registry import EPS, SECONDS, _micros, _query
from wayfold.schema import Compression, Matching, ReferenceCoding
from wayfold.sources.points import from_events

#: A limit of speed change that the made tracks pass, so that speeds and matches of both kinds occur.
GAMMA = 3.8


def _entries_sql(gamma: float) -> str:
    """CTEs of the speed representation of each move: ent (obj_id, seg_id, i, road_id, speed)."""
    return f"""{r._STAY}, mp AS (SELECT *, row_number() OVER (PARTITION BY obj_id, seg_id ORDER BY seq) AS i FROM sp WHERE kind = 'move'), run AS (
        SELECT obj_id, seg_id, i, seq, road_id, 0.0::DOUBLE AS stored, true AS kept, 0.0::DOUBLE AS v FROM mp WHERE i = 1
        UNION ALL
        SELECT obj_id, seg_id, i, seq, road_id, CASE WHEN turn THEN 0 WHEN abs(w - stored) > {gamma} THEN w ELSE stored END, turn OR abs(w - stored) > {gamma}, CASE WHEN turn THEN 0 ELSE w END
        FROM (SELECT p.obj_id, p.seg_id, p.i, p.seq, p.road_id, r.stored, p.road_id IS DISTINCT FROM r.road_id AS turn, {r._V} / (p.t - q.t) AS w
              FROM run r JOIN mp p ON p.obj_id = r.obj_id AND p.seg_id = r.seg_id AND p.i = r.i + 1 JOIN mp q ON q.obj_id = r.obj_id AND q.seg_id = r.seg_id AND q.i = r.i)),
    ent AS (SELECT *, row_number() OVER (PARTITION BY obj_id, seg_id ORDER BY seq) - 1 AS place FROM run WHERE kept)"""


def _coded(spark: SparkSession, d: str, gamma: float) -> DataFrame:
    seg = segmentation.stay_points(from_events(spark, d), EPS, SECONDS)
    return moves.referential_coding(segmentation.moves(seg), ReferenceCoding(gamma=gamma))


@_query("d10_decoded", f"{_entries_sql(GAMMA)} SELECT obj_id, seg_id, place::BIGINT AS place, road_id, round_even(v / 7.5, 0)::BIGINT AS speed FROM ent")
def d10_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Each retained entry's road and quantised speed, read back from the coded factors."""
    found = moves.decoded_moves(_coded(spark, d, GAMMA))
    entries = found.select("obj_id", "seg_id", F.posexplode(F.arrays_zip("roads", "speeds")).alias("place", "z"))
    return entries.select("obj_id", "seg_id", F.col("place").cast("long").alias("place"), F.col("z.roads").alias("road_id"), F.col("z.speeds").alias("speed"))


@_query("d16_factor_totals", f"{_entries_sql(GAMMA)}, g AS (SELECT obj_id, count(*) AS entries, count(DISTINCT seg_id) AS moves FROM ent GROUP BY 1) SELECT obj_id, entries, moves, true AS covered, true AS cheaper FROM g")
def d16_factor_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per object: entries that the factors cover, moves, and whether bytes and lengths of the factors agree with them."""
    coded = _coded(spark, d, GAMMA)
    length = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, f: a + F.when(f["tag"] == "match", f["length"] + F.when(f["mismatch"].isNull(), 0).otherwise(1)).otherwise(1))
    per = coded.select("obj_id", length("e").alias("ne"), length("v").alias("nv"), "encoded_bytes", (moves.factor_bytes(F.col("e")) + moves.factor_bytes(F.col("v"))).alias("own"))
    rows = per.groupBy("obj_id").agg(F.sum("ne").alias("entries"), F.count("*").alias("moves"), F.bool_and((F.col("ne") == F.col("nv")) & (F.col("own") == F.col("encoded_bytes"))).alias("covered"), F.bool_and(F.col("encoded_bytes") <= 8 * F.col("ne")).alias("cheaper"))
    return rows


_P5_KEPT = r.ORACLES["d17_retained_points"].rpartition("SELECT obj_id, seg_id, seq, reason")[0]


@_query("p5_network_stored", f"""{_P5_KEPT}, n AS (SELECT obj_id, count(*) AS original_points FROM pts GROUP BY 1), s AS (SELECT obj_id, seg_id, kind FROM sp GROUP BY ALL), k AS (SELECT obj_id, count(*) AS kept FROM run WHERE reason IS NOT NULL GROUP BY 1)
    SELECT n.obj_id, original_points, (coalesce(kept, 0) + sum((kind = 'stop')::INT))::BIGINT AS stored_points, sum((kind = 'stop')::INT)::BIGINT AS stops, sum((kind = 'move')::INT)::BIGINT AS moves, original_points * 24 AS original_bytes
    FROM n JOIN s USING (obj_id) LEFT JOIN k USING (obj_id) GROUP BY n.obj_id, original_points, kept""")  # fmt: skip
def p5_network_stored(spark: SparkSession, d: str) -> DataFrame:
    """The network pipeline's summary but for its coded bytes, which no SQL gives."""
    p = from_events(spark, d)
    found = pipelines.trajectory_results(p, pipelines.online(p, Compression(strategy="network_semantic")))
    return _micros(found.drop("encoded_bytes", "compression_ratio"))


@_query("h3_tiled_matching", f"{r._PTS} SELECT obj_id, count(*) AS points, 0::BIGINT AS differing FROM pts GROUP BY obj_id")
def h3_tiled_matching(spark: SparkSession, d: str) -> DataFrame:
    """Per object: points that the tiled matcher gives, and those that differ from what the matcher with the whole graph gives."""
    p = from_events(spark, d)
    roads, config = _roads(spark, p), Matching(window=4)
    tiled = matching.match_tiled(p, *roads, config)
    other = matching.match(p, *roads, config).select("obj_id", "seq", *[F.col(c).alias(f"_{c}") for c in ("lat", "lon", "road_id")])
    same = F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon")) & F.col("road_id").eqNullSafe(F.col("_road_id"))
    return tiled.join(other, ["obj_id", "seq"], "left").groupBy("obj_id").agg(F.count("*").alias("points"), F.sum(F.when(same, 0).otherwise(1)).alias("differing"))


@_query("p5_network_matched")
def p5_network_matched(spark: SparkSession, d: str) -> DataFrame:
    """The network pipeline with map matching on, over a graph in tiles."""
    p = from_events(spark, d)
    roads, config = _roads(spark, p), Compression(strategy="network_semantic")
    return _micros(pipelines.trajectory_results(p, pipelines.online(matching.match_tiled(p, *roads, Matching(window=4)), config)))
