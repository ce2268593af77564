"""Registered queries of variants: reconstructions, stops as they are, counts of keypoints, contract order, quantiles and odd cases. Importing it adds
them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import metrics, moves, segmentation
from wayfold.plans import pipelines
from wayfold.plans import registry as r
from wayfold.plans.registry import CAPACITY, EPS, _micros, _millis, _query, micro
from wayfold.schema import Compression
from wayfold.sources.points import from_events

_MOVES = f"{r._STAY}, mp AS (SELECT * FROM sp WHERE kind = 'move'), {r._kept_sql('mp', 'kc', 'chain', 'obj_id, seg_id', CAPACITY)}"


@_query("p8_two_point_evaluation", f"{_MOVES}, {r._recon_sql('sp', 'kc', 'rd')}, {r._eval_sql('rd', 'x')} SELECT {r._RECORD} FROM x")
def p8_two_point_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The online pipeline judged like the offline ones: a stop is rebuilt at its start and at its end, and stored once."""
    p = from_events(spark, d)
    rows = pipelines.segment_rows(segmentation.kept_segments(p, *pipelines._online_kernels(Compression(capacity=CAPACITY))))
    return _millis(metrics.evaluation(p, pipelines.reconstruction(rows)))


_KEPT = f"""{_MOVES}, g AS (SELECT s.obj_id, s.seg_id, s.kind, s.s, s.e, CASE WHEN s.kind = 'stop' THEN s.n ELSE k.n END AS keys
    FROM (SELECT obj_id, seg_id, kind, min(t) AS s, max(t) AS e, count(*) AS n FROM sp GROUP BY ALL) s LEFT JOIN (SELECT obj_id, seg_id, count(*) AS n FROM kc GROUP BY ALL) k USING (obj_id, seg_id))"""


@_query("c5_stops_kept", f"{_KEPT} SELECT obj_id, seg_id, kind, {r._m('s')} AS start_t, {r._m('e')} AS end_t, keys::BIGINT AS stored, (24 * keys)::BIGINT AS encoded_bytes FROM g")
def c5_stops_kept(spark: SparkSession, d: str) -> DataFrame:
    """The online pipeline with stops left as they are."""
    found = pipelines.online(from_events(spark, d), Compression(capacity=CAPACITY, compress_stops=False))
    return _micros(found.select("obj_id", "seg_id", "kind", "start_t", "end_t", F.size("keypoints").cast("long").alias("stored"), "encoded_bytes"))


@_query("e13_keypoint_counts", f"""{_KEPT} SELECT obj_id, sum((kind = 'stop')::INT)::BIGINT AS n_stops, sum((kind = 'move')::INT)::BIGINT AS n_moves, {r._m("coalesce(avg(e - s) FILTER (kind = 'stop'), 0)")} AS mean_stop_s, {r._m("coalesce(avg(e - s) FILTER (kind = 'move'), 0)")} AS mean_move_s,
    {r._m("coalesce(avg(keys) FILTER (kind = 'stop'), 0)")} AS mean_stop_points, {r._m("coalesce(avg(keys) FILTER (kind = 'move'), 0)")} AS mean_move_points, sum(keys)::BIGINT AS total_points FROM g GROUP BY obj_id""")  # fmt: skip
def e13_keypoint_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of segments with the keypoints that results keep in place of all points."""
    found = pipelines.online(from_events(spark, d), Compression(capacity=CAPACITY, compress_stops=False))
    return _micros(metrics.segment_counts(found.withColumn("keys", F.size("keypoints").cast("long")), points="keys"))


@_query("e20_contract_order", f"""{r._PTS}, v AS (SELECT road_id AS pipeline, CASE WHEN seq % 2 = 0 THEN 'even' ELSE 'odd' END AS metric, CASE WHEN seq % 5 = 0 THEN NULL ELSE t END AS value, seq * 100000 + obj_id::BIGINT AS place FROM pts),
    f AS (SELECT pipeline, row_number() OVER (ORDER BY min(place)) - 1 AS place FROM v GROUP BY pipeline)
    SELECT v.pipeline, metric, f.place::BIGINT AS place, {r._m('avg(value)')} AS mean, {r._m('quantile_cont(value, 0.5)')} AS median, {r._m('quantile_cont(value, 0.95)')} AS p95 FROM v JOIN f USING (pipeline) GROUP BY v.pipeline, metric, f.place""")  # fmt: skip
def e20_contract_order(spark: SparkSession, d: str) -> DataFrame:
    """The contract's aggregate with its pipelines in order of first appearance."""
    p = from_events(spark, d)
    metric = F.when(F.col("seq") % 2 == 0, "even").otherwise("odd")
    value = metrics.normalise_metric(F.when(F.col("seq") % 5 != 0, F.col("t")))
    records = p.select(F.col("road_id").alias("pipeline"), metric.alias("metric"), value.alias("value"), (F.col("seq") * 100_000 + F.col("obj_id").cast("long")).alias("at"))
    return _micros(metrics.contract_aggregate(records, "at"))


@_query("e7_quantiles", f"{r._DP}, {r._sed_sql('kept', 'err')}, q AS (SELECT obj_id, unnest(range(5, 100)) AS k, unnest(quantile_cont(sed, [{', '.join(f'{k / 100}' for k in range(5, 100))}])) AS v FROM err GROUP BY obj_id) SELECT obj_id, k::BIGINT AS k, {r._mm('v')} AS value FROM q")
def e7_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """The 95 quantiles of the error bundle, one row each."""
    p = from_events(spark, d)
    found = metrics.error_bundle(metrics.synchronized_errors(p, moves.line_simplify(p, eps=EPS)))
    return found.select("obj_id", F.posexplode("quantiles").alias("k", "v")).select("obj_id", (F.col("k") + 5).cast("long").alias("k"), micro("v", 1e3).alias("value"))


_LAG = f"{r._PTS}, l AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(t) OVER w AS lt FROM pts WINDOW w AS (PARTITION BY obj_id ORDER BY seq)), s AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 0.0 ELSE t - lt END AS dt, {r._SPEED} AS m FROM l WHERE la IS NOT NULL)"


@_query("g_edge_branches", f"""{_LAG} SELECT obj_id, seq, {r._mm('sqrt(pow((lat - la) * 111320.0, 2) + pow((lon - lo) * 111320.0 * cos(radians((lat + la) / 2)), 2))')} AS to_point, {r._mm('sqrt(pow((lat - la) * 111320.0, 2) + pow((lon - lo) * 111320.0 * cos(radians((la + lat) / 2)), 2))')} AS to_start,
    {r._mm('CASE WHEN dt > 0 THEN m / dt ELSE 7.25 END')} AS speed FROM s""")  # fmt: skip
def g_edge_branches(spark: SparkSession, d: str) -> DataFrame:
    """Distances to a line whose ends coincide, errors to a segment without duration, and speeds where no time has passed."""
    w = Window.partitionBy("obj_id").orderBy("seq")
    rows = from_events(spark, d).withColumns({c: F.lag(k).over(w) for c, k in (("la", "lat"), ("lo", "lon"), ("lt", "t"))}).where("la IS NOT NULL")
    lat, lon, la, lo, lt = (F.col(c) for c in ("lat", "lon", "la", "lo", "lt"))
    dt = F.when(F.col("seq") % 3 == 0, F.lit(0.0)).otherwise(F.col("t") - lt)
    v = geo.speed(geo.speed_distance(la, lo, lat, lon), dt, F.lit(7.25))
    return rows.select("obj_id", "seq", micro(geo.perpendicular(lat, lon, la, lo, la, lo), 1e3).alias("to_point"), micro(geo.synchronized(lat, lon, F.col("t"), la, lo, lt, la, lo, lt), 1e3).alias("to_start"), micro(v, 1e3).alias("speed"))
