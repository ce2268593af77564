"""More registered queries: ratios, keypoint errors, spans, diagnostics, tuning and map matching. Importing it adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import experiments, matching, metrics, moves, segmentation, stops
from wayfold.operators.experiments import SLIM
from wayfold.operators.kernels import GRID_SHARE
from wayfold.plans import registry as r
from wayfold.plans.registry import CAPACITY, EPS, SAMPLES, SECONDS, _millis, _micros, _query
from wayfold.schema import Matching, ReferenceCoding
from wayfold.sources.points import from_events


def _stay(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = from_events(spark, d)
    return p, segmentation.stay_points(p, EPS, SECONDS)


_SNAP = """w AS (SELECT *, lag(lat) OVER o AS y0, lag(lon) OVER o AS x0, lead(lat) OVER o AS y1, lead(lon) OVER o AS x1, lead(lat, 2) OVER o AS y2, lead(lon, 2) OVER o AS x2 FROM pts WINDOW o AS (PARTITION BY obj_id ORDER BY seq)),
    u AS (SELECT *, greatest(0, least(1, ((lon - x0) * (x1 - x0) + (lat - y0) * (y1 - y0)) / nullif(pow(x1 - x0, 2) + pow(y1 - y0, 2), 0))) AS a, greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0))) AS b FROM w WHERE y0 IS NOT NULL AND y2 IS NOT NULL),
    s AS (SELECT obj_id, seq, lat, lon, y0 + coalesce(a, 0) * (y1 - y0) AS ya, x0 + coalesce(a, 0) * (x1 - x0) AS xa, y1 + coalesce(b, 0) * (y2 - y1) AS yb, x1 + coalesce(b, 0) * (x2 - x1) AS xb FROM u)"""


@_query("g10_snap", f"{r._PTS}, {_SNAP} SELECT obj_id, seq, {r._m('CASE WHEN pow(lat - ya, 2) + pow(lon - xa, 2) <= pow(lat - yb, 2) + pow(lon - xb, 2) THEN ya ELSE yb END')} AS lat, {r._m('CASE WHEN pow(lat - ya, 2) + pow(lon - xa, 2) <= pow(lat - yb, 2) + pow(lon - xb, 2) THEN xa ELSE xb END')} AS lon FROM s")
def g10_snap(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("obj_id").orderBy("seq")
    at = [F.struct(f("lat", k).over(w).alias("lat"), f("lon", k).over(w).alias("lon")) for f, k in ((F.lag, 1), (F.lead, 1), (F.lead, 2))]
    rows = from_events(spark, d).withColumn("line", F.array(*at)).where("line[0].lat IS NOT NULL AND line[2].lat IS NOT NULL")
    return _micros(rows.select("obj_id", "seq", geo.snap_to_polyline(F.col("lat"), F.col("lon"), F.col("line")).alias("s")).select("obj_id", "seq", "s.lat", "s.lon"))


@_query("e2_e3_ratios", f"""{r._DP}, k AS (SELECT obj_id, count(*) AS k FROM kept GROUP BY 1), n AS (SELECT obj_id, count(*) AS n FROM pts GROUP BY 1)
    SELECT obj_id, {r._m('n / greatest(1, k)')} AS point_ratio, {r._m('n * 24 / (k * 24)')} AS byte_ratio FROM n JOIN k USING (obj_id)""")  # fmt: skip
def e2_e3_ratios(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    k = moves.line_simplify(p, eps=EPS).groupBy("obj_id").agg(F.count("*").alias("k"))
    rows = p.groupBy("obj_id").agg(F.count("*").alias("n")).join(k, "obj_id")
    return _micros(rows.select("obj_id", metrics.point_ratio(F.col("n"), F.col("k")).alias("point_ratio"), metrics.byte_ratio(F.col("n"), F.col("k") * 24).alias("byte_ratio")))


_KEYS = f"{r._STAY}, mp AS (SELECT * FROM sp WHERE kind = 'move'), {r._dp_sql('mp', 'km', 'obj_id, seg_id')}, {r._recon_sql('sp', 'km', 'two')}, keys AS (SELECT * FROM two WHERE stored = 1)"


@_query("e4_e6_keypoint_errors", f"{_KEYS}, {r._eval_sql('keys', 'x')} SELECT {r._RECORD} FROM x")
def e4_e6_keypoint_errors(spark: SparkSession, d: str) -> DataFrame:
    p, seg = _stay(spark, d)
    kept = moves.line_simplify(segmentation.moves(seg), moves.PER_SEGMENT, EPS)
    return _millis(metrics.evaluation(p, metrics.keypoint_reconstruction(stops.compress(seg), kept)))


@_query("e9_segment_spans", f"""{r._DP}, k AS (SELECT obj_id, t, coalesce(lag(t) OVER w, -1e18) AS after, coalesce(t - lag(t) OVER w, lead(t) OVER w - t) AS span FROM kept WINDOW w AS (PARTITION BY obj_id ORDER BY t)),
    j AS (SELECT p.obj_id, k.span FROM pts p JOIN k ON k.obj_id = p.obj_id AND p.t > k.after AND p.t <= k.t) SELECT obj_id, {r._mm('avg(span)')} AS mean_span, {r._mm('quantile_cont(span, 0.95)')} AS p95_span, {r._mm('max(span)')} AS max_span FROM j GROUP BY obj_id""")  # fmt: skip
def e9_segment_spans(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    return _millis(metrics.segment_spans(p, moves.line_simplify(p, eps=EPS)))


@_query("e18_pipeline_latency", f"SELECT event_id, {r._m('value + CASE WHEN event_id % 3 > 0 THEN value / 2 ELSE 0 END')} AS total FROM events")
def e18_pipeline_latency(spark: SparkSession, d: str) -> DataFrame:
    half = F.when(F.col("event_id") % 3 > 0, F.col("value") / 2)
    stages = F.map_filter(F.create_map(F.lit("segmentation"), F.col("value"), F.lit("encoding"), half, F.lit("reading"), F.lit(9.0)), lambda k, v: v.isNotNull())
    return _micros(spark.read.parquet(f"{d}/events.parquet").select("event_id", metrics.pipeline_latency(stages).alias("total")))


def _better_sql() -> str:
    parts = [r._kept_sql("pts", k, how, "obj_id", 60) + f", r{k} AS (SELECT p.obj_id, p.t, p.lat, p.lon, 1 AS stored FROM pts p JOIN {k} USING (obj_id, seq)), {r._eval_sql(f'r{k}', f'e{k}')}" for k, how in (("b", "buffer"), ("h", "hybrid"))]
    return f"{r._PTS}, {', '.join(parts)} SELECT count(*) AS objects, sum(({r._mm('eh.avg_sed_m')} < {r._mm('eb.avg_sed_m')})::INT)::BIGINT AS hybrid_better FROM eb JOIN eh USING (obj_id)"


@_query("e23_hybrid_better", _better_sql())
def e23_hybrid_better(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    mean = lambda kept, n: metrics.evaluation(p, kept).select("obj_id", r.micro("avg_sed_m", 1e3).alias(n))
    return metrics.better_count(mean(moves.buffer_simplify(p, capacity=60), "other"), mean(moves.hybrid_simplify(p, capacity=60), "own"), "hybrid_better")


@_query("m6_density_segments", f"{r._OFFLINE} SELECT obj_id, seq, seg_id, kind FROM spd")
def m6_density_segments(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.density_segments(from_events(spark, d), EPS, SECONDS, SAMPLES, "manual").select("obj_id", "seq", "seg_id", "kind")


@_query("d18_stream_ratio", f"{r.ORACLES['d9_speed_entries'].rpartition('SELECT obj_id, seq, road_id, 1::BIGINT')[0]}, k AS (SELECT obj_id, count(*) AS k FROM run WHERE kept GROUP BY 1) SELECT n.obj_id, {r._m('n.n / greatest(1, k.k)')} AS ratio FROM (SELECT obj_id, count(*) AS n FROM pts GROUP BY 1) n JOIN k USING (obj_id)")
def d18_stream_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d).withColumns({"seg_id": F.lit(0).cast("long"), "kind": F.lit("move")})
    return _micros(moves.stream_ratio(p, moves.referential_coding(p, ReferenceCoding(gamma=3.8))))


@_query("m1a_grid_pruning", f"{r._STAY} SELECT obj_id, seq, seg_id, kind FROM sp")
def m1a_grid_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Stay points with distances settled by grid cells where these decide."""
    return segmentation.stay_points(from_events(spark, d), EPS, SECONDS, GRID_SHARE * EPS).select("obj_id", "seq", "seg_id", "kind")


@_query("e5_blocked_errors", r.ORACLES["e5_synchronized_errors"])
def e5_blocked_errors(spark: SparkSession, d: str) -> DataFrame:
    """Synchronized errors with each object's time cut into blocks of 35 seconds, fewer than the fixes between kept points at times."""
    p = from_events(spark, d)
    return _millis(metrics.synchronized_errors(p, moves.line_simplify(p, eps=EPS), block_s=35.0).select("obj_id", "seq", "sed"))


_RETAINED = r.ORACLES["d17_retained_points"].rpartition("SELECT obj_id, seg_id, seq, reason")[0]


@_query("p10_diagnostics", f"""{_RETAINED}, n AS (SELECT obj_id, count(*) AS input_points FROM mp GROUP BY 1), c AS (SELECT obj_id, count(reason) AS kept_points, sum((reason = 'road_change')::INT)::BIGINT AS road_changes, sum((reason = 'speed_change')::INT)::BIGINT AS speed_changes, sum((reason = 'forced_last')::INT)::BIGINT AS forced_last FROM run WHERE reason IS NOT NULL GROUP BY 1)
    SELECT n.*, c.* EXCLUDE (obj_id), {r._m('kept_points / input_points')} AS retention_ratio FROM n JOIN c USING (obj_id)""")  # fmt: skip
def p10_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    moving = segmentation.moves(_stay(spark, d)[1])
    return _micros(moves.diagnostics(moving, moves.retained_points(moving)))


@_query("p12_run_pair", f"""{r._STAY}, {r._offline_sql(EPS, SECONDS, 15)}, a AS (SELECT 'stay' AS side, obj_id, seg_id, kind, count(*) AS n FROM sp GROUP BY ALL), b AS (SELECT 'density', obj_id, seg_id, kind, count(*) FROM spd GROUP BY ALL)
    SELECT side, obj_id, sum((kind = 'stop')::INT)::BIGINT AS n_stops, sum((kind = 'move')::INT)::BIGINT AS n_moves, sum(n)::BIGINT AS n_points FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY side, obj_id""")  # fmt: skip
def p12_run_pair(spark: SparkSession, d: str) -> DataFrame:
    p, online = _stay(spark, d)
    offline = segmentation.density_segments(p, EPS, SECONDS, 15, "manual")
    rows = online.withColumn("side", F.lit("stay")).unionByName(offline.withColumn("side", F.lit("density")))
    one = rows.groupBy("side", "obj_id", "seg_id", "kind").agg(F.count("*").alias("n"))
    count = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}s")
    return one.groupBy("side", "obj_id").agg(count("stop"), count("move"), F.sum("n").alias("n_points"))


@_query("x6_best_configurations", f"""{r._aggregate_sql()} SELECT row_number() OVER (ORDER BY passes DESC, f1_median DESC, eps_m, t_s, min_samples) AS place, eps_m, t_s, {', '.join(f'{r._m(c)} AS {c}' for c in SLIM)}, passes FROM best""")
def x6_best_configurations(spark: SparkSession, d: str) -> DataFrame:
    """Every config of the sweep in order, the best first, with the columns of comparison."""
    best = experiments.sort_best(experiments.sweep_aggregate(experiments.segmentation_sweep(from_events(spark, d))))
    # a place for each config of the grid, a handful of rows
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("passes"), F.desc("f1_median"), "eps_m", "t_s", "min_samples")
    found = experiments.slim(best.withColumn("place", F.row_number().over(order)), "place")
    return _micros(found.select("place", "eps_m", "t_s", *[F.col(c).cast("double").alias(c) for c in SLIM], "passes"), "eps_m", "t_s")


def _tuning_sql() -> str:
    ctes, rows = [r._PTS], []
    for k in experiments.TUNING_SAMPLES:
        for e in experiments.TUNING_EPS:
            ctes.append(r._labels_sql(e, k, f"_{e:g}_{k}"))
            for t in experiments.TUNING_SECONDS:
                tag = f"_{e:g}_{k}_{t:g}"
                ctes += [r._offline_sql(e, t, k, tag, f"_{e:g}_{k}"), f"g{tag} AS (SELECT obj_id, seg_id, kind, max(t) - min(t) AS s FROM sp{tag} GROUP BY ALL)"]
                rows.append(f"SELECT {k}::BIGINT AS min_samples, {e}::DOUBLE AS eps_m, {t}::DOUBLE AS t_s, sum((kind = 'stop')::INT)::BIGINT AS n_stops, sum((kind = 'move')::INT)::BIGINT AS n_moves, coalesce(avg(s) FILTER (kind = 'stop'), 0) AS mean_stop_s FROM g{tag}")
    return f"{', '.join(ctes)} SELECT min_samples, eps_m, t_s, n_stops, n_moves, {r._m('mean_stop_s')} AS mean_stop_s, row_number() OVER (ORDER BY n_stops DESC, min_samples, eps_m, t_s) = 1 AS most_stops FROM ({' UNION ALL '.join(rows)})"


@_query("x7_tuning_grid", _tuning_sql())
def x7_tuning_grid(spark: SparkSession, d: str) -> DataFrame:
    return _micros(experiments.tuning_grid(from_events(spark, d)), "eps_m", "t_s")


def _roads(spark: SparkSession, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A made grid of roads over the points' box: nodes every 0.001 degrees, edges both ways to the next one north and east."""
    box = points.agg(*geo.bounding_box(F.col("lat"), F.col("lon"), 0.001)).first()
    step = 0.001
    ny, nx = (int((box[a] - box[b]) / step) + 1 for a, b in (("north", "south"), ("east", "west")))
    at = spark.range(ny * nx).select(F.floor(F.col("id") / nx).alias("y"), (F.col("id") % nx).alias("x"))
    name = lambda y, x: F.concat_ws("_", y, x)
    nodes = at.select(name(F.col("y"), F.col("x")).alias("node_id"), (box["south"] + F.col("y") * step).alias("lat"), (box["west"] + F.col("x") * step).alias("lon"))
    ways = [at.where(F.col(c) < n - 1).select(name(F.col("y"), F.col("x")).alias("u"), name(*v).alias("v"), F.concat(F.lit(tag), F.col(k)).alias("w")) for c, n, k, tag, v in (("y", ny, "x", "NS", (F.col("y") + 1, F.col("x"))), ("x", nx, "y", "EW", (F.col("y"), F.col("x") + 1)))]
    both = ways[0].unionByName(ways[1])
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return nodes, both.select("u", "v", F.lit("0").alias("key"), F.array("w").alias("osmid"), F.lit(None).cast("array<struct<lat:double,lon:double>>").alias("geometry"))


@_query("h2_map_matching")
def h2_map_matching(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    return _micros(matching.match(p, *_roads(spark, p), Matching(window=4)).select("obj_id", "seq", "lat", "lon", "road_id"))


@_query("h6_matched_moves")
def h6_matched_moves(spark: SparkSession, d: str) -> DataFrame:
    """Road changes of moves that are matched one by one, with the matcher's counters per object."""
    p, seg = _stay(spark, d)
    found = matching.match(segmentation.moves(seg), *_roads(spark, p), Matching(window=4), moves.PER_SEGMENT)
    found = found.withColumn("_keep", moves.is_road_change(moves.PER_SEGMENT))  # counted with the rest: the moves are matched once
    return matching.diagnostics(segmentation.moves(seg), found, F.count(F.when(F.col("_keep"), 1)).alias("kept_points"))
