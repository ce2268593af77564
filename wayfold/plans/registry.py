"""Queries of the trajectory operators over trajectories made from ``events``, and their DuckDB equivalents.

Floating results are returned in integer micro-units, so that both engines' last digits do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import experiments, metrics, moves, segmentation, stops
from wayfold.plans import pipelines
from wayfold.schema import Compression
from wayfold.sources.points import EVENTS_SQL, FILE_ORDER, events_in_order, from_events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "p3_geometric_summary"
EPS, SECONDS, SAMPLES, CAPACITY = 15.0, 30.0, 5, 8


def micro(c, scale: float = 1e6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * scale + 0.5).cast("long")


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _micros(df: DataFrame, *keep: str, scale: float = 1e6) -> DataFrame:
    """Columns ``keep`` as they are, all others in micro-units if they are doubles."""
    kinds = dict(df.dtypes)
    return df.select(*[micro(c, scale).alias(c) if kinds[c] == "double" and c not in keep else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c) for c in df.columns])


def _millis(df: DataFrame, *keep: str) -> DataFrame:
    """The same in milli-units: for metres, whose last digits come from larger numbers."""
    return _micros(df, *keep, scale=1e3)


def _m(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5)::BIGINT"


def _mm(x: str) -> str:
    return f"floor(({x}) * 1e3 + 0.5)::BIGINT"


_EQ = "6371000.0 * sqrt(pow(radians({b}.lon - {a}.lon) * cos(radians(({a}.lat + {b}.lat) / 2)), 2) + pow(radians({b}.lat - {a}.lat), 2))"
_PL = "sqrt(pow(({a}.lat - {b}.lat) * 111320.0, 2) + pow(({a}.lon - {b}.lon) * 111320.0 * cos(radians(({a}.lat + {b}.lat) / 2)), 2))"
_PTS = f"WITH RECURSIVE {EVENTS_SQL}"


def _stay_sql(eps: float, seconds: float, tag: str = "") -> str:
    """CTEs of the stay-point segments as a recursion over fixes: seg{tag} and sp{tag} (points with segments)."""
    near, last = _EQ.format(a="p", b="b"), _EQ.format(a="p", b="q")
    return f"""
    far{tag} AS (SELECT p.obj_id, p.seq, p.t, coalesce(max(b.seq), -1) AS lf FROM pts p LEFT JOIN pts b ON p.obj_id = b.obj_id AND b.seq < p.seq AND {near} > {eps} GROUP BY ALL),
    walk{tag} AS (
        SELECT obj_id, -1::BIGINT AS seq, 0::BIGINT AS base, -1::BIGINT AS s, -1::BIGINT AS e, []::STRUCT(a BIGINT, b BIGINT, kind VARCHAR)[] AS out FROM (SELECT DISTINCT obj_id FROM pts)
        UNION ALL
        SELECT obj_id, seq,
               CASE WHEN stay AND (s < 0 OR i > e) THEN i WHEN NOT stay AND s >= 0 AND away THEN e + 1 ELSE base END,
               CASE WHEN stay AND (s < 0 OR i > e) THEN i WHEN NOT stay AND s >= 0 AND away THEN -1 ELSE s END,
               CASE WHEN stay THEN seq WHEN s >= 0 AND away THEN -1 ELSE e END,
               CASE WHEN stay AND s < 0 AND i > base THEN list_append(out, {{'a': base, 'b': i - 1, 'kind': 'move'}})
                    WHEN stay AND s >= 0 AND i > e + 1 THEN list_append(list_append(out, {{'a': s, 'b': e, 'kind': 'stop'}}), {{'a': e + 1, 'b': i - 1, 'kind': 'move'}})
                    WHEN (stay AND s >= 0 AND i > e) OR (NOT stay AND s >= 0 AND away) THEN list_append(out, {{'a': s, 'b': e, 'kind': 'stop'}})
                    ELSE out END
        FROM (SELECT w.obj_id, p.seq, w.base, w.s, w.e, w.out, greatest(f.lf + 1, w.base) AS i, p.t - r.t >= {seconds} AS stay, coalesce({last} > {eps}, false) AS away
              FROM walk{tag} w JOIN pts p ON p.obj_id = w.obj_id AND p.seq = w.seq + 1 JOIN far{tag} f ON f.obj_id = p.obj_id AND f.seq = p.seq
              JOIN pts r ON r.obj_id = p.obj_id AND r.seq = greatest(f.lf + 1, w.base) LEFT JOIN pts q ON q.obj_id = p.obj_id AND q.seq = w.e)),
    ends{tag} AS (SELECT w.* FROM walk{tag} w JOIN (SELECT obj_id, max(seq) AS seq FROM pts GROUP BY obj_id) n USING (obj_id, seq)),
    lists{tag} AS (SELECT obj_id, list_filter(list_concat(out, CASE WHEN s >= 0 THEN [{{'a': s, 'b': e, 'kind': 'stop'}}, {{'a': e + 1, 'b': seq, 'kind': 'move'}}] ELSE [{{'a': base, 'b': seq, 'kind': 'move'}}] END), lambda x: x.a <= x.b) AS l FROM ends{tag}),
    seg{tag} AS (SELECT obj_id, (i - 1)::BIGINT AS seg_id, l[i].kind AS kind, l[i].a AS a, l[i].b AS b FROM (SELECT obj_id, l, unnest(range(1, len(l) + 1)) AS i FROM lists{tag})),
    sp{tag} AS (SELECT p.*, g.seg_id, g.kind FROM pts p JOIN seg{tag} g ON p.obj_id = g.obj_id AND p.seq BETWEEN g.a AND g.b)"""


def _dp_sql(source: str, name: str, keys: str = "obj_id", eps: float = EPS) -> str:
    """CTEs of line simplification of ``source`` per ``keys``: {name} has the kept (keys, seq)."""
    cut = [f"{{0}}.{k}" for k in keys.split(", ")]
    on = lambda x, y: " AND ".join(f"{c.format(x)} = {c.format(y)}" for c in cut)
    k_d = ", ".join(c.format("d") for c in cut)
    c = "cos(radians((a.lat + b.lat + p.lat) / 3))"
    dist = f"CASE WHEN a.lat = b.lat AND a.lon = b.lon THEN {_PL.format(a='p', b='a')} ELSE abs((b.lat - a.lat) * 111320.0 * (p.lon - a.lon) * 111320.0 * {c} - (b.lon - a.lon) * 111320.0 * {c} * (p.lat - a.lat) * 111320.0) / sqrt(pow((b.lat - a.lat) * 111320.0, 2) + pow((b.lon - a.lon) * 111320.0 * {c}, 2)) END"
    return f"""
    {name}_r AS (
        SELECT {keys}, min(seq) AS lo, max(seq) AS hi FROM {source} GROUP BY {keys}
        UNION ALL
        SELECT {keys}, unnest([lo, k]), unnest([k, hi]) FROM (
            SELECT {k_d}, d.lo, d.hi, first(p.seq ORDER BY {dist} DESC, p.seq) AS k, max({dist}) AS m
            FROM {name}_r d JOIN {source} a ON {on('a', 'd')} AND a.seq = d.lo JOIN {source} b ON {on('b', 'd')} AND b.seq = d.hi
            JOIN {source} p ON {on('p', 'd')} AND p.seq > d.lo AND p.seq < d.hi GROUP BY {k_d}, d.lo, d.hi) WHERE m > {eps}),
    {name} AS (SELECT DISTINCT {keys}, unnest([lo, hi]) AS seq FROM {name}_r)"""


def _sed_sql(kept: str, out: str) -> str:
    """CTEs of synchronized errors of pts against ``kept`` (obj_id, t, lat, lon; one row per time): {out} has sed."""
    r = "(p.t - a.t) / (b.t - a.t)"
    mid = f"sqrt(pow((p.lat - (a.lat + (b.lat - a.lat) * {r})) * 111320.0, 2) + pow((p.lon - (a.lon + (b.lon - a.lon) * {r})) * 111320.0 * cos(radians((a.lat + b.lat) / 2)), 2))"
    return f"""
    {out}_n AS (SELECT p.obj_id, p.seq, max(CASE WHEN k.t < p.t THEN k.t END) AS ta, min(CASE WHEN k.t >= p.t THEN k.t END) AS tb FROM pts p JOIN {kept} k ON k.obj_id = p.obj_id GROUP BY p.obj_id, p.seq),
    {out} AS (SELECT p.obj_id, p.seq, p.t, CASE WHEN n.tb IS NULL THEN {_PL.format(a='p', b='a')} WHEN n.ta IS NULL THEN {_PL.format(a='p', b='b')} ELSE {mid} END AS sed
        FROM pts p JOIN {out}_n n ON n.obj_id = p.obj_id AND n.seq = p.seq LEFT JOIN {kept} a ON a.obj_id = p.obj_id AND a.t = n.ta LEFT JOIN {kept} b ON b.obj_id = p.obj_id AND b.t = n.tb)"""


def _squish_sql(source: str, name: str, capacity: str, keys: str = "obj_id") -> str:
    """CTEs of the bounded buffer over ``source`` per ``keys``: {name} has the kept (keys, seq). ``capacity`` may use the sequence's size n."""
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    wk = ", ".join(f"w.{k}" for k in keys.split(", "))
    r = "((l[j].t - l[j - 1].t) / (l[j + 1].t - l[j - 1].t))"
    dy, dx = (f"(l[j].{c} - (l[j - 1].{c} + (l[j + 1].{c} - l[j - 1].{c}) * {r}))" for c in ("lat", "lon"))
    cost = f"CASE WHEN l[j + 1].t = l[j - 1].t THEN 0.0 ELSE sqrt({dy} * {dy} + {dx} * {dx}) END"
    return f"""
    {name}_q AS (SELECT {keys}, seq, lat, lon, t, row_number() OVER v AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WINDOW v AS (PARTITION BY {keys} ORDER BY seq)),
    {name}_w AS (
        SELECT {keys}, 0::BIGINT AS i, []::STRUCT(seq BIGINT, lat DOUBLE, lon DOUBLE, t DOUBLE)[] AS b FROM (SELECT DISTINCT {keys} FROM {source})
        UNION ALL
        SELECT {keys}, i, CASE WHEN c IS NULL THEN l ELSE list_concat(l[1:list_position(c, list_min(c))], l[list_position(c, list_min(c)) + 2:]) END FROM (
            SELECT {keys}, i, l, CASE WHEN len(l) > cap THEN list_transform(range(2, len(l)), lambda j: {cost}) END AS c FROM (
                SELECT {wk}, q.i, list_append(w.b, {{'seq': q.seq, 'lat': q.lat, 'lon': q.lon, 't': q.t}}) AS l, {capacity} AS cap FROM {name}_w w JOIN {name}_q q ON {on('q', 'w')} AND q.i = w.i + 1))),
    {name} AS (SELECT {keys}, unnest(b).seq AS seq FROM (SELECT w.* FROM {name}_w w JOIN (SELECT {keys}, max(i) AS i FROM {name}_q GROUP BY {keys}) m ON {on('m', 'w')} AND m.i = w.i))"""


def _kept_sql(source: str, name: str, how: str, keys: str, capacity: int) -> str:
    """CTEs of one simplification of ``source`` per ``keys``: {name} has the kept (keys, seq)."""
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    pick = lambda out, cte: f"{out} AS (SELECT p.* FROM {source} p JOIN {cte} k ON {on('p', 'k')} AND p.seq = k.seq)"
    if how == "none":
        return f"{name} AS (SELECT {keys}, seq FROM {source})"
    if how == "line":
        return _dp_sql(source, name, keys)
    if how == "buffer":
        return _squish_sql(source, name, str(capacity), keys)
    if how == "chain":
        return f"{_squish_sql(source, f'{name}_b', str(capacity), keys)}, {pick(f'{name}_p', f'{name}_b')}, {_dp_sql(f'{name}_p', name, keys)}"
    size = f"{name}_n AS (SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys}), {name}_s AS (SELECT p.* FROM {source} p JOIN {name}_n n ON {on('p', 'n')} WHERE n <= {capacity}), {name}_l AS (SELECT p.* FROM {source} p JOIN {name}_n n ON {on('p', 'n')} WHERE n > {capacity})"
    long = _squish_sql(f"{name}_l", f"{name}_lb", str(capacity), keys)
    if how == "hybrid_refined":
        long += f", {pick(f'{name}_lp', f'{name}_lb')}, {_dp_sql(f'{name}_lp', f'{name}_lr', keys)}"
    return f"{size}, {_dp_sql(f'{name}_s', f'{name}_sd', keys)}, {long}, {name} AS (SELECT * FROM {name}_sd UNION ALL SELECT * FROM {name}_l{'r' if how == 'hybrid_refined' else 'b'})"


def _labels_sql(eps: float, samples: int, tag: str = "") -> str:
    """CTEs of the density clusters: lab{tag} (obj_id, seq, label) without noise. A cluster is found by its least core."""
    return f"""
    nb{tag} AS (SELECT a.obj_id, a.seq AS i, b.seq AS j FROM (SELECT a.obj_id, a.seq, b.seq AS other, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
        FROM pts a JOIN pts b ON a.obj_id = b.obj_id) a JOIN pts b ON b.obj_id = a.obj_id AND b.seq = a.other WHERE 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) <= {eps}),
    core{tag} AS (SELECT obj_id, i FROM nb{tag} GROUP BY ALL HAVING count(*) >= {samples}), cc{tag} AS (SELECT n.* FROM nb{tag} n JOIN core{tag} a ON a.obj_id = n.obj_id AND a.i = n.i JOIN core{tag} b ON b.obj_id = n.obj_id AND b.i = n.j),
    reach{tag} AS (SELECT obj_id, i, j FROM cc{tag} UNION SELECT r.obj_id, r.i, c.j FROM reach{tag} r JOIN cc{tag} c ON c.obj_id = r.obj_id AND c.i = r.j),
    root{tag} AS (SELECT obj_id, i, min(j) AS r FROM reach{tag} GROUP BY ALL), num{tag} AS (SELECT obj_id, r, dense_rank() OVER (PARTITION BY obj_id ORDER BY r) - 1 AS label FROM root{tag} GROUP BY obj_id, r),
    lab{tag} AS (SELECT n.obj_id, n.i AS seq, min(m.label) AS label FROM nb{tag} n JOIN root{tag} o ON o.obj_id = n.obj_id AND o.i = n.j JOIN num{tag} m ON m.obj_id = o.obj_id AND m.r = o.r GROUP BY ALL)"""


def _offline_sql(eps: float, seconds: float, samples: int, tag: str = "d", labels: str | None = None) -> str:
    """CTEs of the offline segmentation: sp{tag}. ``labels``: the tag of clusters that stand before."""
    made = "" if labels is not None else _labels_sql(eps, samples, tag) + ","
    return f"""{made}
    lb{tag} AS (SELECT p.*, coalesce(l.label, -1) AS label FROM pts p LEFT JOIN lab{tag if labels is None else labels} l ON l.obj_id = p.obj_id AND l.seq = p.seq),
    r1{tag} AS (SELECT *, (label IS DISTINCT FROM lag(label) OVER w)::INT AS c FROM lb{tag} WINDOW w AS (PARTITION BY obj_id ORDER BY seq)), r2{tag} AS (SELECT *, sum(c) OVER (PARTITION BY obj_id ORDER BY seq) AS g FROM r1{tag}),
    r3{tag} AS (SELECT *, CASE WHEN label <> -1 AND max(t) OVER v - min(t) OVER v >= {seconds} THEN 'stop' ELSE 'move' END AS kind FROM r2{tag} WINDOW v AS (PARTITION BY obj_id, g)),
    r4{tag} AS (SELECT *, CASE WHEN g = lag(g) OVER w OR (kind = 'move' AND lag(kind) OVER w = 'move') THEN 0 ELSE 1 END AS nw FROM r3{tag} WINDOW w AS (PARTITION BY obj_id ORDER BY seq)),
    sp{tag} AS (SELECT obj_id, seq, lat, lon, t, road_id, kind, (sum(nw) OVER (PARTITION BY obj_id ORDER BY seq) - 1)::BIGINT AS seg_id FROM r4{tag})"""


def _recon_sql(sp: str, kept: str, name: str) -> str:
    """CTE of the timed points of a segmented compression, with stored."""
    return f"""{name}_c AS (SELECT obj_id, seg_id, avg(lat) AS lat, avg(lon) AS lon, min(t) AS s, max(t) AS e FROM {sp} WHERE kind = 'stop' GROUP BY ALL),
    {name} AS (SELECT obj_id, lat, lon, s AS t, 1 AS stored FROM {name}_c UNION ALL SELECT obj_id, lat, lon, e, 0 FROM {name}_c
        UNION ALL SELECT p.obj_id, p.lat, p.lon, p.t, 1 FROM {sp} p JOIN {kept} k ON k.obj_id = p.obj_id AND k.seg_id = p.seg_id AND k.seq = p.seq)"""


def _eval_sql(recon: str, name: str) -> str:
    """CTEs of the metric record per object against ``recon`` (obj_id, t, lat, lon, stored): {name}, in metres."""
    return f"""{_sed_sql(recon, f'{name}_e')},
    {name} AS (SELECT n.obj_id, n.c AS n_raw_points, n.c / greatest(1, coalesce(s.n, 0)) AS cr, coalesce(s.n, 0) AS stored_points, e.avg_sed_m, e.p95_sed_m, e.max_sed_m, e.pct_5m
        FROM (SELECT obj_id, count(*) AS c FROM pts GROUP BY 1) n LEFT JOIN (SELECT obj_id, sum(stored)::BIGINT AS n FROM {recon} GROUP BY 1) s USING (obj_id)
        LEFT JOIN (SELECT obj_id, avg(sed) AS avg_sed_m, quantile_cont(sed, 0.95) AS p95_sed_m, max(sed) AS max_sed_m, 100 * avg((sed <= 5)::INT) AS pct_5m FROM {name}_e GROUP BY 1) e USING (obj_id))"""


_RECORD = f"obj_id, n_raw_points, {_mm('cr')} AS cr, stored_points, {_mm('avg_sed_m')} AS avg_sed_m, {_mm('p95_sed_m')} AS p95_sed_m, {_mm('max_sed_m')} AS max_sed_m, {_mm('pct_5m')} AS pct_5m"
_STAY = f"{_PTS}, {_stay_sql(EPS, SECONDS)}"
_DP = f"{_PTS}, {_dp_sql('pts', 'dp')}, kept AS (SELECT p.* FROM pts p JOIN dp USING (obj_id, seq))"


@_query("s0_points", f"{_PTS} SELECT obj_id, seq, {_m('lat')} AS lat, {_m('lon')} AS lon, {_m('t')} AS t, road_id FROM pts")
def s0_points(spark: SparkSession, d: str) -> DataFrame:
    return _micros(from_events(spark, d))


_HAV = "sin(radians(lat - la) / 2) * sin(radians(lat - la) / 2) + cos(radians(la)) * cos(radians(lat)) * sin(radians(lon - lo) / 2) * sin(radians(lon - lo) / 2)"
_SPEED = "6371000.0 * sqrt(pow(radians(lon - lo) * cos((radians(la) + radians(lat)) / 2), 2) + pow(radians(lat) - radians(la), 2))"


@_query(
    "g_distances",
    f"""{_PTS}, l AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(t) OVER w AS lt FROM pts WINDOW w AS (PARTITION BY obj_id ORDER BY seq))
    SELECT obj_id, seq, {_mm(f'2 * 6371000.0 * atan2(sqrt({_HAV}), sqrt(1 - ({_HAV})))')} AS haversine,
           {_mm('6371000.0 * sqrt(pow(radians(lon - lo) * cos(radians((la + lat) / 2)), 2) + pow(radians(lat - la), 2))')} AS local, {_mm(_SPEED)} AS speed_distance,
           {_mm('sqrt(pow((la - lat) * 111320.0, 2) + pow((lo - lon) * 111320.0 * cos(radians((la + lat) / 2)), 2))')} AS planar,
           {_mm(f'({_SPEED}) / (t - lt)')} AS speed, round_even(({_SPEED}) / (t - lt) / 7.5, 0)::BIGINT AS quantised FROM l WHERE la IS NOT NULL""",
)
def g_distances(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("obj_id").orderBy("seq")
    lat, lon, la, lo, dt = F.col("lat"), F.col("lon"), F.lag("lat").over(w), F.lag("lon").over(w), F.col("t") - F.lag("t").over(w)
    v = geo.speed(geo.speed_distance(la, lo, lat, lon), dt, F.lit(-1.0))
    rows = from_events(spark, d).select("obj_id", "seq", geo.haversine(la, lo, lat, lon).alias("haversine"), geo.equirectangular(la, lo, lat, lon).alias("local"), geo.speed_distance(la, lo, lat, lon).alias("speed_distance"), geo.planar(la, lo, lat, lon).alias("planar"), v.alias("speed"), geo.quantised_speed(v, 15.0).alias("quantised"))
    return _millis(rows.where("local IS NOT NULL"))


@_query("g_bounding_box", f"{_PTS} SELECT obj_id, {_m('min(lat) - 0.01')} AS south, {_m('max(lat) + 0.01')} AS north, {_m('min(lon) - 0.01')} AS west, {_m('max(lon) + 0.01')} AS east FROM pts GROUP BY obj_id")
def g_bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return _micros(from_events(spark, d).groupBy("obj_id").agg(*geo.bounding_box(F.col("lat"), F.col("lon"))))


@_query("m1_stay_points", f"{_STAY} SELECT obj_id, seq, seg_id, kind FROM sp")
def m1_stay_points(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.stay_points(from_events(spark, d), EPS, SECONDS).select("obj_id", "seq", "seg_id", "kind")


def _counts_sql(seg: str) -> str:
    dur = lambda k: f"coalesce(avg(CASE WHEN kind = '{k}' THEN e - s END), 0)"
    num = lambda k: f"coalesce(avg(CASE WHEN kind = '{k}' THEN n END), 0)"
    return f"""c AS (SELECT obj_id, seg_id, kind, min(t) AS s, max(t) AS e, count(*) AS n FROM {seg} GROUP BY ALL)
    SELECT obj_id, sum((kind = 'stop')::INT)::BIGINT AS n_stops, sum((kind = 'move')::INT)::BIGINT AS n_moves, {_m(dur('stop'))} AS mean_stop_s, {_m(dur('move'))} AS mean_move_s,
           {_m(num('stop'))} AS mean_stop_points, {_m(num('move'))} AS mean_move_points, sum(n)::BIGINT AS total_points FROM c GROUP BY obj_id"""


@_query("e12_segment_counts", f"{_STAY}, {_counts_sql('sp')}")
def e12_segment_counts(spark: SparkSession, d: str) -> DataFrame:
    return _micros(metrics.segment_counts(segmentation.segments(segmentation.stay_points(from_events(spark, d), EPS, SECONDS))))


_STOPS = {
    "centroid": "SELECT obj_id, seg_id, avg(lat) AS lat, avg(lon) AS lon, min(t) AS start_t, max(t) AS end_t, count(*) AS n_points FROM sp WHERE kind = 'stop' GROUP BY obj_id, seg_id",
    "first_point": "SELECT obj_id, seg_id, arg_min(lat, seq) AS lat, arg_min(lon, seq) AS lon, min(t) AS start_t, max(t) AS end_t, count(*) AS n_points FROM sp WHERE kind = 'stop' GROUP BY obj_id, seg_id",
    "snap_to_nearest": """SELECT obj_id, seg_id, first(lat ORDER BY dd, seq) AS lat, first(lon ORDER BY dd, seq) AS lon, min(t) AS start_t, max(t) AS end_t, count(*) AS n_points FROM (
        SELECT *, pow(lat - avg(lat) OVER w, 2) + pow(lon - avg(lon) OVER w, 2) AS dd FROM sp WHERE kind = 'stop' WINDOW w AS (PARTITION BY obj_id, seg_id)) GROUP BY obj_id, seg_id""",
    "medoid": """SELECT obj_id, seg_id, first(lat ORDER BY c, seq) AS lat, first(lon ORDER BY c, seq) AS lon, min(t) AS start_t, max(t) AS end_t, count(*) AS n_points FROM (
        SELECT x.obj_id, x.seg_id, x.seq, x.lat, x.lon, x.t, sum(sqrt(pow(x.lat - y.lat, 2) + pow(x.lon - y.lon, 2))) AS c FROM sp x JOIN sp y ON x.obj_id = y.obj_id AND x.seg_id = y.seg_id WHERE x.kind = 'stop' GROUP BY ALL) GROUP BY obj_id, seg_id""",
}
for _k, (_name, _sql) in enumerate({"c1_centroid": "centroid", "c2_snap_to_nearest": "snap_to_nearest", "c3_medoid": "medoid", "c4_first_point": "first_point"}.items()):
    _query(_name, f"{_STAY}, x AS ({_STOPS[_sql]}) SELECT obj_id, seg_id, {_m('lat')} AS lat, {_m('lon')} AS lon, {_m('start_t')} AS start_t, {_m('end_t')} AS end_t, n_points FROM x")(
        lambda spark, d, s=_sql: _micros(stops.compress(segmentation.stay_points(from_events(spark, d), EPS, SECONDS), s))
    )


@_query("e11_stop_errors", f"{_STAY}, r AS ({_STOPS['centroid']}) SELECT p.obj_id, p.seg_id, p.seq, {_mm(_PL.format(a='p', b='r'))} AS sed FROM sp p JOIN r ON p.obj_id = r.obj_id AND p.seg_id = r.seg_id WHERE p.kind = 'stop'")
def e11_stop_errors(spark: SparkSession, d: str) -> DataFrame:
    seg = segmentation.stay_points(from_events(spark, d), EPS, SECONDS)
    return _millis(metrics.stop_errors(seg, stops.compress(seg)).drop("t"))


@_query("d1_line_simplify", f"{_DP} SELECT obj_id, seq FROM kept")
def d1_line_simplify(spark: SparkSession, d: str) -> DataFrame:
    return moves.line_simplify(from_events(spark, d), eps=EPS).select("obj_id", "seq")


@_query("d2_line_simplify_moves", f"{_STAY}, mp AS (SELECT * FROM sp WHERE kind = 'move'), {_dp_sql('mp', 'dp', 'obj_id, seg_id')} SELECT obj_id, seg_id, seq FROM dp")
def d2_line_simplify_moves(spark: SparkSession, d: str) -> DataFrame:
    seg = segmentation.stay_points(from_events(spark, d), EPS, SECONDS)
    return moves.line_simplify(segmentation.moves(seg), moves.PER_SEGMENT, EPS).select("obj_id", "seg_id", "seq")


def _simplified(name: str, f, sql: str) -> None:
    _query(name, f"{_PTS}, {sql} SELECT obj_id, seq FROM x")(lambda spark, d: f(from_events(spark, d)).select("obj_id", "seq"))


_simplified("d3_buffer", lambda p: moves.buffer_simplify(p), _squish_sql("pts", "x", "50"))
_simplified("d4_hybrid", lambda p: moves.hybrid_simplify(p, capacity=60), _kept_sql("pts", "x", "hybrid", "obj_id", 60))
_simplified("d4_hybrid_refined", lambda p: moves.hybrid_simplify(p, capacity=60, refine=True), _kept_sql("pts", "x", "hybrid_refined", "obj_id", 60))
_simplified("d5_chain", lambda p: moves.chain_simplify(p), _kept_sql("pts", "x", "chain", "obj_id", 50))
_simplified("d6_dynamic_buffer", lambda p: moves.buffer_simplify_dynamic(p), _squish_sql("pts", "x", "greatest(10, floor(0.3 * q.n)::BIGINT)"))


@_query("d7_road_changes", f"""{_PTS}, l AS (SELECT *, lag(road_id) OVER w AS r, row_number() OVER w AS i, lead(seq) OVER w AS nx FROM pts WINDOW w AS (PARTITION BY obj_id ORDER BY seq))
    SELECT obj_id, seq, road_id FROM l WHERE i = 1 OR nx IS NULL OR road_id IS DISTINCT FROM r""")  # fmt: skip
def d7_road_changes(spark: SparkSession, d: str) -> DataFrame:
    return moves.road_changes(from_events(spark, d)).select("obj_id", "seq", "road_id")


_V = "6371000.0 * sqrt(pow(radians(p.lon - q.lon) * cos((radians(q.lat) + radians(p.lat)) / 2), 2) + pow(radians(p.lat) - radians(q.lat), 2))"


@_query(
    "d9_speed_entries",
    f"""{_PTS}, run AS (
        SELECT obj_id, seq, road_id, 0.0::DOUBLE AS o, 0.0::DOUBLE AS stored, true AS kept, 0.0::DOUBLE AS v FROM pts WHERE seq = 0
        UNION ALL
        SELECT obj_id, seq, road_id, CASE WHEN turn THEN 0 ELSE o + m END, CASE WHEN turn THEN 0 WHEN abs(m / dt - stored) > 3.8 THEN m / dt ELSE stored END, turn OR abs(m / dt - stored) > 3.8, CASE WHEN turn THEN 0 ELSE m / dt END
        FROM (SELECT p.obj_id, p.seq, p.road_id, r.o, r.stored, p.road_id IS DISTINCT FROM r.road_id AS turn, {_V} AS m, p.t - q.t AS dt
              FROM run r JOIN pts p ON p.obj_id = r.obj_id AND p.seq = r.seq + 1 JOIN pts q ON q.obj_id = r.obj_id AND q.seq = r.seq))
    SELECT obj_id, seq, road_id, 1::BIGINT AS direction, {_mm('o')} AS offset_m, {_mm('v')} AS speed FROM run WHERE kept""",
)
def d9_speed_entries(spark: SparkSession, d: str) -> DataFrame:
    from wayfold.schema import ReferenceCoding

    return _millis(moves.speed_representation(from_events(spark, d), coding=ReferenceCoding(gamma=3.8)))


@_query("d10_referential_coding")
def d10_referential_coding(spark: SparkSession, d: str) -> DataFrame:
    seg = segmentation.stay_points(from_events(spark, d), EPS, SECONDS)
    return moves.referential_coding(segmentation.moves(seg)).select("obj_id", "seg_id", "encoded_bytes", F.size("e").alias("n_e"), F.size("v").alias("n_v"), "references")


@_query(
    "d17_retained_points",
    f"""{_STAY}, mp AS (SELECT *, row_number() OVER w AS i, lead(seq) OVER w IS NULL AS ends FROM sp WHERE kind = 'move' WINDOW w AS (PARTITION BY obj_id, seg_id ORDER BY seq)), run AS (
        SELECT obj_id, seg_id, i, seq, road_id, ends, 0.0::DOUBLE AS stored, 'road_change' AS reason FROM mp WHERE i = 1
        UNION ALL
        SELECT obj_id, seg_id, i, seq, road_id, ends, CASE WHEN turn THEN 0 WHEN abs(v - stored) > 50 THEN v ELSE stored END, CASE WHEN turn THEN 'road_change' WHEN abs(v - stored) > 50 THEN 'speed_change' WHEN ends THEN 'forced_last' END
        FROM (SELECT p.obj_id, p.seg_id, p.i, p.seq, p.road_id, p.ends, r.stored, p.road_id IS DISTINCT FROM r.road_id AS turn, {_V} / (p.t - q.t) AS v
              FROM run r JOIN mp p ON p.obj_id = r.obj_id AND p.seg_id = r.seg_id AND p.i = r.i + 1 JOIN mp q ON q.obj_id = r.obj_id AND q.seg_id = r.seg_id AND q.i = r.i))
    SELECT obj_id, seg_id, seq, reason FROM run WHERE reason IS NOT NULL""",
)
def d17_retained_points(spark: SparkSession, d: str) -> DataFrame:
    seg = segmentation.stay_points(from_events(spark, d), EPS, SECONDS)
    return moves.retained_points(segmentation.moves(seg)).select("obj_id", "seg_id", "seq", "reason")


@_query("m2_density_clusters", f"{_PTS}, {_labels_sql(EPS, SAMPLES)} SELECT p.obj_id, p.seq, coalesce(l.label, -1)::BIGINT AS label FROM pts p LEFT JOIN lab l ON l.obj_id = p.obj_id AND l.seq = p.seq")
def m2_density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.density_clusters(from_events(spark, d), EPS, SAMPLES).select("obj_id", "seq", "label")


@_query("m3_reachability_clusters")
def m3_reachability_clusters(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.density_clusters(from_events(spark, d), EPS, SAMPLES, "optics").select("obj_id", "seq", "label")


_LABEL = "CASE WHEN floor(seq / 9) % 3 = 0 THEN -1 ELSE floor(seq / 9)::BIGINT % 3 END"


@_query(
    "m4_m5_label_runs",
    f"""{_PTS}, la AS (SELECT *, {_LABEL} AS label FROM pts), r1 AS (SELECT *, (label IS DISTINCT FROM lag(label) OVER w)::INT AS c FROM la WINDOW w AS (PARTITION BY obj_id ORDER BY seq)),
    r2 AS (SELECT *, sum(c) OVER (PARTITION BY obj_id ORDER BY seq) AS g FROM r1), r3 AS (SELECT *, CASE WHEN label <> -1 AND max(t) OVER v - min(t) OVER v >= 45 THEN 'stop' ELSE 'move' END AS kind FROM r2 WINDOW v AS (PARTITION BY obj_id, g)),
    r4 AS (SELECT *, CASE WHEN g = lag(g) OVER w OR (kind = 'move' AND lag(kind) OVER w = 'move') THEN 0 ELSE 1 END AS n FROM r3 WINDOW w AS (PARTITION BY obj_id ORDER BY seq))
    SELECT obj_id, seq, kind, (sum(n) OVER (PARTITION BY obj_id ORDER BY seq) - 1)::BIGINT AS seg_id FROM r4""",
)
def m4_m5_label_runs(spark: SparkSession, d: str) -> DataFrame:
    block = F.floor(F.col("seq") / 9)
    labelled = from_events(spark, d).withColumn("label", F.when(block % 3 == 0, -1).otherwise(block % 3).cast("long"))
    return segmentation.post_process(segmentation.label_runs(labelled), 45.0).select("obj_id", "seq", "kind", "seg_id")


@_query("e5_synchronized_errors", f"{_DP}, {_sed_sql('kept', 'err')} SELECT obj_id, seq, {_mm('sed')} AS sed FROM err")
def e5_synchronized_errors(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    return _millis(metrics.synchronized_errors(p, moves.line_simplify(p, eps=EPS)).drop("t"))


_Q = lambda q: _mm(f"quantile_cont(sed, {q})")


@_query(
    "e7_error_bundle",
    f"""{_DP}, {_sed_sql('kept', 'err')} SELECT obj_id, {_mm('avg(sed)')} AS mean, {_Q(0.5)} AS median, {_Q(0.1)} AS p10, {_Q(0.95)} AS p95, {_Q(0.99)} AS p99, {_mm('max(sed)')} AS max, {_mm('sqrt(avg(sed * sed))')} AS rmse,
    {_mm('100 * avg((sed <= 5)::INT)')} AS pct_5m, {_mm('100 * avg((sed <= 10)::INT)')} AS pct_10m FROM err GROUP BY obj_id""",
)
def e7_error_bundle(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    return _millis(metrics.error_bundle(metrics.synchronized_errors(p, moves.line_simplify(p, eps=EPS))).drop("quantiles"))


@_query("e8_pooled_errors", f"{_DP}, {_sed_sql('kept', 'err')} SELECT {_mm('avg(sed)')} AS average_sed, {_mm('max(sed)')} AS max_sed, {_mm('sqrt(avg(sed * sed))')} AS rmse, count(*) AS n FROM err")
def e8_pooled_errors(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    return _millis(metrics.error_stats(metrics.synchronized_errors(p, moves.line_simplify(p, eps=EPS)), ()))


@_query("e9_error_outliers", f"""{_STAY}, {_dp_sql('pts', 'dp')}, kept AS (SELECT p.* FROM pts p JOIN dp USING (obj_id, seq)), {_sed_sql('kept', 'err')},
    rk AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY {_mm('sed')} DESC, seq) AS rank FROM err) SELECT r.obj_id, r.rank, r.seq, {_mm('r.sed')} AS sed, s.seg_id, s.kind FROM rk r JOIN sp s ON s.obj_id = r.obj_id AND s.seq = r.seq WHERE r.rank <= 3""")  # fmt: skip
def e9_error_outliers(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    kept = moves.line_simplify(p, eps=EPS)
    errors = metrics.synchronized_errors(p, kept).withColumn("sed", micro("sed", 1e3))
    return _millis(metrics.error_outliers(errors, segmentation.stay_points(p, EPS, SECONDS), kept, 3))


@_query("e10_retention", f"""{_DP}, g AS (SELECT obj_id, t - lag(t) OVER w AS gap, sqrt(pow((lat - lag(lat) OVER w) * 111320.0, 2) + pow((lon - lag(lon) OVER w) * 111320.0 * cos(radians((lat + lag(lat) OVER w) / 2)), 2)) AS jump FROM kept WINDOW w AS (PARTITION BY obj_id ORDER BY seq))
    SELECT obj_id, {_mm('avg(gap)')} AS mean_gap, {_mm('quantile_cont(gap, 0.95)')} AS p95_gap, {_mm('max(gap)')} AS max_gap, {_mm('avg(jump)')} AS mean_jump, {_mm('quantile_cont(jump, 0.95)')} AS p95_jump, {_mm('max(jump)')} AS max_jump FROM g WHERE gap IS NOT NULL GROUP BY obj_id""")  # fmt: skip
def e10_retention(spark: SparkSession, d: str) -> DataFrame:
    return _millis(metrics.retention(moves.line_simplify(from_events(spark, d), eps=EPS)))


@_query(
    "e15_stop_f1",
    f"""{_STAY}, {_stay_sql(25.0, 45.0, '2')}, a AS (SELECT obj_id, seg_id, min(t) AS s, max(t) AS e FROM sp WHERE kind = 'stop' GROUP BY ALL), b AS (SELECT obj_id, seg_id, min(t) AS s, max(t) AS e FROM sp2 WHERE kind = 'stop' GROUP BY ALL),
    m AS (SELECT a.obj_id, (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) AS iou FROM a JOIN b ON a.obj_id = b.obj_id AND a.s < b.e AND b.s < a.e WHERE (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) > 0.5),
    n AS (SELECT coalesce(x.obj_id, y.obj_id) AS obj_id, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng FROM (SELECT obj_id, count(*) AS np FROM a GROUP BY 1) x FULL JOIN (SELECT obj_id, count(*) AS ng FROM b GROUP BY 1) y ON x.obj_id = y.obj_id),
    f AS (SELECT n.obj_id, np, ng, count(iou) AS tp, coalesce(avg(iou), 0) AS i FROM n LEFT JOIN m USING (obj_id) GROUP BY n.obj_id, np, ng)
    SELECT obj_id, tp, np - tp AS fp, ng - tp AS fn, {_m('CASE WHEN np > 0 THEN tp / np ELSE 0 END')} AS precision, {_m('CASE WHEN ng > 0 THEN tp / ng ELSE 0 END')} AS recall, {_m('CASE WHEN tp > 0 THEN 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) ELSE 0 END')} AS f1, {_m('i')} AS matched_iou_mean FROM f""",
)
def e15_stop_f1(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    side = lambda e, s: segmentation.segments(segmentation.stay_points(p, e, s))
    return _micros(metrics.stop_f1(side(EPS, SECONDS), side(25.0, 45.0)))


@_query("e16_road_jaccard", f"""{_DP}, a AS (SELECT DISTINCT obj_id, road_id FROM pts WHERE road_id IS NOT NULL), b AS (SELECT DISTINCT obj_id, road_id FROM kept WHERE road_id IS NOT NULL)
    SELECT obj_id, {_m('sum((x AND y)::INT) / count(*)')} AS jaccard FROM (SELECT coalesce(a.obj_id, b.obj_id) AS obj_id, a.road_id IS NOT NULL AS x, b.road_id IS NOT NULL AS y FROM a FULL JOIN b ON a.obj_id = b.obj_id AND a.road_id = b.road_id) GROUP BY obj_id""")  # fmt: skip
def e16_road_jaccard(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    return _micros(metrics.road_jaccard(p, moves.line_simplify(p, eps=EPS)))


@_query("e17_latency", f"""SELECT user_id, count(value) AS count, {_m('avg(value)')} AS mean, {_m('max(value)')} AS max, {_m('min(value)')} AS min, {_m('list_sort(list(value))[round_even(0.95 * (count(value) - 1), 0)::INT + 1]')} AS p95 FROM events GROUP BY user_id""")
def e17_latency(spark: SparkSession, d: str) -> DataFrame:
    return _micros(metrics.latency_stats(events_in_order(spark, d), "value", ("user_id",), FILE_ORDER))


@_query("e20_contract", f"""SELECT event_type AS pipeline, (user_id % 3)::VARCHAR AS metric, {_m('avg(v)')} AS mean, {_m('quantile_cont(v, 0.5)')} AS median, {_m('quantile_cont(v, 0.95)')} AS p95
    FROM (SELECT *, CASE WHEN user_id % 3 = 2 OR event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY ALL""")  # fmt: skip
def e20_contract(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    gone = (F.col("user_id") % 3 == 2) | (F.col("event_id") % 5 == 0)
    value = metrics.normalise_metric(F.when(~gone, F.col("value")))
    return _micros(metrics.contract_aggregate(e.select(F.col("event_type").alias("pipeline"), (F.col("user_id") % 3).cast("string").alias("metric"), value.alias("value"))))


@_query("e22_strategy_summary", f"""SELECT strategy, count(*) AS files, {_m('avg(cr)')} AS cr_mean, {_m('min(cr)')} AS cr_min, {_m('max(cr)')} AS cr_max, {_m('sum(o) / sum(e)')} AS cr_global, sum(o)::BIGINT AS original_bytes, sum(e)::BIGINT AS encoded_bytes
    FROM (SELECT event_type AS strategy, user_id, count(*) * 24 AS o, (1 + count(*) // 3) * 24 AS e, (count(*) * 24) / ((1 + count(*) // 3) * 24) AS cr FROM events GROUP BY event_type, user_id) GROUP BY strategy""")  # fmt: skip
def e22_strategy_summary(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("strategy"), "user_id").agg(F.count("*").alias("n"))
    enc = (1 + F.floor(F.col("n") / 3)) * 24
    return _micros(metrics.strategy_summary(e.select("strategy", (F.col("n") * 24).alias("original_bytes"), enc.cast("long").alias("encoded_bytes"), metrics.byte_ratio(F.col("n"), enc).alias("cr"))))


@_query("e23_same_streams", f"""{_PTS}, {_kept_sql('pts', 'x', 'buffer', 'obj_id', 60)}, {_kept_sql('pts', 'y', 'hybrid', 'obj_id', 60)}
    SELECT coalesce(x.obj_id, y.obj_id) AS obj_id, bool_and(x.seq IS NOT NULL AND y.seq IS NOT NULL) AS identical FROM x FULL JOIN y ON x.obj_id = y.obj_id AND x.seq = y.seq GROUP BY 1""")  # fmt: skip
def e23_same_streams(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    return metrics.same_streams(moves.buffer_simplify(p, capacity=60), moves.hybrid_simplify(p, capacity=60))


@_query("e24_ranked_deltas", """WITH d AS (SELECT event_type AS family, user_id::VARCHAR AS obj_id, (floor(avg(value % 7) * 1000) - floor(avg(value % 5) * 1000))::BIGINT AS delta FROM events GROUP BY event_type, user_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY delta, obj_id) AS i, row_number() OVER (PARTITION BY family ORDER BY delta DESC, obj_id) AS j FROM d)
    SELECT family, 'improvement' AS side, i AS rank, obj_id, delta FROM r WHERE i <= 5 UNION ALL SELECT family, 'degradation', j, obj_id, delta FROM r WHERE j <= 5""")  # fmt: skip
def e24_ranked_deltas(spark: SparkSession, d: str) -> DataFrame:
    e = events_in_order(spark, d).select(F.col("event_type").alias("family"), F.col("user_id").cast("string").alias("obj_id"), "value", *FILE_ORDER)
    means = metrics.ordered_means(e, ["family", "obj_id"], {n: F.col("value") % k for n, k in (("baseline", 5), ("hybrid", 7))}, FILE_ORDER)
    return _micros(metrics.ranked_deltas(means.select("family", "obj_id", *[F.floor(F.col(n) * 1000).cast("long").alias(n) for n in ("baseline", "hybrid")])))


@_query("e26_branch_counts", f"{_STAY}, c AS (SELECT obj_id, seg_id, count(*) AS n FROM sp WHERE kind = 'move' GROUP BY ALL) SELECT sum((n <= 8)::INT)::BIGINT AS short_moves, sum((n > 8)::INT)::BIGINT AS long_moves, sum((n > 8)::INT)::BIGINT AS refine_calls FROM c")
def e26_branch_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.branch_counts(segmentation.segments(segmentation.stay_points(from_events(spark, d), EPS, SECONDS)), CAPACITY, True)


@_query("v1_evenly_spaced", f"""{_PTS}, n AS (SELECT *, count(*) OVER (PARTITION BY obj_id) AS c FROM pts), k AS (SELECT DISTINCT obj_id, floor(i * (c - 1) / 19)::BIGINT AS seq FROM (SELECT DISTINCT obj_id, c FROM n WHERE c > 20) CROSS JOIN range(20) r(i))
    SELECT obj_id, seq FROM n WHERE c <= 20 UNION ALL SELECT obj_id, seq FROM k""")  # fmt: skip
def v1_evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evenly_spaced(from_events(spark, d), 20).select("obj_id", "seq")


@_query("v3_running_counters", f"""{_STAY}, o AS (SELECT *, seg_id IS DISTINCT FROM lag(seg_id) OVER (PARTITION BY obj_id ORDER BY seq) AS n FROM sp) SELECT obj_id, seq, count(*) OVER w AS points, (sum((n AND kind = 'stop')::INT) OVER w)::BIGINT AS stops, (sum((n AND kind = 'move')::INT) OVER w)::BIGINT AS moves, greatest(1, count(*) OVER w // 10)::BIGINT AS estimate FROM o WINDOW w AS (PARTITION BY obj_id ORDER BY seq)""")
def v3_running_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running_counters(segmentation.stay_points(from_events(spark, d), EPS, SECONDS))


@_query("p1_line_only", f"{_DP}, line AS (SELECT *, 1 AS stored FROM kept), {_eval_sql('line', 'x')} SELECT {_RECORD} FROM x")
def p1_line_only(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    return _millis(metrics.evaluation(p, moves.line_simplify(p, eps=EPS)))


_OFFLINE = f"{_PTS}, {_offline_sql(EPS, SECONDS, SAMPLES)}, mpd AS (SELECT * FROM spd WHERE kind = 'move')"


@_query("p2_offline_geometric", f"{_OFFLINE}, {_dp_sql('mpd', 'kd', 'obj_id, seg_id')}, {_recon_sql('spd', 'kd', 'rd')}, {_eval_sql('rd', 'x')} SELECT {_RECORD} FROM x")
def p2_offline_geometric(spark: SparkSession, d: str) -> DataFrame:
    return _millis(pipelines.offline_evaluation(from_events(spark, d), min_samples=SAMPLES, backend="manual"))


@_query("p2_offline_geometric_reachability")
def p2_offline_geometric_reachability(spark: SparkSession, d: str) -> DataFrame:
    return _millis(pipelines.offline_evaluation(from_events(spark, d), min_samples=SAMPLES, backend="optics"))


@_query(
    FLAGSHIP,
    f"""{_STAY}, mp AS (SELECT * FROM sp WHERE kind = 'move'), {_kept_sql('mp', 'kc', 'chain', 'obj_id, seg_id', CAPACITY)},
    n AS (SELECT obj_id, count(*) AS original_points FROM pts GROUP BY 1), g AS (SELECT obj_id, seg_id, kind, CASE WHEN kind = 'stop' THEN 1 ELSE (SELECT count(*) FROM kc WHERE kc.obj_id = s.obj_id AND kc.seg_id = s.seg_id) END AS k FROM (SELECT DISTINCT obj_id, seg_id, kind FROM sp) s)
    SELECT n.obj_id, original_points, (sum(k) * 24)::BIGINT AS encoded_bytes, sum(k)::BIGINT AS stored_points, sum((kind = 'stop')::INT)::BIGINT AS stops, sum((kind = 'move')::INT)::BIGINT AS moves, original_points * 24 AS original_bytes,
           {_m('original_points * 24 / (sum(k) * 24)')} AS compression_ratio FROM n JOIN g USING (obj_id) GROUP BY n.obj_id, original_points""",
)
def p3_geometric_summary(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    return _micros(pipelines.trajectory_results(p, pipelines.online(p, Compression(capacity=CAPACITY))))


@_query("p4_offline_network", f"""{_OFFLINE}, kd AS (SELECT obj_id, seg_id, seq FROM (SELECT *, row_number() OVER w AS i, lag(road_id) OVER w AS r, lead(seq) OVER w AS nx FROM mpd WINDOW w AS (PARTITION BY obj_id, seg_id ORDER BY seq)) WHERE i = 1 OR nx IS NULL OR road_id IS DISTINCT FROM r),
    {_recon_sql('spd', 'kd', 'rd')}, {_eval_sql('rd', 'x')} SELECT {_RECORD} FROM x""")  # fmt: skip
def p4_offline_network(spark: SparkSession, d: str) -> DataFrame:
    return _millis(pipelines.offline_evaluation(from_events(spark, d), min_samples=SAMPLES, backend="manual", network=True))


@_query("p5_network_summary")
def p5_network_summary(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    return _micros(pipelines.trajectory_results(p, pipelines.online(p, Compression(strategy="network_semantic"))))


@_query("p6_stop_only", f"{_STAY}, x AS ({_STOPS['centroid']}) SELECT obj_id, (SELECT count(*) FROM x WHERE x.obj_id = n.obj_id) + (SELECT count(*) FROM sp WHERE sp.obj_id = n.obj_id AND kind = 'move') AS n FROM (SELECT DISTINCT obj_id FROM pts) n")
def p6_stop_only(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.stored_counts(*pipelines.stop_only(segmentation.stay_points(from_events(spark, d), EPS, SECONDS)))


def _ablation_sql() -> str:
    parts, rows = [f"{_PTS}, {_stay_sql(EPS, SECONDS, 'o')}, {_offline_sql(EPS, SECONDS, SAMPLES)}", "mpd AS (SELECT * FROM spd WHERE kind = 'move')", "mpo AS (SELECT * FROM spo WHERE kind = 'move')"], []
    for variant in pipelines.ABLATION:
        side, how = variant.split("_", 1)
        if side == "full":
            parts += [_kept_sql("pts", f"k_{variant}", how, "obj_id", 10), f"r_{variant} AS (SELECT p.obj_id, p.t, p.lat, p.lon, 1 AS stored FROM pts p JOIN k_{variant} USING (obj_id, seq))"]
        else:
            tag = "d" if side == "offline" else "o"
            parts += [_kept_sql(f"mp{tag}", f"k_{variant}", how, "obj_id, seg_id", 10), _recon_sql(f"sp{tag}", f"k_{variant}", f"r_{variant}")]
        parts.append(_eval_sql(f"r_{variant}", f"e_{variant}"))
        rows.append(f"SELECT '{variant}' AS variant, * FROM e_{variant}")
    q = lambda c, p: _mm(f"quantile_cont({c}, {p})")
    return f"""{', '.join(parts)} SELECT variant, {_mm('avg(avg_sed_m)')} AS mean_sed, {q('avg_sed_m', 0.5)} AS median_sed, {q('avg_sed_m', 0.95)} AS p95_sed, {q('avg_sed_m', 0.99)} AS p99_sed,
        {_mm('avg(cr)')} AS mean_cr, {q('cr', 0.5)} AS median_cr, {_mm('avg(pct_5m)')} AS mean_pct_5m FROM ({' UNION ALL '.join(rows)}) GROUP BY variant"""


@_query("p7_ablation", _ablation_sql())
def p7_ablation(spark: SparkSession, d: str) -> DataFrame:
    rows = pipelines.ablation(from_events(spark, d), min_samples=SAMPLES).withColumnRenamed("avg_sed_m", "average_sed")
    return _millis(metrics.variant_summary(rows))


SWEEP = (5, 10, 15, 25, 50)


def _sweep_sql() -> str:
    ctes = [x for e in SWEEP for x in (_dp_sql("pts", f"dp{e}", eps=e), f"kp{e} AS (SELECT p.* FROM pts p JOIN dp{e} USING (obj_id, seq))", _sed_sql(f"kp{e}", f"er{e}"))]
    rows = " UNION ALL ".join(f"SELECT {e}::DOUBLE AS eps, avg(sed) AS mean_sed, quantile_cont(sed, 0.95) AS p95_sed, max(sed) AS max_sed, count(*) AS n_points, (SELECT count(*) FROM kp{e}) AS kept FROM er{e}" for e in SWEEP)
    return f"{_PTS}, {', '.join(ctes)}, sweep AS ({rows})"


@_query("x1_epsilon_sweep", f"{_sweep_sql()} SELECT eps, {_mm('mean_sed')} AS mean_sed, {_mm('p95_sed')} AS p95_sed, {_mm('max_sed')} AS max_sed, n_points, kept, {_mm('n_points / kept')} AS cr FROM sweep")
def x1_epsilon_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _millis(experiments.epsilon_sweep(from_events(spark, d), SWEEP), "eps")


def _sweep_runs_sql() -> str:
    """CTEs that end in ``runs``: one row per config and object, in plain units."""
    ctes, rows, labels = [_PTS, "np AS (SELECT obj_id, count(*) AS n_points FROM pts GROUP BY 1 HAVING count(*) >= 5)"], [], set()
    for e in experiments.EPS_GRID:
        for t in experiments.SECONDS_GRID:
            k, tag = max(5, round(t * 0.5)), f"_{e:g}_{t:g}"
            known = f"_{e:g}_{k}"
            if known not in labels:
                labels.add(known)
                ctes.append(_labels_sql(e, k, known))
            ctes += [_stay_sql(e, t, tag), _offline_sql(e, t, k, f"d{tag}", known)]
            spans = lambda sp: f"SELECT obj_id, seg_id, kind, min(t) AS s, max(t) AS e, count(*) AS n FROM {sp} GROUP BY ALL"
            ctes += [f"a{tag} AS ({spans(f'sp{tag}')})", f"b{tag} AS ({spans(f'spd{tag}')})"]
            iou = "(least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s))"
            ctes.append(f"i{tag} AS (SELECT a.obj_id, count(*) AS tp, avg({iou}) AS m FROM a{tag} a JOIN b{tag} b ON a.obj_id = b.obj_id AND a.kind = 'stop' AND b.kind = 'stop' AND a.s < b.e AND b.s < a.e WHERE {iou} >= 0.5 GROUP BY 1)")
            count = lambda x, p: f"(SELECT obj_id, sum((kind = 'stop')::INT)::BIGINT AS {p}_n_stops, sum((kind = 'move')::INT)::BIGINT AS {p}_n_moves, coalesce(avg(e - s) FILTER (kind = 'stop'), 0) AS {p}_mean_stop_s, coalesce(avg(n) FILTER (kind = 'move'), 0) AS {p}_mean_move_pts FROM {x}{tag} GROUP BY 1)"
            rows.append(f"SELECT {e}::DOUBLE AS eps_m, {t}::DOUBLE AS t_s, {k}::BIGINT AS min_samples, np.*, x.* EXCLUDE (obj_id), y.* EXCLUDE (obj_id), coalesce(tp, 0) AS tp, coalesce(m, 0) AS m FROM np JOIN {count('a', 'step')} x USING (obj_id) JOIN {count('b', 'stss')} y USING (obj_id) LEFT JOIN i{tag} USING (obj_id)")
    p, r = "(CASE WHEN step_n_stops > 0 THEN tp / step_n_stops ELSE 0 END)", "(CASE WHEN stss_n_stops > 0 THEN tp / stss_n_stops ELSE 0 END)"
    return f"""{', '.join(ctes)}, runs AS (SELECT * EXCLUDE (tp, m), CASE WHEN tp > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END AS f1, {p} AS precision, {r} AS recall, m AS matched_iou_mean FROM ({' UNION ALL '.join(rows)}))"""


_RUNS = _sweep_runs_sql()


def _segment_sweep_sql() -> str:
    return f"{_RUNS} SELECT eps_m, t_s, min_samples, obj_id, n_points, step_n_stops, step_n_moves, stss_n_stops, stss_n_moves, {_m('f1')} AS f1, {_m('precision')} AS precision, {_m('recall')} AS recall, {_m('matched_iou_mean')} AS matched_iou_mean FROM runs"


@_query("x3_segmentation_sweep", _segment_sweep_sql())
def x3_segmentation_sweep(spark: SparkSession, d: str) -> DataFrame:
    more = [f"{a}_{b}" for a in ("step", "stss") for b in ("mean_stop_s", "mean_move_pts", "wall_s")]
    return _micros(experiments.segmentation_sweep(from_events(spark, d)).drop(*more), "eps_m", "t_s")


_TIMELESS = tuple(c for c in experiments.SWEEP_METRICS if not c.endswith("wall_s"))


def _aggregate_sql() -> str:
    stats = ("mean", "avg({c})"), ("median", "quantile_cont({c}, 0.5)"), ("std", "coalesce(stddev_samp({c}), 0)"), ("min", "min({c})"), ("max", "max({c})")
    return f"""{_RUNS}, agg AS (SELECT eps_m, t_s, min_samples, count(*) AS n_trajectories, {', '.join(f"{f.format(c=c)}::DOUBLE AS {c}_{k}" for c in _TIMELESS for k, f in stats)} FROM runs GROUP BY eps_m, t_s, min_samples),
    best AS (SELECT *, step_n_stops_median >= 2 AND step_n_moves_median >= 2 AND f1_median > 0.6 AS passes FROM agg)"""


_FIVE = [f"{c}_{k}" for c in _TIMELESS for k in ("mean", "median", "std", "min", "max")]


@_query("x5_sweep_aggregate", f"{_aggregate_sql()} SELECT eps_m, t_s, min_samples, n_trajectories, {', '.join(f'{_m(c)} AS {c}' for c in _FIVE)}, passes, true AS timed FROM best")
def x5_sweep_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """All 15 metrics are aggregated; those of the two wall times differ from run to run and are told by ``timed`` only."""
    found = experiments.sweep_aggregate(experiments.segmentation_sweep(from_events(spark, d)))
    walls = [c for c in found.columns if "wall_s" in c or "ms_per_point" in c]
    timed = (F.col("step_wall_s_min") > 0) & (F.col("stss_wall_s_min") > 0) & (F.col("step_ms_per_point_mean") > 0)
    found = found.withColumn("timed", timed).drop(*walls)
    doubles = found.select(*experiments.CONFIG, "n_trajectories", *[F.col(c).cast("double").alias(c) for c in _FIVE], "passes", "timed")
    return _micros(doubles, "eps_m", "t_s")


_TRIPLE = "WITH_PTS, tr AS (SELECT obj_id, seq, lat, lon, t, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lag(t) OVER w AS lt, lead(lat) OVER w AS na, lead(lon) OVER w AS no, lead(t) OVER w AS nt FROM pts WINDOW w AS (PARTITION BY obj_id ORDER BY seq))".replace("WITH_PTS", _PTS)
_C3, _R = "cos(radians((la + na + lat) / 3))", "((t - lt) / (nt - lt))"


@_query(
    "g_segment_distances",
    f"""{_TRIPLE} SELECT obj_id, seq, {_mm(f'abs((na - la) * 111320.0 * (lon - lo) * 111320.0 * {_C3} - (no - lo) * 111320.0 * {_C3} * (lat - la) * 111320.0) / sqrt(pow((na - la) * 111320.0, 2) + pow((no - lo) * 111320.0 * {_C3}, 2))')} AS perpendicular,
    {_mm(f'sqrt(pow((lat - (la + (na - la) * {_R})) * 111320.0, 2) + pow((lon - (lo + (no - lo) * {_R})) * 111320.0 * cos(radians((la + na) / 2)), 2))')} AS synchronized,
    {_m(f'sqrt(pow(lat - (la + (na - la) * {_R}), 2) + pow(lon - (lo + (no - lo) * {_R}), 2))')} AS priority FROM tr WHERE la IS NOT NULL AND na IS NOT NULL AND NOT (la = na AND lo = no)""",
)
def g_segment_distances(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("obj_id").orderBy("seq")
    lat, lon, t = F.col("lat"), F.col("lon"), F.col("t")
    sides = {f"{side}{k}": f(c).over(w) for side, f in (("a", F.lag), ("b", F.lead)) for k, c in enumerate(("lat", "lon", "t"))}
    rows = from_events(spark, d).withColumns(sides).where("a0 IS NOT NULL AND b0 IS NOT NULL AND NOT (a0 = b0 AND a1 = b1)")
    p, q = [F.col(f"a{k}") for k in range(3)], [F.col(f"b{k}") for k in range(3)]
    return rows.select("obj_id", "seq", micro(geo.perpendicular(lat, lon, *p[:2], *q[:2]), 1e3).alias("perpendicular"), micro(geo.synchronized(lat, lon, t, *p, *q), 1e3).alias("synchronized"), micro(geo.synchronized_degrees(*p, lat, lon, t, *q)).alias("priority"))


@_query("g_mercator", f"{_PTS} SELECT obj_id, seq, {_mm('radians(lon) * 6378137.0')} AS east, {_mm('ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0')} AS north FROM pts")
def g_mercator(spark: SparkSession, d: str) -> DataFrame:
    east, north = geo.web_mercator(F.col("lat"), F.col("lon"))
    return _millis(from_events(spark, d).select("obj_id", "seq", east.alias("east"), north.alias("north")))


@_query("g_grid_cells", f"""{_PTS}, o AS (SELECT *, first_value(lat) OVER w AS la, first_value(lon) OVER w AS lo FROM pts WINDOW w AS (PARTITION BY obj_id ORDER BY seq))
    SELECT obj_id, seq, floor(radians(lon - lo) * 6371000.0 * cos(radians(la)) / 5.3)::BIGINT AS x, floor(radians(lat - la) * 6371000.0 / 5.3)::BIGINT AS y FROM o""")  # fmt: skip
def g_grid_cells(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("obj_id").orderBy("seq")
    x, y = geo.grid_cell(F.col("lat"), F.col("lon"), F.first("lat").over(w), F.first("lon").over(w), 5.3)
    return from_events(spark, d).select("obj_id", "seq", x.alias("x"), y.alias("y"))


@_query("e21_stop_points", f"{_STAY} SELECT count(DISTINCT obj_id || ':' || seg_id) AS stops, count(*) AS stop_points, count(DISTINCT obj_id) AS objects FROM sp WHERE kind = 'stop'")
def e21_stop_points(spark: SparkSession, d: str) -> DataFrame:
    seg = segmentation.stops(segmentation.stay_points(from_events(spark, d), EPS, SECONDS))
    per = segmentation.segments(seg)
    return per.agg(F.count("*").alias("stops"), F.sum("n_points").alias("stop_points"), F.countDistinct("obj_id").alias("objects"))


@_query("e25_variant_summary", f"""SELECT event_type AS variant, {_m('avg(value)')} AS mean_sed, {_m('quantile_cont(value, 0.5)')} AS median_sed, {_m('quantile_cont(value, 0.95)')} AS p95_sed, {_m('quantile_cont(value, 0.99)')} AS p99_sed,
    {_m('avg((user_id % 7)::DOUBLE)')} AS mean_cr, {_m('quantile_cont((user_id % 7)::DOUBLE, 0.5)')} AS median_cr, {_m('avg((event_id % 3)::DOUBLE)')} AS mean_pct_5m FROM events GROUP BY event_type""")  # fmt: skip
def e25_variant_summary(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return _micros(metrics.variant_summary(e.select(F.col("event_type").alias("variant"), F.col("value").alias("average_sed"), (F.col("user_id") % 7).cast("double").alias("cr"), (F.col("event_id") % 3).cast("double").alias("pct_5m"))))


BASELINE_EPS = 10


@_query("x2_select_epsilon", f"{_sweep_sql()}, base AS (SELECT p95_sed AS most FROM sweep WHERE eps = {BASELINE_EPS}) SELECT eps::BIGINT AS eps, {_mm('n_points / kept')} AS cr, {_mm('sweep.p95_sed')} AS p95_sed, {_mm('sweep.mean_sed')} AS mean_sed FROM sweep, base ORDER BY sweep.p95_sed <= most DESC, n_points / kept DESC, sweep.p95_sed, sweep.mean_sed, sweep.eps LIMIT 1")
def x2_select_epsilon(spark: SparkSession, d: str) -> DataFrame:
    best = experiments.select_epsilon_against(experiments.epsilon_sweep(from_events(spark, d), SWEEP), BASELINE_EPS)
    return best.select(F.col("eps").cast("long").alias("eps"), *[micro(c, 1e3).alias(c) for c in ("cr", "p95_sed", "mean_sed")])


@_query("x4_sweep_summary", f"""{_RUNS} SELECT eps_m, t_s, count(*) AS n, {_m('quantile_cont(f1, 0.5)')} AS median_f1, {_m('quantile_cont(step_n_stops, 0.5)')} AS median_step_n_stops, {_m('quantile_cont(stss_n_stops, 0.5)')} AS median_stss_n_stops, true AS timed FROM runs GROUP BY eps_m, t_s""")
def x4_sweep_summary(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds per point differ from run to run and are told by ``timed`` only."""
    found = experiments.sweep_summary(experiments.segmentation_sweep(from_events(spark, d)))
    return _micros(found.withColumn("timed", F.col("step_ms_per_point") > 0).drop("step_ms_per_point"), "eps_m", "t_s")


@_query("x8_key_totals", f"SELECT {_mm('sum(value) / 1000')} AS value_sum, {_mm('avg(value)')} AS value_mean, {_mm('quantile_cont(value, 0.5)')} AS value_median FROM events")
def x8_key_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = experiments.key_totals(spark.read.parquet(f"{d}/events.parquet"), ["value"])
    return _millis(rows.withColumn("value_sum", F.col("value_sum") / 1000))


@_query("m7_min_samples", "SELECT DISTINCT user_id, greatest(5, round_even((user_id % 60) * 0.5, 0))::BIGINT AS min_samples FROM events")
def m7_min_samples(spark: SparkSession, d: str) -> DataFrame:
    u = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return u.select("user_id", segmentation.min_samples_for(F.col("user_id") % 60).cast("long").alias("min_samples"))


@_query("p11_side_by_side", f"""{_STAY}, {_offline_sql(EPS, SECONDS, SAMPLES)}, mp AS (SELECT * FROM sp WHERE kind = 'move'), {_squish_sql('mp', 'kb', str(CAPACITY), 'obj_id, seg_id')}
    SELECT 'offline' AS side, obj_id, seq, seg_id, kind FROM spd UNION ALL SELECT 'online', obj_id, seq, seg_id, kind FROM sp UNION ALL SELECT 'online_buffered', p.obj_id, p.seq, p.seg_id, p.kind FROM mp p JOIN kb USING (obj_id, seg_id, seq)""")  # fmt: skip
def p11_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    p = from_events(spark, d)
    online = segmentation.stay_points(p, EPS, SECONDS)
    offline = segmentation.density_segments(p, EPS, SECONDS, SAMPLES, "manual")
    kept = moves.buffer_simplify(segmentation.moves(online), moves.PER_SEGMENT, CAPACITY)
    parts = [x.select(F.lit(n).alias("side"), "obj_id", "seq", "seg_id", "kind") for n, x in (("offline", offline), ("online", online), ("online_buffered", kept))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
