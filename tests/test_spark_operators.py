"""Operators on small frames: sources, matching, streaming, metrics at their edges, and all SQL equivalents."""

import json
import math

import pytest
from compare import main as compare
from pyspark.sql import functions as F

from wayfold.operators import metrics, moves, segmentation, stops
from wayfold.operators.matching import RoadMatcher, diagnostics, match
from wayfold.plans import pipelines, records, registry  # noqa: F401
from wayfold.schema import Compression, Matching
from wayfold.sources import graph, sinks
from wayfold.sources import points as sources
from wayfold.streaming.match_stream import match_stream
from wayfold.streaming.stay_stream import stay_stream

D = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "obj_id string, seq long, lat double, lon double, t double, road_id string")


def roads(spark, names):
    return frame(spark, [("a", i, 0.001 * i, 0.0, float(i), r) for i, r in enumerate(names)])


@pytest.mark.parametrize(("names", "kept"), [("AABBC", [0, 2, 4]), ("AABB", [0, 2, 3]), ("A", [0])])
def test_road_changes(spark, names, kept):
    assert sorted(r.seq for r in moves.road_changes(roads(spark, names)).collect()) == kept


def test_stop_triple(spark):
    rows = [("a", i, *p, 10.0 * i, "x", 0, "stop") for i, p in enumerate([(10.0, 20.0), (12.0, 22.0), (11.0, 21.0)])]
    df = spark.createDataFrame(rows, "obj_id string, seq long, lat double, lon double, t double, road_id string, seg_id long, kind string")
    got = stops.compress(df).first()
    assert (got.lat, got.lon, got.start_t, got.end_t) == (11.0, 21.0, 0.0, 20.0)
    assert stops.compress(df, "medoid").first().lat == 11.0
    with pytest.raises(ValueError):
        stops.compress(df, "nothing")


def test_configuration_errors(spark):
    with pytest.raises(ValueError):
        pipelines.online(roads(spark, "AB"), Compression(strategy="network_semantic", map_matching=True))
    with pytest.raises(ValueError):
        segmentation.density_clusters(roads(spark, "AB"), backend="other")
    assert "eps=15" in Compression().summary()


def test_error_of_the_trajectory_itself_is_zero(spark):
    p = roads(spark, "ABCDE")
    assert all(r.sed == 0 for r in metrics.synchronized_errors(p, p).collect())
    ends = p.where("seq IN (0, 4)")
    assert max(r.sed for r in metrics.synchronized_errors(p, ends).collect()) < 1e-6


def test_f1_and_jaccard_edges(spark):
    seg = lambda rows: spark.createDataFrame(rows, "obj_id string, seg_id long, kind string, start_t double, end_t double")
    p, g = seg([("a", 0, "stop", 0.0, 10.0), ("a", 1, "stop", 10.0, 20.0)]), seg([("a", 0, "stop", 0.0, 20.0), ("b", 0, "stop", 0.0, 5.0)])
    got = {r.obj_id: r for r in metrics.stop_f1(p, g).collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].fn) == (1, 1, 0)  # a tie at exactly a half: the earlier takes it
    assert (got["b"].tp, got["b"].fn, got["b"].f1) == (0, 1, 0.0)
    j = {r.obj_id: r.jaccard for r in metrics.road_jaccard(frame(spark, [("a", 0, 0.0, 0.0, 0.0, None), ("b", 0, 0.0, 0.0, 0.0, "r")]), frame(spark, [("a", 0, 0.0, 0.0, 0.0, None)])).collect()}
    assert math.isnan(j["a"]) and j["b"] == 0.0


def test_sources(spark, tmp_path):
    (tmp_path / "7.csv").write_text("time,latitude,longitude,osm_way_id\n2024-01-01 00:00:00,1,2,9\nbad,3,4,9\n2024-01-01 00:00:02,x,4,9\n2024-01-01 00:00:03,5,6,8\n")
    raw = spark.read.option("header", True).csv(str(tmp_path / "7.csv"))
    good = sources.from_frame(sources.strict(raw), default_obj_id="o").orderBy("seq").collect()
    assert [(r.lat, r.lon, r.road_id, r.seq) for r in good] == [(1.0, 2.0, "9", 0), (5.0, 6.0, "8", 1)]
    r = sources.read_replay(spark, str(tmp_path / "7.csv"), "2024-01-01 00:00:00", 0.5).orderBy("seq").collect()
    assert [x.t - r[0].t for x in r] == [0.0, 0.5, 1.5] and r[0].obj_id == "7"
    with pytest.raises(ValueError):
        sources.replay(raw.withColumnRenamed("latitude", "lat"), "2024-01-01 00:00:00")
    with pytest.raises(FileNotFoundError):
        sources.read_replay(spark, str(tmp_path / "none.csv"), "2024-01-01 00:00:00")
    with pytest.raises(KeyError):
        sources.from_frame(raw.drop("latitude"))
    fleet = spark.createDataFrame([("id\th",), ("1\tv1\t1/2/2024\t3:04:05\tx\ty\t10.5\t20.5\t3",)], "value string")
    assert [(x.obj_id, x.lat, x.lon) for x in sources.fleet_log(fleet).collect()] == [("v1", 20.5, 10.5)]
    assert sources.check_file_id("12") == "12"
    with pytest.raises(ValueError):
        sources.check_file_id("1/2")
    (tmp_path / "10.csv").write_text("time,latitude,longitude\n2024-01-01 00:00:00,1,2\n2024-01-01 00:00:01,1,2\n")
    (tmp_path / "8.csv").write_text("time,latitude,longitude\n2024-01-01 00:00:00,1,2\n")
    folder = tmp_path / "all"
    folder.mkdir()
    for name in ("8.csv", "10.csv"):
        (folder / name).write_text((tmp_path / name).read_text())
    assert [(r.obj_id, r.seq) for r in sources.read_directory(spark, str(folder)).orderBy("seq").collect()] == [("10", 0), ("10", 1)]
    assert sources.read_directory(spark, str(folder), max_files=1, least_points=1).select("obj_id").distinct().first().obj_id == "8"
    assert sources.read_csv(spark, str(tmp_path / "10.csv"), default_obj_id="x").count() == 2
    assert [(r.obj_id, r.lat) for r in sources.lenient(raw).orderBy("seq").collect()] == [("7", 1.0), ("7", 5.0)]
    clocked = sources.lenient(raw.drop("time")).orderBy("seq").collect()
    assert [r.t for r in clocked] == [1577836800.0, 1577836801.0, 1577836802.0]


def test_matching_on_a_toy_graph(spark):
    nodes = [("1", 0.0, 0.0), ("2", 0.0, 0.001), ("3", 0.0, 0.002), ("4", 0.0, 0.003)]
    edges = [("1", "2", ["road_A"], None), ("2", "3", ["road_B"], None), ("3", "4", [], None)]
    m = RoadMatcher(nodes, edges, Matching(window=3))
    fixes = [(1e-5, 0.0002), (1e-5, 0.0008), (1e-5, 0.0015), (1e-5, 0.0026)]
    got = [x for f in fixes for x in m.push(*f)]
    assert len(got) == 2 and got[0][0] == "road_A" and abs(got[0][1]) < 1e-9
    assert [x[0] for x in m.flush()] == ["road_B", "3-4"]
    n = spark.createDataFrame(nodes, "node_id string, lat double, lon double")
    e = spark.createDataFrame([(u, v, "0", o, g) for u, v, o, g in edges], "u string, v string, key string, osmid array<string>, geometry array<struct<lat:double,lon:double>>")
    p = frame(spark, [("a", i, *f, float(i), None) for i, f in enumerate(fixes)])
    assert [r.road_id for r in match(p, n, e, Matching(window=3)).orderBy("seq").collect()] == ["road_A", "road_A", "road_B", "3-4"]


def test_stream_equals_batch(spark, tmp_path):
    p = sources.from_events(spark, D)
    want = sorted((r.obj_id, r.a, r.b, r.kind) for r in segmentation.stay_points(p).groupBy("obj_id", "seg_id", "kind").agg({"seq": "min"}).withColumnRenamed("min(seq)", "a").join(segmentation.stay_points(p).groupBy("obj_id", "seg_id").agg({"seq": "max"}).withColumnRenamed("max(seq)", "b"), ["obj_id", "seg_id"]).collect())
    for k, cond in enumerate(["seq < 20", "seq >= 20 AND seq < 55", "seq >= 55"]):
        p.where(cond).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    end = p.select("obj_id").distinct().selectExpr("obj_id", "cast(null as long) seq", "cast(null as double) lat", "cast(null as double) lon", "cast(null as double) t", "cast(null as string) road_id")
    end.coalesce(1).write.parquet(str(tmp_path / "in/9"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stay_stream(stream).writeStream.format("memory").queryName("stays").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT obj_id, first, last, kind FROM stays").collect())
    finally:
        q.stop()
    assert got == want


def test_bundle_turns_nan_to_null(spark):
    rows = spark.createDataFrame([("o", 3, "p", "cr", 2.0), ("o", 3, "p", "avg_sed_m", float("nan"))], "obj_id string, n_raw_points long, pipeline string, metric string, value double")
    parts = {r.part: r.value for r in sinks.evaluation_bundle(rows, metrics.contract_aggregate(rows), {"eps": 15}).collect()}
    assert json.loads(parts["header"]) == {"schema": sinks.BUNDLE_SCHEMA, "run_config": {"eps": "15"}}
    assert json.loads(parts["per_file"]) == {"obj_id": "o", "n_raw_points": 3, "pipelines": {"p": {"cr": 2.0, "avg_sed_m": None}}}
    assert "NaN" not in "".join(parts.values())


def test_sinks_read_back(spark, tmp_path):
    p = roads(spark, "AAB").withColumn("t", F.col("t") + 1_700_000_000)
    seg = p.withColumns({"seg_id": F.lit(0).cast("long"), "kind": F.lit("stop")})
    read = lambda name: sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / name)).collect()))
    sinks.write_points(p, str(tmp_path / "points"), roads=True)
    assert read("points")[2] == ("0.002", "0.0", "2023-11-14 22:13:22", "B") and len(read("points")) == 3
    sinks.write_compressed(stops.compress(seg), p.where("seq = 2"), str(tmp_path / "compressed"))
    assert [r[:3] for r in read("compressed")] == [("a", "MOVE", "0.002"), ("a", "STOP", "0.001")]
    sinks.write_road_changes(moves.road_changes(p), str(tmp_path / "roads"))
    assert [(r[3], r[4]) for r in read("roads")] == [("A", "CHUNK_START"), ("B", "CHUNK_START")]
    sinks.write_keypoints(p.select("obj_id", "t", "lat"), str(tmp_path / "keys"), "line")
    assert (tmp_path / "keys/strategy=line/obj_id=a").is_dir()
    records = spark.createDataFrame([("a", 1.5, float("inf"))], "obj_id string, cr double, bad double")
    sinks.write_metrics_json(records, str(tmp_path / "json"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()] == [{"obj_id": "a", "cr": 1.5}]
    sinks.write_metrics_csv(records, str(tmp_path / "csv"))
    assert read("csv") == [("a", "1.5", "Infinity")]


GRAPHML = """<?xml version="1.0"?><graphml><key id="d1" for="node" attr.name="y"/><key id="d2" for="node" attr.name="x"/><key id="d3" for="edge" attr.name="osmid"/><key id="d4" for="edge" attr.name="geometry"/>
<graph edgedefault="directed"><node id="1"><data key="d1">0.0</data><data key="d2">0.0</data></node><node id="2"><data key="d1">0.0</data><data key="d2">0.002</data></node>
<edge source="1" target="2" id="0"><data key="d3">[7, 8]</data><data key="d4">LINESTRING (0 0, 0.001 0.001, 0.002 0)</data></edge><edge source="2" target="1" id="0"><data key="d3">9</data></edge></graph></graphml>"""


def test_graphml_geometry_is_snapped_to(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges = graph.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(map(tuple, nodes.collect())) == [("1", 0.0, 0.0), ("2", 0.0, 0.002)]
    got = {r.u: r for r in edges.collect()}
    assert got["1"].osmid == ["7", "8"] and [(p.lat, p.lon) for p in got["1"].geometry] == [(0.0, 0.0), (0.001, 0.001), (0.0, 0.002)] and got["2"].geometry is None
    p = frame(spark, [("a", 0, 0.00052, 0.0005, 0.0, None), ("a", 1, 0.00098, 0.001, 1.0, None)])
    m = match(p, nodes, edges, Matching(window=2)).orderBy("seq").collect()
    assert [r.road_id for r in m] == ["7", "7"] and abs(m[0].lat - 0.00051) < 1e-6 and abs(m[0].lon - 0.00051) < 1e-6
    found = sinks.write_graph(nodes, edges, str(tmp_path / "graph"))
    assert (found["nodes"], found["edges"]) == (2, 2) and found["bytes"] > 0
    again = sinks.read_graph(spark, str(tmp_path / "graph"))
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, nodes.collect())) and again[1].count() == 2
    inside = graph.clip(nodes, edges, p, pad=0.0007)
    assert inside[0].count() == 1 and inside[1].count() == 0
    far = frame(spark, [("a", 0, 1.0, 1.0, 0.0, "old")])
    kept = match(far, nodes, edges)
    assert kept.first().road_id == "old" and diagnostics(far, kept).first().unmatched == 1


def test_matching_per_move_and_pipeline(spark):
    nodes = spark.createDataFrame([(str(i), 0.0, 0.001 * i) for i in range(4)], "node_id string, lat double, lon double")
    edges = spark.createDataFrame([(str(i), str(i + 1), "0", [f"r{i}"], None) for i in range(3)], "u string, v string, key string, osmid array<string>, geometry array<struct<lat:double,lon:double>>")
    p = frame(spark, [("a", i, 1e-5, 0.0002 + 0.0004 * i, 10.0 * i, None) for i in range(7)])
    rows = pipelines.online(p, Compression(strategy="network_semantic", map_matching=True), nodes, edges).collect()
    assert [r.kind for r in rows] == ["move"] and rows[0].encoded_bytes > 0
    reps, kept = pipelines.offline_network(p, min_samples=5, backend="manual", nodes=nodes, edges=edges)
    assert reps.count() == 0 and [r.road_id for r in kept.orderBy("seq").collect()] == ["r0", "r1", "r2", "r2"]


def run_stream(spark, frames, tmp_path, schema, build, name):
    for k, f in enumerate(frames):
        f.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_matched_stream_equals_batch(spark, tmp_path):
    nodes = spark.createDataFrame([(str(i), 0.0, 0.001 * i) for i in range(4)], "node_id string, lat double, lon double")
    edges = spark.createDataFrame([(str(i), str(i + 1), "0", [f"r{i}"], None) for i in range(3)], "u string, v string, key string, osmid array<string>, geometry array<struct<lat:double,lon:double>>")
    p = frame(spark, [(o, i, 1e-5, 0.0002 + 0.0003 * i, float(i), None) for o in "ab" for i in range(9)])
    end = frame(spark, [(o, None, None, None, None, None) for o in "ab"])
    got = run_stream(spark, [p.where("seq < 2"), p.where("seq BETWEEN 2 AND 6"), p.where("seq > 6"), end], tmp_path, p.schema, lambda s: match_stream(s, nodes, edges, Matching(window=3)), "matched")
    assert sorted(map(tuple, got)) == sorted(map(tuple, match(p, nodes, edges, Matching(window=3)).collect())) and len(got) == 18


def test_entry_and_sql(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert compare("sf0.001", sorted(registry.ORACLES)) == 0
