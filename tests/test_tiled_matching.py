"""Map matching in tiles against the matcher that holds the whole graph."""

import random

import pytest
from pyspark.sql import Observation

from wayfold.operators import matching, moves
from wayfold.operators.matching import match, match_tiled
from wayfold.plans import pipelines
from wayfold.schema import Compression, Matching

LINE = "array<struct<lat:double,lon:double>>"


def city(spark, n=9, step=0.001):
    name = lambda y, x: f"{y}_{x}"
    nodes = [(name(y, x), 48 + y * step, 2 + x * step) for y in range(n) for x in range(n)]
    edges = []
    for y in range(n):
        for x in range(n):
            for dy, dx in ((0, 1), (1, 0)):
                if y + dy < n and x + dx < n and (y * 7 + x * 3) % 11:  # some ways are missing
                    a, b = (48 + y * step, 2 + x * step), (48 + (y + dy) * step, 2 + (x + dx) * step)
                    bent = [a, ((a[0] + b[0]) / 2 + 1e-4 * dx, (a[1] + b[1]) / 2 + 1e-4 * dy), b] if (x + y) % 3 == 0 else None
                    edges += [(name(y, x), name(y + dy, x + dx), "0", [f"w{y}{x}{dy}", "other"], bent)]
                    edges += [(name(y + dy, x + dx), name(y, x), "0", [] if (x * y) % 5 == 0 else [f"w{y}{x}{dy}"], bent[::-1] if bent else None)] if (x + 2 * y) % 7 else []
    edges += [("0_0", f"{n - 1}_{n - 1}", "1", ["long"], None), ("nowhere", "0_0", "0", ["lost"], None)]  # an edge across all tiles, and one without a node
    return spark.createDataFrame(nodes, "node_id string, lat double, lon double"), spark.createDataFrame(edges, f"u string, v string, key string, osmid array<string>, geometry {LINE}")


def tracks(spark, extra=True):
    rng, rows = random.Random(4), []
    for obj in "abcd":
        y, x = rng.uniform(48, 48.008), rng.uniform(2, 2.008)
        for k in range(60):
            y, x = min(48.0085, max(47.9995, y + rng.gauss(0, 4e-4))), min(2.0085, max(1.9995, x + rng.gauss(0, 4e-4)))
            if rng.random() < 0.04:
                y, x = rng.uniform(48, 48.008), rng.uniform(2, 2.008)  # a jump
            rows.append((obj, 2 * k, y, x, 5.0 * k, rng.choice([None, "own"]), k // 20, "kept"))
    rows += [("far", k, 10.0, 10.0, float(k), "own", 0, "kept") for k in range(3)] + [("one", 0, 48.001, 2.001, 0.0, None, 0, "kept")]
    return spark.createDataFrame(rows, "obj_id string, seq long, lat double, lon double, t double, road_id string, seg_id long, tile string")


@pytest.mark.parametrize("window,tile", [(1, 0.003), (2, 0.0007), (5, 0.0015), (15, 0.05)])
def test_tiles_equal_the_whole_graph(spark, window, tile, monkeypatch):
    (nodes, edges), p, config = city(spark), tracks(spark), Matching(window=window)
    want = sorted(map(tuple, match(p, nodes, edges, config).collect()))
    assert len(want) == p.count() and sum(r[5] not in (None, "own") for r in want) > 100
    got = match_tiled(p, nodes, edges, config, tile=tile)
    assert got.schema == p.schema and sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(matching, "TILE_FIXES", 7)  # crowded tiles are dealt by salt
    assert sorted(map(tuple, match_tiled(p, nodes, edges, config, tile=tile).collect())) == want


def test_large_graphs_go_by_tiles(spark, monkeypatch):
    (nodes, edges), p, config = city(spark), tracks(spark), Matching(window=4)
    want = sorted(map(tuple, match(p, nodes, edges, config, moves.PER_SEGMENT).collect()))
    summary = pipelines.trajectory_results(p, pipelines.online(p.drop("seg_id", "tile"), Compression(strategy="network_semantic", map_matching=True), nodes, edges))
    whole = sorted(map(tuple, summary.collect()))
    monkeypatch.setattr(matching, "MAX_EDGES", 10)
    assert sorted(map(tuple, match(p, nodes, edges, config, moves.PER_SEGMENT).collect())) == want
    summary = pipelines.trajectory_results(p, pipelines.online(p.drop("seg_id", "tile"), Compression(strategy="network_semantic", map_matching=True), nodes, edges))
    assert sorted(map(tuple, summary.collect())) == whole
    with pytest.raises(ValueError):
        matching.shared_graph(nodes, edges)
    assert match_tiled(p.where("false"), nodes, edges).count() == 0
    assert sorted(map(tuple, match_tiled(p, nodes, edges.where("false")).collect())) == sorted(map(tuple, p.collect()))


@pytest.mark.parametrize("most", [10, 10**6])
def test_counters_equal_those_of_the_results(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "MAX_EDGES", most)  # in tiles, and with the whole graph
    (nodes, edges), p, config = city(spark), tracks(spark), Matching(window=4)
    seen = Observation("matching")
    found = match(p, nodes, edges, config, observation=seen)
    rows = {(r.obj_id, r.seq): r for r in found.collect()}
    assert found.schema == p.schema and sorted(map(tuple, rows.values())) == sorted(map(tuple, match(p, nodes, edges, config).collect()))
    before = {(r.obj_id, r.seq): r for r in p.collect()}
    hit = [k for k, r in rows.items() if r.road_id not in (None, "own")]
    assert (seen.get["points"], seen.get["matched"], seen.get["unmatched"]) == (len(before), len(hit), len(before) - len(hit))
    assert seen.get["snapped"] == sum((rows[k].lat, rows[k].lon) != (before[k].lat, before[k].lon) for k in rows) and seen.get["metres"] > 0


def test_coder_counters(spark):
    from wayfold.operators import segmentation
    from wayfold.schema import ReferenceCoding
    from wayfold.sources.points import from_events

    seen = Observation("coding")
    moving = segmentation.moves(segmentation.stay_points(from_events(spark, "/root/testdata/sf0.001")))
    rows = moves.referential_coding(moving, ReferenceCoding(gamma=3.8), seen).collect()
    tags = [f.tag for r in rows for f in [*r.e, *r.v]]
    want = {"moves": len(rows), "matches": tags.count("match"), "literals": tags.count("literal"), "bytes": sum(r.encoded_bytes for r in rows), "most_references": max(r.references for r in rows)}
    assert seen.get == want and want["matches"] > 0
