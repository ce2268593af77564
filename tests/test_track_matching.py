"""The matcher over whole tracks against the same fixes one by one."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from wayfold.operators import matching, track_matching
from wayfold.operators.matching import RoadMatcher
from wayfold.schema import Matching


def streets(south, n=10, step=0.001):
    """A grid with bent, missing and one-way streets."""
    rng, edges = random.Random(3), []
    for y in range(n):
        for x in range(n):
            for dy, dx in ((0, 1), (1, 0)):
                if y + dy < n and x + dx < n and rng.random() < 0.9:
                    a, b = (south + y * step, 2 + x * step), (south + (y + dy) * step, 2 + (x + dx) * step)
                    line = [a, ((a[0] + b[0]) / 2 + rng.gauss(0, 1e-4), (a[1] + b[1]) / 2), b] if rng.random() < 0.3 else [a, b]
                    edges.append((f"{y}_{x}", f"{y + dy}_{x + dx}", [f"w{y}{x}{dy}"] if rng.random() < 0.8 else [], line))
                    if rng.random() < 0.8:
                        edges.append((f"{y + dy}_{x + dx}", f"{y}_{x}", [f"w{y}{x}{dy}"], line[::-1]))
    return edges


def drives(south, jumps=0.05):
    rng, out = random.Random(5), []
    for length in (70, 1, 2, 40):
        y, x, track = rng.uniform(south, south + 0.01), rng.uniform(2, 2.01), []
        for _ in range(length):
            y, x = min(south + 0.012, max(south - 0.002, y + rng.gauss(0, 3e-4))), min(2.012, max(1.998, x + rng.gauss(0, 3e-4)))
            if rng.random() < jumps:
                y, x = rng.uniform(south, south + 0.01), rng.uniform(2, 2.01)
            track.append((y, x))
        out.append(track)
    return out


def one_by_one(matcher, tracks):
    found = []
    for track in tracks:
        matcher.window = []
        found += [m for fix in track for m in matcher.push(*fix)] + matcher.flush()
    return found


def at_once(matcher, tracks):
    sizes = [len(t) for t in tracks]
    lat, lon = (np.array([f[c] for t in tracks for f in t]) for c in (0, 1))
    edge, y, x = matcher.tracks(lat, lon, np.repeat(np.cumsum(sizes) - 1, sizes))
    assert (y[edge < 0] == lat[edge < 0]).all() and (x[edge < 0] == lon[edge < 0]).all()
    return [(matcher.names[k], b, c) if k >= 0 else None for k, b, c in zip(edge.tolist(), y.tolist(), x.tolist())]


@pytest.mark.parametrize("south", [48.0, 88.0])  # near a pole every street of a row is within reach
@pytest.mark.parametrize("config", [Matching(window=1), Matching(window=4), Matching(window=6, max_dist=90, max_dist_init=40)])
def test_tracks_equal_single_fixes(south, config, monkeypatch):
    edges, tracks = streets(south), drives(south)
    own = RoadMatcher([], edges, config)
    want = one_by_one(own, tracks)
    assert 10 < sum(w is not None for w in want) < len(want) or south > 80
    for small in (False, True):  # small: many blocks, chunks and tables, and most steps taken for jumps
        if small:
            for name, value in (("BLOCK", 13), ("CELLS", 2000), ("SOURCES", 5), ("LOCAL", 600.0)):
                monkeypatch.setattr(track_matching, name, value)
        matcher = RoadMatcher([], edges, config)
        assert at_once(matcher, tracks) == want and matcher.counts == own.counts


def test_edges_of_a_table_equal_those_of_a_list():
    edges, tracks, config = streets(48.0), drives(48.0), Matching(window=3)
    rows = [{"u": u, "v": v, "key": "0", "osmid": ids or None, "line": [{"lat": a, "lon": b} for a, b in line]} for u, v, ids, line in edges]
    random.Random(1).shuffle(rows)
    table = matching._distinct(pa.Table.from_pylist(rows + rows[:50]))  # some come twice
    matcher = RoadMatcher.of_table(table, config)
    assert len(matcher.ends) == len(edges) and at_once(matcher, tracks) == one_by_one(RoadMatcher([], sorted(edges, key=lambda e: e[:2]), config), tracks)
    assert one_by_one(matcher, tracks) == at_once(matcher, tracks)  # the lists for single fixes are made from the table
    none = RoadMatcher.of_table(table.slice(0, 0), config)
    assert at_once(none, tracks) == [None] * sum(map(len, tracks)) and len(none.tracks(np.zeros(0), np.zeros(0))[0]) == 0


def test_a_way_leads_through_nodes_away_from_all_fixes():
    """Two dead-end streets meet 300 metres off: the way is found as far as its limit, and not beyond."""
    far = 300 / 111320
    line = lambda *p: list(p)
    edges = [("a", "b", ["1"], line((0, 0), (far, 0))), ("b", "c", ["2"], line((far, 0), (far, 3e-4))), ("c", "d", ["3"], line((far, 3e-4), (0, 3e-4)))]
    matcher = RoadMatcher([], edges, Matching(window=2))
    arrays = matcher.arrays
    found = arrays.ways(np.array([0, 1]), np.arange(4), 5000.0)
    assert math.isclose(found[0, 3], 600 + 3e-4 * 111320, rel_tol=1e-6) and found[0, 0] == 0 and np.isinf(found[1, 0])
    assert found[0, 3] == matcher._from("a", 5000)["d"]
    assert np.isinf(arrays.ways(np.array([0]), np.array([3]), 400.0)).all()
