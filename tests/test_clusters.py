"""Cell indexes, grid pruning and the extraction of clusters from a reachability plot, against their definitions."""

import numpy as np
import pytest

from wayfold.operators import kernels, segmentation
from wayfold.operators.kernels import CellIndex, StayDetector, density_labels, haversine_from, optics_order, stay_segments, steep_areas, xi_labels
from wayfold.sources.points import from_events


def walk(rng, n, lat0=40.0, lon0=-74.0, step=3e-5):
    p = np.cumsum(rng.normal(size=(n, 2)) * step * rng.choice([0.1, 1, 5], size=(n, 1)), axis=0)
    return np.clip(lat0 + p[:, 0], -90, 90), (lon0 + p[:, 1] + 180) % 360 - 180


def areas_by_definition(plot, min_samples, xi):
    """Every interval that meets the definition, then those that no other contains."""
    n, found = len(plot) - 1, []
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = plot[:-1] / plot[1:]
    for down in (True, False):
        steep = ratio >= 1 / (1 - xi) if down else ratio <= 1 - xi
        against = ratio < 1 if down else ratio > 1
        whole = []
        for s in range(n):
            flat = 0
            for e in range(s, n):
                if against[e] or (e == s and not steep[s]):
                    break
                flat = 0 if steep[e] else flat + 1
                if flat > min_samples:
                    break
                if steep[e]:
                    whole.append((s, e))
        found += [(s, e, down) for s, e in whole if not any((a, b) != (s, e) and a <= s and e <= b for a, b in whole)]
    return sorted(found)


def labels_by_definition(order, reach, before, min_samples, xi):
    plot, pred = np.r_[reach[order], np.inf], before[order]
    areas, clusters = areas_by_definition(plot, min_samples, xi), []
    for rise, top, _ in (a for a in areas if not a[2]):
        for head, foot, _ in (a for a in areas[::-1] if a[2] and a[1] < rise):
            between = max(plot[foot + 1 : rise + 1])
            if not between <= min(plot[head], plot[top + 1]) * (1 - xi) or np.isinf(between):
                continue
            s, e = head, top
            if plot[head] * (1 - xi) >= plot[top + 1]:
                while s < foot and plot[s + 1] > plot[top + 1]:
                    s += 1
            elif plot[top + 1] * (1 - xi) >= plot[head]:
                while e > rise and plot[e - 1] > plot[head]:
                    e -= 1
            while s < e and plot[s] <= plot[e] and pred[e] not in list(order[s:e]):
                e -= 1
            if e - s + 1 >= min_samples and s <= foot and e >= rise:
                clusters.append((s, e))
    out, k = [-1] * len(order), 0
    for s, e in clusters:
        if all(x == -1 for x in out[s : e + 1]):
            out[s : e + 1] = [k] * (e - s + 1)
            k += 1
    labels = [0] * len(order)
    for place, fix in enumerate(order):
        labels[fix] = out[place]
    return labels


@pytest.mark.parametrize("xi", [0.02, 0.1, 0.4])
def test_extraction_equals_its_definition(xi):
    rng, clusters = np.random.default_rng(2), 0
    for _ in range(700):
        n, least = int(rng.integers(1, 30)), int(rng.integers(2, 6))
        reach = rng.choice([1.0, 1.01, 2.0, 2.02, 3.0, 5.0, 8.0, np.inf], size=n)
        order, before = rng.permutation(n), np.array([-1 if rng.random() < 0.2 else int(rng.integers(n)) for _ in range(n)])
        plot = np.r_[reach[order], np.inf]
        assert steep_areas(plot, least, xi) == areas_by_definition(plot, least, xi)
        got = xi_labels(order, reach, before, least, xi)
        assert got.tolist() == labels_by_definition(order, reach, before, least, xi)
        clusters += len(set(got.tolist()) - {-1})
    assert clusters > 100


def test_reachability_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(15):
        n, least, eps = int(rng.integers(2, 80)), int(rng.integers(2, 8)), float(rng.choice([10, 40]))
        lat, lon = walk(rng, n)
        d = np.array([haversine_from(lat, lon, k) for k in range(n)])
        core = [sorted(row)[least - 1] if least <= n and sorted(row)[least - 1] <= eps else np.inf for row in d]
        reach, before, left, order = [np.inf] * n, [-1] * n, set(range(n)), []
        while left:
            k = min(left, key=lambda j: (reach[j], j))
            left.remove(k)
            order.append(k)
            for j in left if np.isfinite(core[k]) else ():
                if d[k][j] <= eps and max(d[k][j], core[k]) < reach[j]:
                    reach[j], before[j] = max(d[k][j], core[k]), k
        got = optics_order(lat, lon, eps, least)
        assert got[0].tolist() == order and got[1].tolist() == reach and got[2].tolist() == before
        assert kernels.cluster_labels(lat, lon, eps, least, "optics", 0.02).tolist() == (labels_by_definition(*got, least, 0.02) if n >= least else [-1] * n)


@pytest.mark.parametrize("lat0,lon0", [(40, -74), (0, 179.9999), (89.9995, 0), (-60, -180), (-90, 10)])
def test_cells_find_all_neighbours(lat0, lon0, monkeypatch):
    rng = np.random.default_rng(4)
    lat, lon = walk(rng, 600, lat0, lon0)
    for eps in (5.0, 60.0, 2e7):
        index = CellIndex(lat, lon, eps)
        for k in range(0, 600, 7):
            found, d = index.near(k)
            assert np.allclose(d, haversine_from(lat, lon, k)[found]) and set(np.flatnonzero(haversine_from(lat, lon, k) <= eps - 1e-6)) <= set(found) <= set(np.flatnonzero(haversine_from(lat, lon, k) <= eps + 1e-6))
            assert (np.diff(found) > 0).all()
    plain = density_labels(lat, lon, 30.0, 5), optics_order(lat, lon, 30.0, 5)[0]
    monkeypatch.setattr(kernels, "MATRIX_FIXES", 10)
    assert (density_labels(lat, lon, 30.0, 5) == plain[0]).all() and (optics_order(lat, lon, 30.0, 5)[0] == plain[1]).all()


def test_work_grows_with_the_track(monkeypatch):
    """Distances computed on tracks of 5,000 and 20,000 fixes: in proportion, not with the square."""
    seen, plain = [], kernels.haversine_from
    monkeypatch.setattr(kernels, "haversine_from", lambda lat, lon, k: seen.append(len(lat)) or plain(lat, lon, k))
    sizes = []
    for n in (5000, 20000):
        rng = np.random.default_rng(5)
        p = np.cumsum(rng.normal(size=(n, 2)) * 5e-5 + [3e-5, 0], axis=0)
        seen.clear()
        density_labels(p[:, 0], p[:, 1], 15.0, 5)
        optics_order(p[:, 0], p[:, 1], 15.0, 5)
        sizes.append(sum(seen))
    assert sizes[1] < 6 * sizes[0] and sizes[1] < 20000**2 / 10


def test_grid_gives_the_same_segments_with_fewer_distances(spark):
    rng = np.random.default_rng(6)
    saved = exact = 0
    for eps, seconds in ((15.0, 30.0), (60.0, 120.0)):
        for _ in range(20):
            lat, lon = walk(rng, 400, step=4e-5)
            t = np.arange(400) * 5.0
            detector, out = StayDetector(eps, seconds, kernels.GRID_SHARE * eps), []
            for fix in zip(lat.tolist(), lon.tolist(), t.tolist()):
                out += detector.push(*fix)
            assert out + detector.flush() == stay_segments(lat, lon, t, eps, seconds)
            exact += detector.counts["exact"]
            saved += detector.counts["confirmed"] + detector.counts["pruned"]
    assert saved > exact / 2 > 0
    p = from_events(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, segmentation.stay_points(p, grid=5.0).collect())) == sorted(map(tuple, segmentation.stay_points(p).collect()))
