"""Sequential kernels over one trajectory in seq order: plain numpy and Python, without Spark."""

from __future__ import annotations

import heapq
import math

import numpy as np

from wayfold.schema import EARTH_RADIUS_M, METERS_PER_DEGREE, MIN_CAPACITY, ReferenceCoding


def runs(labels) -> list[tuple[int, int]]:
    """First and last index of each run of equal labels."""
    labels = np.asarray(labels)
    if not len(labels):
        return []
    cut = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    return list(zip(cut.tolist(), [*(cut[1:] - 1).tolist(), len(labels) - 1]))


class StayDetector:
    """Online stay points, one fix at a time: a stay is ``min_s`` seconds within ``eps`` metres of the newest fix.

    ``push`` and ``flush`` return closed segments (first, last, is_stop) by arrival number. Overlapping stays merge;
    a stay ends when a fix lies beyond ``eps`` of its last fix. A walk back from a fix stops as soon as its outcome is known, so
    its length is bounded by the fixes of ``min_s`` seconds.

    With ``grid`` (metres of a cell's side; ``GRID_SHARE`` of eps by custom) most distances are not computed: two fixes whose cells can't be
    more than ``eps`` apart are near, those whose cells can't be within it are far. ``counts`` tells how many were settled which way.
    """

    def __init__(self, eps: float, min_s: float, grid: float | None = None):
        self.eps, self.min_s, self.grid = eps, min_s, grid
        self.base, self.fixes, self.stay = 0, [], None
        self.origin, self.cells = None, {}
        self.counts = {"exact": 0, "confirmed": 0, "pruned": 0}
        if grid:
            self._far = self._far_by_cells

    def _cell(self, fix: tuple) -> tuple[int, int]:
        """Cell relative to the first fix of the track; remembered while the fix is held."""
        if fix not in self.cells:
            y, x = math.radians(fix[0] - self.origin[0]), math.radians(fix[1] - self.origin[1]) * math.cos(math.radians(self.origin[0]))
            self.cells[fix] = math.floor(EARTH_RADIUS_M * y / self.grid), math.floor(EARTH_RADIUS_M * x / self.grid)
        return self.cells[fix]

    def _far(self, a: tuple, b: tuple) -> bool:
        x = math.radians(b[1] - a[1]) * math.cos(math.radians((a[0] + b[0]) / 2))
        return EARTH_RADIUS_M * math.sqrt(x * x + math.radians(b[0] - a[0]) ** 2) > self.eps

    def _far_by_cells(self, a: tuple, b: tuple) -> bool:
        (y1, x1), (y2, x2), reach = self._cell(a), self._cell(b), (self.eps / self.grid) ** 2
        dy, dx = abs(y1 - y2), abs(x1 - x2)
        if (dy + 1) ** 2 + (dx + 1) ** 2 <= reach:
            self.counts["confirmed"] += 1
            return False
        if max(0, dy - 1) ** 2 + max(0, dx - 1) ** 2 > reach:
            self.counts["pruned"] += 1
            return True
        self.counts["exact"] += 1
        return StayDetector._far(self, a, b)

    def _drop(self, base: int) -> None:
        if self.grid:
            for fix in self.fixes[: base - self.base]:
                self.cells.pop(fix, None)
        del self.fixes[: base - self.base]
        self.base = base

    def push(self, lat: float, lon: float, t: float) -> list[tuple[int, int, bool]]:
        fix, fixes = (lat, lon, t), self.fixes
        if self.grid and self.origin is None:
            self.origin = fix
        fixes.append(fix)
        c = first = self.base + len(fixes) - 1
        end = self.stay[1] if self.stay else -1
        while first > self.base and not self._far(fix, fixes[first - 1 - self.base]):
            first -= 1
            if first <= end and t - fixes[first - self.base][2] >= self.min_s:
                break
        out = []
        if t - fixes[first - self.base][2] >= self.min_s:
            if self.stay and first <= end:
                self.stay[1] = c
                return out
            if self.stay:
                out.append((*self.stay, True))
                moving = end + 1
            else:
                moving = self.base
            if moving < first:
                out.append((moving, first - 1, False))
            self.stay = [first, c]
            self._drop(first)
        elif self.stay and self._far(fix, fixes[end - self.base]):
            out.append((*self.stay, True))
            self._drop(end + 1)
            self.stay = None
        return out

    def flush(self) -> list[tuple[int, int, bool]]:
        last = self.base + len(self.fixes) - 1
        out = [(*self.stay, True)] if self.stay else []
        moving = self.stay[1] + 1 if self.stay else self.base
        if moving <= last:
            out.append((moving, last, False))
        self.base, self.fixes, self.stay = last + 1, [], None
        return out


#: Side of a grid cell as a share of the stop distance.
GRID_SHARE = math.sqrt(2) / 4


def stay_segments(lat, lon, t, eps: float, min_s: float, grid: float | None = None) -> list[tuple[int, int, bool]]:
    detector = StayDetector(eps, min_s, grid)
    out = []
    for fix in zip(lat.tolist(), lon.tolist(), t.tolist()):
        out += detector.push(*fix)
    return out + detector.flush()


def haversine_from(lat, lon, k: int) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lat[k])
    a = np.sin((p - q) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon - lon[k]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


#: Fixes up to which an object's distances are held as a matrix (8 MB).
MATRIX_FIXES = 1024


def distances(lat, lon):
    """Function k -> metres of all fixes from fix k; short objects keep them all."""
    if len(lat) > MATRIX_FIXES:
        return lambda k: haversine_from(lat, lon, k)
    p, q = np.radians(lat), np.radians(lon)
    c = np.cos(p)
    a = np.sin((p[:, None] - p) / 2) ** 2 + c[:, None] * c * np.sin((q[:, None] - q) / 2) ** 2
    held = 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))
    return held.__getitem__


class CellIndex:
    """Fixes by cell, so that those within ``eps`` metres of one are looked for in three by three cells; the ends of the world meet."""

    def __init__(self, lat, lon, eps: float):
        self.lat, self.lon, self.eps = np.asarray(lat, float), np.asarray(lon, float), eps
        side = np.degrees(eps / EARTH_RADIUS_M) * 1.001 + 1e-12
        top = min(90.0, float(np.abs(self.lat).max(initial=0.0)) + side)
        # half the chord's angle bounds the longitudes that a circle around the least favourable fix spans
        narrow = max(math.cos(math.radians(top)), 1e-9)
        wide = 2 * math.degrees(math.asin(min(1.0, math.sin(min(math.pi / 2, eps / 2 / EARTH_RADIUS_M)) / narrow))) * 1.001 + 1e-12
        self.width = max(1, min(1 << 30, int(360 // wide)))
        self.y = np.floor((self.lat + 90) / side).astype(np.int64)
        self.x = (np.floor(((self.lon + 180) % 360) * self.width / 360).astype(np.int64)) % self.width
        key = self.y * self.width + self.x
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def near(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Fixes within ``eps`` of fix ``k``, itself included, by index, and their distances."""
        y, x, w = int(self.y[k]), int(self.x[k]), self.width
        spans = [(x - 1, x + 1)] if 0 < x < w - 1 else [(0, w - 1)] if w <= 3 else [(w - 1, w - 1), (0, 1)] if x == 0 else [(w - 2, w - 1), (0, 0)]
        ends = [(a * w + lo, a * w + hi) for a in (y - 1, y, y + 1) for lo, hi in spans]
        parts = [self.order[np.searchsorted(self.keys, lo) : np.searchsorted(self.keys, hi, side="right")] for lo, hi in ends]
        found = np.sort(np.concatenate(parts))
        d = haversine_from(self.lat[found], self.lon[found], int(np.searchsorted(found, k)))
        keep = d <= self.eps
        return found[keep], d[keep]


def neighbourhoods(lat, lon, eps: float, apart=None):
    """Function k -> fixes within ``eps`` of fix k and their distances: from a matrix for short objects, else from cells."""
    if len(lat) > MATRIX_FIXES:
        return CellIndex(lat, lon, eps).near
    apart = apart or distances(lat, lon)

    def near(k: int) -> tuple[np.ndarray, np.ndarray]:
        d = apart(k)
        found = np.flatnonzero(d <= eps)
        return found, d[found]

    return near


def density_labels(lat, lon, eps: float, min_samples: int, apart=None) -> np.ndarray:
    """Density clusters with neighbourhoods that include the fix itself; scans by index; -1 is noise. ``apart``: as ``distances`` gives."""
    near = neighbourhoods(lat, lon, eps, apart)
    labels = np.full(len(lat), -2)
    found = -1
    for k in range(len(lat)):
        if labels[k] != -2:
            continue
        around = near(k)[0]
        if len(around) < min_samples:
            labels[k] = -1
            continue
        found += 1
        labels[k] = found
        todo = around.tolist()
        while todo:
            j = todo.pop()
            if labels[j] == -1:
                labels[j] = found
            if labels[j] != -2:
                continue
            labels[j] = found
            around = near(j)[0]
            if len(around) >= min_samples:
                todo += around[labels[around] < 0].tolist()
    return labels


def label_segments(labels, t, min_s: float) -> list[tuple[int, int, bool]]:
    """Runs of equal labels as segments: clusters of ``min_s`` seconds are stops, all else moves; adjacent moves are one."""
    out: list[tuple[int, int, bool]] = []
    for a, b in runs(labels):
        stop = bool(labels[a] != -1 and t[b] - t[a] >= min_s)
        if out and not stop and not out[-1][2]:
            out[-1] = (out[-1][0], b, False)
        else:
            out.append((a, b, stop))
    return out


def density_segments(lat, lon, t, eps: float, min_s: float, min_samples: int, backend: str, xi: float) -> list[tuple[int, int, bool]]:
    return label_segments(cluster_labels(lat, lon, eps, min_samples, backend, xi), t, min_s)


def cluster_labels(lat, lon, eps: float, min_samples: int, backend: str, xi: float, apart=None) -> np.ndarray:
    """Labels by density ('manual') or by the reachability plot ('optics')."""
    if backend == "manual":
        return density_labels(lat, lon, eps, min_samples, apart)
    if len(lat) < min_samples:
        return np.full(len(lat), -1)
    return xi_labels(*optics_order(lat, lon, eps, min_samples), min_samples, xi)


def optics_order(lat, lon, max_eps: float, min_samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Visit order, reachability and predecessor of each fix (metres). The next fix is the one of least reachability, then of least index."""
    n = len(lat)
    near = neighbourhoods(lat, lon, max_eps, lambda k: haversine_from(lat, lon, k))
    core = np.full(n, np.inf)
    for k in range(n):
        d = near(k)[1]
        if len(d) >= min_samples:
            core[k] = np.partition(d, min_samples - 1)[min_samples - 1]
    reach, before, done, order = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool), []
    waiting, unreached = [], 0  # a heap of (reachability, fix), old entries among them; and the first fix that nothing may have reached
    for _ in range(n):
        while waiting and (done[waiting[0][1]] or reach[waiting[0][1]] != waiting[0][0]):
            heapq.heappop(waiting)
        while unreached < n and done[unreached]:
            unreached += 1
        k = heapq.heappop(waiting)[1] if waiting else unreached
        done[k] = True
        order.append(k)
        if np.isfinite(core[k]):
            around, d = near(k)
            new = np.maximum(d, core[k])
            better = ~done[around] & (new < reach[around])
            reach[around[better]], before[around[better]] = new[better], k
            for r, j in zip(new[better].tolist(), around[better].tolist()):
                heapq.heappush(waiting, (r, j))
    return np.array(order, int), reach, before


def steep_areas(plot, min_samples: int, xi: float) -> list[tuple[int, int, bool]]:
    """(first, last, down) of the maximal steep areas of a reachability plot, by place.

    Place p is a steep descent if plot[p + 1] is lower than plot[p] by the share ``xi`` at least, and a steep ascent if it is higher so. An area
    begins and ends at steep places of one direction; between them no step goes the other way, and at most ``min_samples`` places in a row are not steep.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = plot[:-1] / plot[1:]
    areas = []
    for down, steep, against in ((True, ratio >= 1 / (1 - xi), ratio < 1), (False, ratio <= 1 - xi, ratio > 1)):
        places = np.flatnonzero(steep)
        if not len(places):
            continue
        turns = np.r_[0, np.cumsum(against)]  # steps the other way before a place
        apart = (turns[places[1:]] != turns[places[:-1]]) | (np.diff(places) - 1 > min_samples)
        firsts, lasts = places[np.r_[True, apart]], places[np.r_[apart, True]]
        areas += [(int(a), int(b), down) for a, b in zip(firsts, lasts)]
    return sorted(areas)


def _trimmed(plot, pred, order, down: tuple[int, int], up: tuple[int, int], min_samples: int, xi: float) -> tuple[int, int] | None:
    """The cluster between a descent and an ascent: its higher end is cut to the height of the lower one, and its last member must have
    been reached from inside. None if that leaves too little."""
    (first, foot), (rise, last) = down, up
    left, right = plot[first], plot[last + 1]
    if left * (1 - xi) >= right:
        over = np.flatnonzero(~(plot[first + 1 : foot + 1] > right))
        first = first + int(over[0]) if len(over) else foot
    elif right * (1 - xi) >= left:
        over = np.flatnonzero(~(plot[rise:last] > left)[::-1])
        last = last - int(over[0]) if len(over) else rise
    while first < last and plot[first] <= plot[last] and pred[last] not in order[first:last]:
        last -= 1
    return (first, last) if last - first + 1 >= min_samples and first <= foot and last >= rise else None


def xi_labels(order, reach, before, min_samples: int, xi: float) -> np.ndarray:
    """Clusters of a reachability plot: intervals from a steep descent to a steep ascent; -1 is noise.

    A descent and a later ascent enclose a cluster if everything between them (after the descent, up to where the ascent starts) is finite and
    lower by the share ``xi`` than where the descent starts and than where the ascent ends. Ascents are taken from left to right
    and for each the nearest descent first, so that inner clusters come before those around them; the first that covers a place keeps it.
    """
    n = len(order)
    labels = np.full(n, -1)
    if not n:
        return labels
    plot, pred = np.r_[reach[order], np.inf], before[order]
    open_, found, out, seen = [], 0, np.full(n, -1), 0  # open descents as [first, foot, highest place since]
    for a, b, down in steep_areas(plot, min_samples, xi):
        high = float(plot[seen : a + 1].max())
        open_ = [] if np.isinf(high) else [[f, g, max(h, high)] for f, g, h in open_ if max(h, high) <= plot[f] * (1 - xi)]
        seen = b + 1
        if down:
            open_.append([a, b, 0.0])
            continue
        for f, g, h in reversed(open_):
            if h <= plot[b + 1] * (1 - xi):
                cut = _trimmed(plot, pred, order, (f, g), (a, b), min_samples, xi)
                if cut and (out[cut[0] : cut[1] + 1] == -1).all():
                    out[cut[0] : cut[1] + 1] = found
                    found += 1
    labels[order] = out
    return labels


def douglas_peucker(lat, lon, eps: float) -> np.ndarray:
    """Kept indices: farthest point from the chord's line splits, first of equals, while beyond ``eps`` metres."""
    n = len(lat)
    keep = np.zeros(n, bool)
    if n:
        keep[[0, n - 1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        y, x = lat[a + 1 : b], lon[a + 1 : b]
        if lat[a] == lat[b] and lon[a] == lon[b]:
            c = METERS_PER_DEGREE * np.cos(np.radians((y + lat[a]) / 2))
            d = np.sqrt(((y - lat[a]) * METERS_PER_DEGREE) ** 2 + ((x - lon[a]) * c) ** 2)
        else:
            c = METERS_PER_DEGREE * np.cos(np.radians((lat[a] + lat[b] + y) / 3))
            x2, y2 = (lon[b] - lon[a]) * c, (lat[b] - lat[a]) * METERS_PER_DEGREE
            d = np.abs(y2 * ((x - lon[a]) * c) - x2 * ((y - lat[a]) * METERS_PER_DEGREE)) / np.sqrt(y2 * y2 + x2 * x2)
        k = int(np.argmax(d))
        if d[k] > eps:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def synchronized_errors(lat, lon, t, kept) -> np.ndarray:
    """Metres from each fix to the place at its time between the last kept fix before it and the first at or after it; past either end, to the
    only one there is."""
    kept = kept[np.argsort(t[kept], kind="stable")]
    after = np.searchsorted(t[kept], t, side="left")
    a, b = kept[np.maximum(after - 1, 0)], kept[np.minimum(after, len(kept) - 1)]
    one = (after == 0) | (after == len(kept))
    a, b = np.where(after == 0, b, a), np.where(after == len(kept), a, b)
    r = np.where(one, 0.0, (t - t[a]) / np.where(one, 1.0, t[b] - t[a]))
    dy = (lat - (lat[a] + (lat[b] - lat[a]) * r)) * METERS_PER_DEGREE
    middle = np.where(one, lat + lat[a], lat[a] + lat[b]) / 2
    dx = (lon - (lon[a] + (lon[b] - lon[a]) * r)) * METERS_PER_DEGREE * np.cos(np.radians(middle))
    return np.sqrt(dy * dy + dx * dx)


def squish(lat, lon, t, capacity: int) -> np.ndarray:
    """Kept indices of a bounded buffer: when full, the fix of least synchronized error (degrees) goes, the first of equals."""
    n = len(lat)
    if n <= capacity:
        return np.arange(n)
    lat, lon, t = lat.tolist(), lon.tolist(), t.tolist()
    left, right = list(range(-1, n - 1)), [-1] * n
    cost: list[float | None] = [None] * n
    heap: list[tuple[float, int]] = []

    def price(k: int) -> None:
        a, b = left[k], right[k]
        if a < 0 or b < 0:
            return
        if t[a] == t[b]:
            cost[k] = 0.0
        else:
            r = (t[k] - t[a]) / (t[b] - t[a])
            dy, dx = lat[k] - (lat[a] + (lat[b] - lat[a]) * r), lon[k] - (lon[a] + (lon[b] - lon[a]) * r)
            cost[k] = math.sqrt(dy * dy + dx * dx)
        heapq.heappush(heap, (cost[k], k))

    last = -1
    for k in range(n):
        left[k] = last
        if last >= 0:
            right[last] = k
            price(last)
        last = k
        if k < capacity:
            continue
        while True:
            least, out = heapq.heappop(heap)
            if cost[out] == least:
                break
        cost[out] = None
        a, b = left[out], right[out]
        right[a], left[b] = b, a
        price(a)
        price(b)
    kept, k = [], 0
    while k >= 0:
        kept.append(k)
        k = right[k]
    return np.array(kept)


def hybrid(lat, lon, t, capacity: int, eps: float, refine: bool = False) -> np.ndarray:
    """Line simplification if it fits the buffer, else the buffer (then refined, if asked)."""
    if capacity < MIN_CAPACITY:
        raise ValueError(f"capacity must be at least {MIN_CAPACITY}")
    if len(lat) <= capacity:
        return douglas_peucker(lat, lon, eps)
    kept = squish(lat, lon, t, capacity)
    return kept[douglas_peucker(lat[kept], lon[kept], eps)] if refine else kept


def chained(lat, lon, t, capacity: int, eps: float) -> np.ndarray:
    """The buffer, then line simplification of what it kept."""
    kept = squish(lat, lon, t, capacity)
    return kept[douglas_peucker(lat[kept], lon[kept], eps)]


def road_change_places(road: list) -> np.ndarray:
    """First point, first point on each new road, last point."""
    keep = [k for k in range(len(road)) if k == 0 or road[k] != road[k - 1]]
    return np.array(keep if not road or keep[-1] == len(road) - 1 else [*keep, len(road) - 1], int)


def speed_entries(lat, lon, t, road, gamma: float) -> list[tuple[int, object, float, float]]:
    """(index, road, offset, speed) where the road changes or the speed leaves the stored one by more than ``gamma``."""
    y, out, offset, stored = np.radians(lat), [], 0.0, -1.0
    if len(y) > 1:
        x = np.radians(np.diff(lon)) * np.cos((y[:-1] + y[1:]) / 2)
        step = EARTH_RADIUS_M * np.sqrt(x * x + np.diff(y) ** 2)
    for k in range(len(y)):
        if k == 0 or road[k] != road[k - 1]:
            offset = stored = 0.0
            out.append((k, road[k], 0.0, 0.0))
            continue
        offset += float(step[k - 1])
        dt = t[k] - t[k - 1]
        v = float(step[k - 1]) / dt if dt > 0 else stored
        if abs(v - stored) > gamma:
            out.append((k, road[k], offset, v))
            stored = v
    return out


class ReferenceCoder:
    """Referential coding of the moves of one trajectory: earlier moves serve as references.

    A sequence is cut into literals and matches (ref, start, length, mismatch) found by k-mers; a missing mismatch consumes
    nothing. References fade by ``decay`` per second since last use and go below a share of the mean.
    """

    def __init__(self, config: ReferenceCoding):
        self.config, self.refs, self.index, self.count = config, {}, {}, 0

    def _factors(self, kind: str, items: list) -> list:
        k, n, at, out = self.config.k, len(items), 0, []
        while at < n:
            best = None
            if at + k <= n:
                for ref, start in self.index.get((kind, tuple(items[at : at + k])), ()):
                    other = self.refs[ref][kind]
                    length = k
                    while at + length < n and start + length < len(other) and items[at + length] == other[start + length]:
                        length += 1
                    if best is None or length > best[2]:
                        ended = at + length >= n or start + length >= len(other)
                        best = (ref, start, length, None if ended else items[at + length])
            if best is None:
                out.append(items[at])
                at += 1
            else:
                out.append(best)
                at += best[2] + (best[3] is not None)
        return out

    def restore(self, ref: int, seqs: dict[str, list], used: float) -> None:
        """Hold a move as reference ``ref``; references are added in the order of their moves."""
        k, keys = self.config.k, []
        for kind, items in seqs.items():
            for a in range(len(items) - k + 1):
                key = (kind, tuple(items[a : a + k]))
                self.index.setdefault(key, []).append((ref, a))
                keys.append(key)
        self.refs[ref] = seqs | {"used": used, "keys": keys}

    def code(self, entries: list, now: float) -> dict[str, list]:
        half = 0.5 * self.config.epsilon
        seqs = {"E": [e[1] for e in entries], "V": [round(e[3] / half) if half > 0 else int(e[3]) for e in entries]}
        factors = {kind: self._factors(kind, items) for kind, items in seqs.items()}
        for f in factors["E"] + factors["V"]:
            if isinstance(f, tuple):
                self.refs[f[0]]["used"] = now
        self.count += 1
        self.restore(self.count, seqs, now)
        score = {r: self.config.decay ** max(0.0, now - ref["used"]) for r, ref in self.refs.items()}
        least = self.config.deletion_share * sum(score.values()) / len(score)
        for r in [r for r, s in score.items() if s < least]:
            for key in set(self.refs.pop(r)["keys"]):
                rest = [e for e in self.index[key] if e[0] != r]
                if rest:
                    self.index[key] = rest
                else:
                    del self.index[key]
        return factors


def decode(factors: list, refs: dict[int, list]) -> list:
    """The sequence that was coded, given the references it names."""
    out: list = []
    for f in factors:
        if isinstance(f, tuple):
            ref, start, length, mismatch = f
            out += refs[ref][start : start + length]
            out += [] if mismatch is None else [mismatch]
        else:
            out.append(f)
    return out


def encoded_bytes(factors: dict[str, list] | None) -> int:
    return sum(16 if isinstance(f, tuple) else 4 for items in (factors or {}).values() for f in items)
