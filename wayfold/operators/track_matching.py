"""The matcher's work over whole tracks at once: the same states, ways and choices as ``RoadMatcher.push``, as arrays.

What is computed with ``math`` there is computed with ``math`` here, in the same order, so that ties fall the same way to the last digit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wayfold.schema import METERS_PER_DEGREE, Matching

#: Fixes whose states are held at once; cells of a chunk's transitions; sources of one table of ways; metres above which a pair's ways are
#: looked for one by one (a jump).
BLOCK, CELLS, SOURCES, LOCAL = 4096, 1_000_000, 64, 3000.0


def _ranges(first, count) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those from first[1], and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class RoadArrays:
    """Edges k with their ends, segments of their lines, the cells these touch, and ways out of each node, as arrays."""

    def __init__(self, u, v, size, first, y, x, cell: float):
        """``first``: each edge's first place in the points ``y``, ``x`` of all lines, and one number more."""
        self.cell, self.size, self.first, self.y, self.x = cell, size, first, y, x
        self.nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        self.u, self.v = at[: len(u)], at[len(u) :]
        points = np.diff(first)
        self.segs = np.maximum(points - 1, 0)
        self.seg0 = np.cumsum(self.segs) - self.segs
        p = _ranges(first[:-1], self.segs)
        self.y1, self.x1, self.y2, self.x2 = y[p], x[p], y[p + 1], x[p + 1]
        self.length = metres(self.y1, self.x1, self.y2, self.x2)
        self.along = np.zeros(len(p))
        for k in np.flatnonzero(self.segs > 1).tolist():
            for s in range(self.seg0[k] + 1, self.seg0[k] + self.segs[k]):
                self.along[s] = self.along[s - 1] + self.length[s - 1]
        some = np.flatnonzero(points)
        at = [np.floor(f.reduceat(c, first[:-1][some]) / cell).astype(np.int64) if len(some) else np.zeros(0, np.int64) for c in (y, x) for f in (np.minimum, np.maximum)]
        self.base = (int(at[0].min()), int(at[2].min())) if len(some) else (0, 0)
        self.top = (int(at[1].max()), int(at[3].max())) if len(some) else (-1, -1)
        self.wide = self.top[1] - self.base[1] + 1
        rows, cols = at[1] - at[0] + 1, at[3] - at[2] + 1
        row = np.repeat(np.arange(len(some)), rows)
        keys = (_ranges(at[0], rows) - self.base[0]) * self.wide + at[2][row] - self.base[1]
        keys = _ranges(keys, cols[row])
        order = np.argsort(keys, kind="stable")
        self.keys, self.entries = keys[order], np.repeat(some[row], cols[row])[order]
        out = np.argsort(self.u, kind="stable")
        self.to, self.cost = self.v[out], size[out]
        self.out = np.searchsorted(self.u[out], np.arange(len(self.nodes) + 1))
        self.place = np.zeros((len(self.nodes), 2))  # where a node is, about: only the order in which ways are looked for depends on it
        self.place[self.u[some]] = np.floor(np.c_[y[first[:-1][some]], x[first[:-1][some]]] / 0.004)
        self.place[self.v[some]] = np.floor(np.c_[y[first[1:][some] - 1], x[first[1:][some] - 1]] / 0.004)
        self._reached = np.full(len(self.nodes), np.inf)

    def near(self, lat, lon, most: float) -> tuple:
        """States (fix, edge, distance, y, x, metres along) within ``most`` metres of each fix, by fix and edge."""
        up = math.ceil(most / (METERS_PER_DEGREE * self.cell))  # beyond these rows of cells all is too far by latitude alone
        cos = np.cos(np.radians(lat))
        span = np.ceil(most / (METERS_PER_DEGREE * self.cell * np.maximum(0.1, cos))).astype(np.int64)
        y, x = np.floor(lat / self.cell).astype(np.int64), np.floor(lon / self.cell).astype(np.int64)
        row = (y[:, None] + np.arange(-up, up + 1)).ravel()
        fix = np.repeat(np.arange(len(lat)), 2 * up + 1)
        lo, hi = np.maximum((x - span)[fix], self.base[1]), np.minimum((x + span)[fix], self.top[1])
        good = (row >= self.base[0]) & (row <= self.top[0]) & (lo <= hi)
        row, fix, lo, hi = row[good], fix[good], lo[good], hi[good]
        key = (row - self.base[0]) * self.wide - self.base[1]
        a, b = np.searchsorted(self.keys, key + lo), np.searchsorted(self.keys, key + hi, side="right")
        fix = np.repeat(fix, b - a)
        pair = np.unique(fix * max(1, len(self.size)) + self.entries[_ranges(a, b - a)])
        fix, edge = np.divmod(pair, max(1, len(self.size)))
        segs = self.segs[edge]
        fix, edge, segs = fix[segs > 0], edge[segs > 0], segs[segs > 0]
        at, seg = np.repeat(np.arange(len(fix)), segs), _ranges(self.seg0[edge], segs)
        f = fix[at]
        dy, dx = self.y2[seg] - self.y1[seg], self.x2[seg] - self.x1[seg]
        n = dx * dx + dy * dy
        with np.errstate(invalid="ignore", divide="ignore"):
            u = np.where(n == 0, 0.0, np.maximum(0.0, np.minimum(1.0, ((lon[f] - self.x1[seg]) * dx + (lat[f] - self.y1[seg]) * dy) / n)))
        py, px = self.y1[seg] + u * dy, self.x1[seg] + u * dx
        rough = METERS_PER_DEGREE * np.hypot(lat[f] - py, (lon[f] - px) * np.cos(np.radians((lat[f] + py) / 2)))
        close = np.flatnonzero(rough <= most + 1e-3)  # the exact distance of a segment beyond decides nothing
        at, seg, f, u, py, px = at[close], seg[close], f[close], u[close], py[close], px[close]
        d = metres(lat[f], lon[f], py, px)
        order = np.lexsort((seg, d, at))  # the nearest segment of an edge, the first of equals
        first = order[np.r_[True, np.diff(at[order]) > 0]] if len(order) else order
        first = first[d[first] <= most]
        at, seg = at[first], seg[first]
        return fix[at], edge[at], d[first], py[first], px[first], self.along[seg] + u[first] * self.length[seg]

    def _within(self, sources, limit: float) -> np.ndarray:
        """Nodes within ``limit`` metres along the graph of any of the sources."""
        reached, seen, todo = self._reached, [sources], sources
        reached[sources] = 0.0
        while len(todo):
            count = self.out[todo + 1] - self.out[todo]
            e = _ranges(self.out[todo], count)
            d, to = np.repeat(reached[todo], count) + self.cost[e], self.to[e]
            better = (d <= limit) & (d < reached[to])
            d, to = d[better], to[better]
            np.minimum.at(reached, to, d)
            todo = np.unique(to)
            seen.append(todo)
        found = np.unique(np.concatenate(seen))
        reached[found] = np.inf
        return found

    def ways(self, sources, targets, limit: float) -> np.ndarray:
        """Metres along the graph from each source to each target; those within ``limit`` are the least, summed from the source on."""
        found = np.full((len(sources), len(targets)), np.inf)
        order = np.lexsort((self.place[sources, 1], self.place[sources, 0]))
        for a in range(0, len(sources), SOURCES):
            part = order[a : a + SOURCES]
            nodes = self._within(sources[part], limit)
            count = self.out[nodes + 1] - self.out[nodes]
            e = _ranges(self.out[nodes], count)
            head, tail = np.searchsorted(nodes, self.to[e]), np.repeat(np.arange(len(nodes)), count)
            inside = (head < len(nodes)) & (nodes[np.minimum(head, len(nodes) - 1)] == self.to[e])
            head, tail, cost = head[inside], tail[inside], self.cost[e][inside]
            by = np.argsort(head, kind="stable")
            head, tail, cost = head[by], tail[by], cost[by]
            nth = np.arange(len(head)) - np.searchsorted(head, head)
            d = np.full((len(nodes), len(part)), np.inf)
            d[np.searchsorted(nodes, sources[part]), np.arange(len(part))] = 0.0
            steps = [(head[nth == k], tail[nth == k], cost[nth == k][:, None]) for k in range(int(nth.max(initial=-1)) + 1)]
            while True:
                before = d.copy()
                for h, t, c in steps:
                    d[h] = np.minimum(d[h], d[t] + c)
                if np.array_equal(before, d):
                    break
            at = np.minimum(np.searchsorted(nodes, targets), len(nodes) - 1)
            found[part] = np.where((nodes[at] == targets)[:, None], d[at], np.inf).T
        return found


def edge_names(edges: pa.Table) -> pa.Array:
    """An edge's first id, or its ends."""
    osmid, u, v = (edges.column(c).combine_chunks() for c in ("osmid", "u", "v"))
    size = pc.fill_null(pc.list_value_length(osmid), 0)
    ids = pc.list_element(pc.if_else(pc.greater(size, 0), osmid, pa.scalar([""], osmid.type)), 0)
    return pc.if_else(pc.greater(size, 0), ids, pc.binary_join_element_wise(u.cast(pa.string()), v.cast(pa.string()), "-"))


def edge_arrays(edges: pa.Table, cell: float) -> RoadArrays:
    """The arrays of edges (u, v, line)."""
    u, v, line = (edges.column(c).combine_chunks() for c in ("u", "v", "line"))
    line = pa.concat_arrays(line.chunks) if isinstance(line, pa.ChunkedArray) else line
    ids = pa.concat_arrays([c for a in (u, v) for c in (a.chunks if isinstance(a, pa.ChunkedArray) else [a])]).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.r_[0, np.cumsum(pc.list_value_length(line).to_numpy(zero_copy_only=False).astype(np.int64))]
    y, x = (line.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
    segs = np.maximum(np.diff(first) - 1, 0)
    p = _ranges(first[:-1], segs)
    length = metres(y[p], x[p], y[p + 1], x[p + 1])
    at = np.r_[0, np.cumsum(segs)].tolist()
    parts = length.tolist()
    size = np.array([parts[a] if b - a == 1 else sum(parts[a:b]) for a, b in zip(at, at[1:])], float)
    return RoadArrays(ids[: len(u)], ids[len(u) :], size, first, y, x, cell)


def metres(y1, x1, y2, x2) -> np.ndarray:
    cos = np.array([math.cos(v) for v in np.radians((y1 + y2) / 2).tolist()])
    return METERS_PER_DEGREE * np.array(list(map(math.hypot, (y1 - y2).tolist(), ((x1 - x2) * cos).tolist())), float)


def match_tracks(matcher, lat, lon, last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge (-1: no match), lat and lon of each fix; ``last``: the place of the last fix of its track. Tracks lie one after the other."""
    n, ahead = len(lat), matcher.config.window - 1
    edge, y, x = np.full(n, -1), np.array(lat, float), np.array(lon, float)
    for a in range(0, n, BLOCK):
        b, c = min(n, a + BLOCK), min(n, a + BLOCK + ahead)
        k, found_y, found_x = _block(matcher, np.asarray(lat[a:c], float), np.asarray(lon[a:c], float), np.minimum(last[a:c], c - 1) - a, b - a)
        hit = k >= 0
        edge[a:b], y[a:b], x[a:b] = k, np.where(hit, found_y, lat[a:b]), np.where(hit, found_x, lon[a:b])
    matcher.counts["windows"] += n
    matcher.counts["unmatched"] += int((edge < 0).sum())
    return edge, y, x


def _padded(first, count) -> np.ndarray:
    """Places first[i] ... first[i] + count[i] - 1 in row i, then -1."""
    k = np.arange(max(1, int(count.max(initial=0))))
    return np.where(k < count[:, None], first[:, None] + k, -1)


def _block(matcher, lat, lon, last, n: int):
    """The matches of the windows that the first ``n`` fixes open."""
    config: Matching = matcher.config
    fix, *states = matcher.arrays.near(lat, lon, max(config.max_dist, config.max_dist_init))
    emit = np.array([-0.5 * (d / matcher.sigma) ** 2 for d in states[1].tolist()], float)
    first = np.searchsorted(fix, np.arange(len(lat)))
    count = np.diff(np.r_[first, len(fix)])
    straight = np.r_[metres(lat[:-1], lon[:-1], lat[1:], lon[1:]), 0.0] if len(lat) else np.zeros(0)
    later = states[1] <= config.max_dist
    fewer = np.bincount(fix[later], minlength=len(lat))
    edge, y, x = np.full(n, -1), np.zeros(n), np.zeros(n)
    a = 0
    while a < n:
        # as many windows as keep the padded transitions within CELLS
        size = np.maximum.accumulate(count[a : a + 1024]) * np.maximum.accumulate(np.maximum(fewer[a : a + 1024], 1))
        b = min(n, a + max(1, int(np.searchsorted(size * np.arange(1, len(size) + 1), CELLS, side="right"))))
        best = _windows(matcher, states, emit, later, first, count, straight, last, a, b)
        hit = best >= 0
        edge[a:b][hit], y[a:b][hit], x[a:b][hit] = states[0][best[hit]], states[2][best[hit]], states[3][best[hit]]
        a = b
    return edge, y, x


def _windows(matcher, states, emit, later, first, count, straight, last, a: int, b: int) -> np.ndarray:
    """For each window that opens at a, ..., b - 1 the state of its first fix on the likeliest path, or -1."""
    config, (edge, dist, _, _, along) = matcher.config, states
    c = min(len(first), b + config.window - 1)
    all_, windows = _padded(first[a:c], count[a:c]), np.arange(b - a)
    held = all_ >= 0
    start = held & (dist[all_] <= config.max_dist_init) if len(dist) else held
    score = np.where(start, emit[all_], -np.inf)[: b - a] if len(dist) else np.full((b - a, 1), -np.inf)
    chosen = np.where(start[: b - a].any(1), all_[windows, score.argmax(1)], -1)
    if c - a < 2 or config.window < 2 or not len(dist):
        return chosen
    then = held & later[all_]
    width = max(1, int(then.sum(1).max()))
    slot = np.argsort(~then, axis=1, kind="stable")[:, :width]  # where the states of a later fix of a window lie among all of a fix
    short = np.where(np.take_along_axis(then, slot, 1), np.take_along_axis(all_, slot, 1), -1)
    cost = _costs(matcher, edge, along, all_[:-1], short[1:], straight[a : c - 1], last[a : c - 1] > np.arange(a, c - 1))
    emits = np.where(short >= 0, emit[short], 0.0)
    between = np.take_along_axis(cost, slot[:-1, :, None], 1) if config.window > 2 else None
    origin, going, floor = all_[: b - a], chosen >= 0, math.log(config.min_prob_norm) * 4
    for j in range(1, config.window):
        w = np.flatnonzero(going & (windows + a + j <= last[a:b]))
        if not len(w):
            break
        got = score[w][:, :, None] + emits[w + j][:, None, :]
        got -= cost[w] if j == 1 else between[w + j - 1]
        k = got.argmax(1)
        top = np.take_along_axis(got, k[:, None], 1)[:, 0]
        top = np.where((top / (j + 1) >= floor) & (short[w + j] >= 0), top, -np.inf)
        from_ = np.take_along_axis(origin[w], k, 1)
        new_score, new_origin = np.full((b - a, width), -np.inf), np.full((b - a, width), -1)
        new_score[w], new_origin[w] = top, from_
        alive = (top > -np.inf).any(1)
        going = np.zeros(b - a, bool)
        going[w[alive]] = True
        chosen[w[alive]] = from_[alive, top[alive].argmax(1)]
        score, origin = new_score, new_origin
    return chosen


def _costs(matcher, edge, along, left, right, straight, joined) -> np.ndarray:
    """What the score loses from each state of a fix to each of the next; infinite without a way."""
    arrays, limit = matcher.arrays, 4 * straight + 500
    near = joined & (limit <= LOCAL)
    ends, starts = np.where(left >= 0, arrays.v[edge[left]], -1), np.where(right >= 0, arrays.u[edge[right]], -1)
    sources, targets = (np.unique(c[near]) for c in (ends, starts))
    sources, targets = sources[sources >= 0], targets[targets >= 0]
    way = np.full((*left.shape, right.shape[1]), np.inf)
    if len(sources) and len(targets):
        table = np.full((len(sources) + 1, len(targets) + 1), np.inf)
        table[:-1, :-1] = arrays.ways(sources, targets, float(limit[near].max()))
        at = lambda known, c: np.where(c >= 0, np.searchsorted(known, c), len(known))
        row, col = at(sources, ends[near]), at(targets, starts[near])
        l_, r_ = left[near], right[near]
        from_, to = np.where(l_ >= 0, along[l_], 0.0), np.where(r_ >= 0, along[r_], 0.0)
        own = table.ravel()[(row * table.shape[1])[:, :, None] + col[:, None, :]]
        own += (arrays.size[edge[l_]] - from_)[:, :, None]
        own[own > limit[near][:, None, None]] = np.inf
        own += to[:, None, :]
        same = (edge[l_][:, :, None] == edge[r_][:, None, :]) & (to[:, None, :] >= from_[:, :, None]) & (l_ >= 0)[:, :, None] & (r_ >= 0)[:, None, :]
        p, i, j = np.nonzero(same)
        own[p, i, j] = to[p, j] - from_[p, i]
        way[near] = own
    for p in np.flatnonzero(joined & ~near).tolist():
        state = lambda s: (int(edge[s]), 0.0, 0.0, 0.0, float(along[s]))
        for i in np.flatnonzero(left[p] >= 0).tolist():
            for j in np.flatnonzero(right[p] >= 0).tolist():
                way[p, i, j] = matcher._way(state(left[p, i]), state(right[p, j]), float(limit[p]))
    way -= straight[:, None, None]
    np.abs(way, out=way)
    way /= matcher.beta
    return way
