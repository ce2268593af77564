"""The whole online pipeline as a stream: segmentation, stop and move compression in one stateful operator per object.

State of an object:

* ``waiting`` (list): fixes that the watermark has not passed yet; they go on in event-time order, so a stream may be out of order by as
  much as its watermark allows;
* ``fixes`` (map by block): fixes since the last closed segment, ``BLOCK`` arrival numbers to an entry; only the last entry is ever written again;
* ``head`` (value): place in the track, open stay, numbers of segments and references;
* ``refs`` and ``used`` (maps by reference): earlier moves that serve referential coding, and when each was used last.

A micro-batch so writes its new fixes, what it closes and one small value, whatever an open segment already holds. An object ends by event time: when
the watermark passes its last fix by ``idle_s``, its open segments leave and its state goes. Rows later than the watermark are dropped by
Spark, which counts them (numRowsDroppedByWatermark of the progress). An object that comes back begins anew, with segment 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfold.operators import kernels
from wayfold.schema import BYTES_PER_POINT, Compression

OUT = "obj_id string, seg_id long, kind string, start_t double, end_t double, n_points long, keypoints array<struct<t:double,lat:double,lon:double>>, encoded_bytes long"
#: Arrival numbers to an entry of the fixes' state: a call of the store for so many fixes.
BLOCK = 64
NONE = (0, 0, -1, -1, 0, 0, -1, -1)
FIX = "seq long, lat double, lon double, t double, road_id string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State by key and column family, which the operator needs, if the session has not named a store already."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, PROVIDER)


class _Fixes:
    """The detector's list of fixes over map state: places count from ``base``; reads are fetched when asked for and remembered for the batch."""

    def __init__(self, state, base: int, end: int):
        self.state, self.first, self.base, self.old, self.end, self.known = state, base, base, end, end, {}
        self.road = None  # of the fix that comes next: the detector itself knows places and times only

    def __len__(self) -> int:
        return self.end - self.base

    def at(self, place: int) -> tuple:
        if place not in self.known:
            start, *columns = self.state.getValue((place // BLOCK,))
            self.known |= {start + k: f for k, f in enumerate(zip(*columns))}
        return self.known[place]

    def __getitem__(self, k: int) -> tuple:
        return self.at(self.base + k)

    def append(self, fix: tuple) -> None:
        self.known[self.end] = (*fix, self.road)
        self.end += 1

    def __delitem__(self, part: slice) -> None:
        self.base += part.stop

    def commit(self) -> None:
        stored = range(self.first // BLOCK, (self.old - 1) // BLOCK + 1) if self.old > self.first else ()
        live = range(self.base // BLOCK, (self.end - 1) // BLOCK + 1) if self.end > self.base else ()
        for block in stored:
            if block not in live:
                self.state.removeKey((block,))
        for block in live:
            if (block + 1) * BLOCK > self.old and self.end > self.old:  # it has new fixes
                start = max(self.base, block * BLOCK)
                held = [self.at(place) for place in range(start, min(self.end, (block + 1) * BLOCK))]
                self.state.updateValue((block,), (start, *map(list, zip(*held))))


class OnlinePipeline(StatefulProcessor):
    """One object's detector, buffer and coder between micro-batches."""

    def __init__(self, config: Compression, idle_s: float):
        self.config, self.idle_ms = config, int(1000 * idle_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", FIX)
        self.fixes = handle.getMapState("fixes", "block long", "start long, lat array<double>, lon array<double>, t array<double>, road_id array<string>")
        self.head = handle.getValueState("head", "base long, end long, first long, last long, segments long, references long, latest long, timer long")
        self.refs = handle.getMapState("refs", "ref long", "e array<string>, v array<long>")
        self.used = handle.getMapState("used", "ref long", "t double")

    def close(self) -> None:
        pass

    def _coder(self, references: int) -> kernels.ReferenceCoder:
        """The coder with the references of earlier moves; its index follows from them, in the order in which they came."""
        coder = kernels.ReferenceCoder(self.config.coding)
        coder.count = references
        times = {r[0]: v[0] for r, v in self.used.iterator()}
        for (ref,), (e, v) in sorted(self.refs.iterator(), key=lambda x: x[0][0]):
            coder.restore(ref, {"E": list(e), "V": [int(x) for x in v]}, times[ref])
        return coder

    def _keep(self, coder: kernels.ReferenceCoder, before: dict[int, float]) -> None:
        for ref in [r for r in before if r not in coder.refs]:
            self.refs.removeKey((ref,))
            self.used.removeKey((ref,))
        for ref, held in coder.refs.items():
            if ref not in before:
                self.refs.updateValue((ref,), (held["E"], held["V"]))
            if before.get(ref) != held["used"]:
                self.used.updateValue((ref,), (float(held["used"]),))

    def _process(self, key: tuple, head: tuple, ready: list[tuple], ends: bool) -> tuple[tuple, list[tuple]]:
        base, end, first, last, segments, references, latest, timer = head
        fixes = _Fixes(self.fixes, base, end)
        detector = kernels.StayDetector(self.config.stop_distance_m, self.config.stop_duration_s)
        detector.base, detector.fixes, detector.stay = base, fixes, None if first < 0 else [first, last]
        coder, before, out = None, {}, []
        for fix in ready:
            fixes.road = fix[3]
            for seg in detector.push(*fix[:3]):
                coder, before, references, row = self._segment(key, fixes, seg, segments, coder, before, references)
                out.append(row)
                segments += 1
        if ends:
            for seg in detector.flush():
                coder, before, references, row = self._segment(key, fixes, seg, segments, coder, before, references)
                out.append(row)
                segments += 1
            # only what stands there: each call of the store is a message
            for state, stands in ((self.fixes, end > base), (self.head, head != NONE), (self.refs, head[5] > 0), (self.used, head[5] > 0)):
                if stands:
                    state.clear()
            return NONE, out
        fixes.commit()
        if coder is not None:
            self._keep(coder, before)
        first, last = detector.stay or (-1, -1)
        return (fixes.base, fixes.end, first, last, segments, references, latest, timer), out

    def _segment(self, key, fixes: _Fixes, seg: tuple, number: int, coder, before, references):
        a, b, stop = seg
        own = [fixes.at(k) for k in range(a, b + 1)]
        lat, lon, t = (np.array([f[k] for f in own], float) for k in range(3))
        c = self.config
        if stop:
            kept = [(float(t[0]), float(lat.mean()), float(lon.mean()))] if c.compress_stops else list(zip(t.tolist(), lat.tolist(), lon.tolist()))
            size = BYTES_PER_POINT * len(kept)
        elif c.strategy == "geometric":
            at = kernels.chained(lat, lon, t, c.capacity, c.dp_epsilon_m)
            kept = [(float(t[k]), float(lat[k]), float(lon[k])) for k in at]
            size = BYTES_PER_POINT * len(kept)
        else:
            if coder is None:
                coder = self._coder(references)
                before = {r: held["used"] for r, held in coder.refs.items()}
            entries = kernels.speed_entries(lat, lon, t, [f[3] for f in own], c.coding.gamma)
            size = kernels.encoded_bytes(coder.code(entries, float(t[-1])))
            references = coder.count
            at = [e[0] for e in entries]
            at += [len(t) - 1] if at and at[-1] != len(t) - 1 else []
            kept = [(float(t[k]), float(lat[k]), float(lon[k])) for k in at]
        return coder, before, references, (key[0], number, "stop" if stop else "move", float(t[0]), float(t[-1]), len(t), kept, size)

    def _advance(self, key: tuple, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Fixes that the watermark has passed go on in event-time order; then the object ends, if it has been silent for long enough."""
        held, head = list(self.waiting.get()), self.head.get() or NONE
        ready, rest = [], []
        for f in held + new:
            (ready if 1000 * f[3] <= watermark_ms else rest).append(f)
        if rest and (ready or not held):
            self.waiting.put(rest)
        elif held and not rest:
            self.waiting.clear()
        elif new and rest:
            self.waiting.appendList(new)
        ready.sort(key=lambda f: (f[3], f[0]))
        latest, timer = max([head[6], *(int(1000 * f[3]) for f in new)]), head[7]
        ends = not rest and latest >= 0 and latest + self.idle_ms <= watermark_ms
        head, out = self._process(key, head, [f[1:] for f in ready], ends) if ready or ends else (head, [])
        if timer >= 0 and (ends or timer != latest + self.idle_ms):
            self.handle.deleteTimer(timer)
        if not ends:
            due = min([latest + self.idle_ms, *(int(1000 * f[3]) for f in rest)]) if rest else latest + self.idle_ms
            self.handle.registerTimer(due)
            self.head.update((*head[:6], latest, due))
        if out:
            yield pd.DataFrame(out, columns=["obj_id", "seg_id", "kind", "start_t", "end_t", "n_points", "keypoints", "encoded_bytes"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            for seq, lat, lon, t, road in frame[["seq", "lat", "lon", "t", "road_id"]].itertuples(index=False):
                new.append((int(seq), float(lat), float(lon), float(t), None if pd.isna(road) else str(road)))
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())


def online_stream(points: DataFrame, config: Compression | None = None, delay_s: float = 60.0, idle_s: float = 600.0) -> DataFrame:
    """Segments with their compression (``OUT``) of a stream of points, as ``pipelines.online`` gives them for whole tracks.

    ``delay_s``: how late a row may be; ``idle_s``: silence in event time after which an object ends. Fixes of one object are taken by time, then
    seq; rows without obj_id, seq, lat, lon or t are left out.
    """
    config = config or Compression()
    if config.compress_stops and config.stop_strategy != "centroid":
        raise ValueError("the stream compresses stops to their centroid")
    if config.map_matching:
        raise ValueError("match the stream first (match_stream)")
    keyed_state(points.sparkSession)
    rows = points.select("obj_id", "seq", "lat", "lon", "t", "road_id", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")).alias("event_time"))
    rows = rows.dropna(subset=["obj_id", "seq", "lat", "lon", "t"]).withWatermark("event_time", f"{int(1000 * delay_s)} milliseconds")
    return rows.groupBy("obj_id").transformWithStateInPandas(OnlinePipeline(config, idle_s), OUT, "append", "EventTime")
