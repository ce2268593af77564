"""Online segmentation as a stateful stream: one stay detector per object, kept between micro-batches.

Segments leave when they close: a stop when it is left or separated, a move when the next stop forms or the object falls silent. State is the
detector's: fixes since the last closed segment and the open stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators.kernels import StayDetector
from wayfold.schema import STOP_DISTANCE_M, STOP_DURATION_S

OUT = "obj_id string, first long, last long, kind string"
STATE = "base long, lat array<double>, lon array<double>, t array<double>, first long, last long"


def _load(state: GroupState, eps: float, min_s: float) -> StayDetector:
    d = StayDetector(eps, min_s)
    if state.exists:
        base, lat, lon, t, first, last = state.get
        d.base, d.fixes = base, list(zip(lat, lon, t))
        d.stay = None if first is None or first < 0 else [first, last]
    return d


def stay_stream(points: DataFrame, eps: float = STOP_DISTANCE_M, min_s: float = STOP_DURATION_S, idle: str | None = None) -> DataFrame:
    """Closed segments (obj_id, first, last, kind) of a stream of points; rows of a micro-batch are taken in seq order.

    A row with a null seq ends its object (flush). ``idle``: milliseconds of processing time without rows after which an object ends.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = _load(state, eps, min_s)
        out = []
        ended = state.hasTimedOut
        if not ended:
            rows = pd.concat(list(frames))
            ended = bool(rows["seq"].isna().any())
            rows = rows.dropna(subset=["seq"]).sort_values("seq", kind="stable")
            for fix in zip(rows["lat"].tolist(), rows["lon"].tolist(), rows["t"].tolist()):
                out += d.push(*fix)
        if ended:
            out += d.flush()
            state.remove()
        else:
            lat, lon, t = ([f[k] for f in d.fixes] for k in range(3))
            first, last = d.stay or (-1, -1)
            state.update((d.base, lat, lon, t, first, last))
            if idle:
                state.setTimeoutDuration(int(idle))
        yield pd.DataFrame([(key[0], a, b, "stop" if s else "move") for a, b, s in out], columns=["obj_id", "first", "last", "kind"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return points.groupBy("obj_id").applyInPandasWithState(run, OUT, STATE, "append", timeout)
