"""Map matching as a stateful stream: the look-ahead window of each object is kept between micro-batches.

A fix leaves when its window is full, so the first ones are delayed; the rest leave when the object ends (a row with a null seq) or falls
silent. State is the window's fixes only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators.matching import _matcher, shared_graph
from wayfold.schema import POINT_COLUMNS, POINTS, Matching

STATE = "seq array<long>, lat array<double>, lon array<double>, t array<double>, road_id array<string>"


def match_stream(points: DataFrame, nodes: DataFrame, edges: DataFrame, config: Matching | None = None, idle: str | None = None) -> DataFrame:
    """A stream of points with matched lat, lon and road_id; rows of a micro-batch are taken in seq order. ``nodes`` and ``edges``: static."""
    config, held, graph = config or Matching(), shared_graph(nodes, edges), uuid.uuid4().hex

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(zip(*state.get)) if state.exists else []
        ended, new = state.hasTimedOut, []
        if not ended:
            rows = pd.concat(list(frames))
            ended = bool(rows["seq"].isna().any())
            rows = rows.dropna(subset=["seq"]).sort_values("seq", kind="stable")
            new = [(int(s), a, b, t, None if pd.isna(r) else r) for s, a, b, t, r in rows[["seq", "lat", "lon", "t", "road_id"]].itertuples(index=False)]
        matcher = _matcher(graph, held, config)
        matcher.window = [(f[1], f[2]) for f in waiting]
        waiting += new
        found = [m for f in new for m in matcher.push(f[1], f[2])] + (matcher.flush() if ended else [])
        out = [(key[0], f[0], m[1] if m else f[1], m[2] if m else f[2], f[3], m[0] if m else f[4]) for f, m in zip(waiting, found)]
        waiting = waiting[len(found) :]
        if ended:
            state.remove()
        else:
            state.update(tuple(list(c) for c in zip(*waiting)) if waiting else ([],) * 5)
            if idle:
                state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=list(POINT_COLUMNS))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return points.groupBy("obj_id").applyInPandasWithState(run, POINTS, STATE, "append", timeout)
