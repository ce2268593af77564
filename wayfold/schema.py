"""Constants, parameters and column conventions of trajectory operators.

A points table has obj_id string, seq bigint (arrival order, the only order key), lat double, lon double, t double (seconds)
and road_id string (nullable). A segmented table adds seg_id bigint and kind ('stop' or 'move').
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The results depend on them.
EARTH_RADIUS_M = 6371000.0
METERS_PER_DEGREE = 111320.0
BYTES_PER_POINT = 24
BYTES_PER_MATCH, BYTES_PER_LITERAL = 16, 4
STOP_DISTANCE_M, STOP_DURATION_S = 15.0, 30.0
MIN_SAMPLES, XI = 15, 0.02
DP_EPSILON_M = 15.0
BUFFER_CAPACITY, MIN_CAPACITY = 50, 3
ALIASES = {
    "lat": ("lat", "latitude", "y"),
    "lon": ("lon", "longitude", "x"),
    "ts": ("timestamp", "time", "datetime", "t", "date"),
    "obj_id": ("obj_id", "oid", "user_id", "trajectory_id"),
    "road_id": ("road_id", "osm_way_id", "edge_id"),
}

POINT_COLUMNS = ("obj_id", "seq", "lat", "lon", "t", "road_id")
POINTS = "obj_id string, seq long, lat double, lon double, t double, road_id string"
SEGMENTED = POINTS + ", seg_id long, kind string"


@dataclass(frozen=True)
class ReferenceCoding:
    """Parameters of speed representation and referential coding."""

    gamma: float = 50.0
    epsilon: float = 15.0
    k: int = 4
    decay: float = 0.9
    deletion_share: float = 0.5


@dataclass(frozen=True)
class Matching:
    window: int = 15
    max_dist: float = 50.0
    max_dist_init: float = 100.0
    min_prob_norm: float = 0.001


@dataclass(frozen=True)
class Compression:
    """Parameters of a whole pipeline; ``strategy``: geometric or network_semantic."""

    strategy: str = "geometric"
    stop_distance_m: float = STOP_DISTANCE_M
    stop_duration_s: float = STOP_DURATION_S
    compress_stops: bool = True
    stop_strategy: str = "centroid"
    capacity: int = BUFFER_CAPACITY
    dp_epsilon_m: float = DP_EPSILON_M
    coding: ReferenceCoding = field(default_factory=ReferenceCoding)
    map_matching: bool = False

    def __post_init__(self) -> None:
        if self.strategy not in ("geometric", "network_semantic"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.stop_strategy not in ("centroid", "medoid", "snap_to_nearest", "first_point"):
            raise ValueError(f"unknown stop strategy {self.stop_strategy!r}")

    def summary(self) -> str:
        return f"strategy={self.strategy} eps={self.stop_distance_m:g} T={self.stop_duration_s:g} stops={self.stop_strategy if self.compress_stops else 'kept'} capacity={self.capacity} dp={self.dp_epsilon_m:g}"
