"""Geographic functions, Column to Column. Three distance models live side by side; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.schema import EARTH_RADIUS_M, METERS_PER_DEGREE


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def equirectangular(lat1, lon1, lat2, lon2) -> Column:
    """Local metres, cosine at the mean latitude in degrees: the distance of stop detection."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_RADIUS_M * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2))


def speed_distance(lat1, lon1, lat2, lon2) -> Column:
    """Local metres, cosine at the mean latitude in radians: the distance of speeds."""
    x = F.radians(lon2 - lon1) * F.cos((F.radians(lat1) + F.radians(lat2)) / 2)
    return EARTH_RADIUS_M * F.sqrt(x * x + F.pow(F.radians(lat2) - F.radians(lat1), 2))


def planar(lat1, lon1, lat2, lon2) -> Column:
    """Metres by a fixed length of a degree."""
    x = (lon1 - lon2) * METERS_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(F.pow((lat1 - lat2) * METERS_PER_DEGREE, 2) + x * x)


def perpendicular(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Metres to the infinite line through two points; to the point if they coincide."""
    c = METERS_PER_DEGREE * F.cos(F.radians((lat1 + lat2 + lat) / 3))
    x0, y0, x2, y2 = (lon - lon1) * c, (lat - lat1) * METERS_PER_DEGREE, (lon2 - lon1) * c, (lat2 - lat1) * METERS_PER_DEGREE
    den = F.sqrt(x2 * x2 + y2 * y2)
    line = F.when(den == 0, F.lit(0.0)).otherwise(F.abs(y2 * x0 - x2 * y0) / F.when(den == 0, F.lit(1.0)).otherwise(den))
    return F.when((lat1 == lat2) & (lon1 == lon2), planar(lat, lon, lat1, lon1)).otherwise(line)


def synchronized(lat, lon, t, lat1, lon1, t1, lat2, lon2, t2) -> Column:
    """Metres to the place on a timed segment at the same time; extrapolates; equal times: to its start."""
    r = (t - t1) / F.nullif(t2 - t1, F.lit(0.0))
    dy = (lat - (lat1 + (lat2 - lat1) * r)) * METERS_PER_DEGREE
    dx = (lon - (lon1 + (lon2 - lon1) * r)) * METERS_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.when(t1 == t2, planar(lat, lon, lat1, lon1)).otherwise(F.sqrt(dy * dy + dx * dx))


def synchronized_degrees(lat1, lon1, t1, lat, lon, t, lat2, lon2, t2) -> Column:
    """Degrees to the place on a timed segment: the buffer priority. Equal times: 0."""
    r = (t - t1) / F.nullif(t2 - t1, F.lit(0.0))
    dy, dx = lat - (lat1 + (lat2 - lat1) * r), lon - (lon1 + (lon2 - lon1) * r)
    return F.when(t1 == t2, F.lit(0.0)).otherwise(F.sqrt(dy * dy + dx * dx))


def grid_cell(lat, lon, lat0, lon0, size_m) -> tuple[Column, Column]:
    """Cell of a point in a grid with its origin at (lat0, lon0): columns east and north."""
    x = F.radians(lon - lon0) * EARTH_RADIUS_M * F.cos(F.radians(lat0))
    return F.floor(x / size_m), F.floor(F.radians(lat - lat0) * EARTH_RADIUS_M / size_m)


def degree_distance(lat1, lon1, lat2, lon2, squared: bool = False) -> Column:
    """Distance in degree space, as stop medoids (root) and snapping (squared) use it."""
    d = F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2)
    return d if squared else F.sqrt(d)


def snap_to_polyline(lat, lon, line) -> Column:
    """struct(lat, lon) nearest to a point on a polyline array<struct<lat, lon>>, planar in degrees."""

    def on(a: Column, b: Column) -> Column:
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        n = dx * dx + dy * dy
        u = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / F.when(n == 0, 1.0).otherwise(n))))
        y, x = a["lat"] + u * dy, a["lon"] + u * dx
        return F.struct(degree_distance(lat, lon, y, x, True).alias("d"), y.alias("lat"), x.alias("lon"))

    pairs = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), on)
    best = F.array_min(pairs)
    return F.struct(best["lat"].alias("lat"), best["lon"].alias("lon"))


def speed(distance, seconds, stored) -> Column:
    """Speed between two fixes; without time between them, the last stored speed."""
    return F.when(seconds > 0, distance / F.when(seconds > 0, seconds)).otherwise(stored)


def quantised_speed(v, epsilon: float) -> Column:
    """Speed in half-epsilon steps, halves to even."""
    return (F.rint(v / (0.5 * epsilon)) if epsilon > 0 else v).cast("long")


def web_mercator(lat, lon) -> tuple[Column, Column]:
    """Metres east and north of the spherical web projection."""
    r = 6378137.0  # fixed value
    return F.radians(lon) * r, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * r


def bounding_box(lat, lon, pad: float = 0.01) -> list[Column]:
    """Aggregates south, north, west, east with a margin in degrees."""
    return [(F.min(lat) - pad).alias("south"), (F.max(lat) + pad).alias("north"), (F.min(lon) - pad).alias("west"), (F.max(lon) + pad).alias("east")]
