"""Distances, planar projections and point-segment geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.spatial import sphere_m

__all__ = ["along", "atan_m", "in_box", "offset_left", "planar", "segment", "speed", "splice", "sphere_m", "status"]


def atan_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Great-circle metres by the two-argument arc tangent."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar(lat: Column, lon: Column, lat0: Column, lon0: Column, north: float = 110_540.0, east: float = 111_320.0) -> tuple[Column, Column]:
    """(x, y) metres in the plane at (lat0, lon0)."""
    return (lon - lon0) * east * F.cos(F.radians(lat0)), (lat - lat0) * north


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Position 0 to 1 of a point's foot on a segment; 0 on a segment without length."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(n == 0, 1.0).otherwise(n))))


def segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    t = along(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def offset_left(lat: Column, lon: Column, east: Column, north: Column, metres: float) -> tuple[Column, Column]:
    """(lat, lon) moved to the left of a heading; unmoved without a heading."""
    n = F.hypot(east, north)
    ok = n > 0
    return F.when(ok, lat + metres * east / n / 110_540.0).otherwise(lat), F.when(ok, lon - metres * north / n / (111_320.0 * F.cos(F.radians(lat)))).otherwise(lon)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Whether a position is in a box, borders included."""
    return lat.between(south, north) & lon.between(west, east)


def speed(metres: Column, secs: Column) -> Column:
    """km/h; null where no time passes."""
    return F.when(secs > 0, metres / 1000 / (secs / 3600))


def status(lat: Column, lon: Column, country: tuple[float, float, float, float], box: tuple[float, float, float, float] | None = None) -> Column:
    """no_coord, bad_value, out_of_country, out_of_box or ok for coordinates given as text."""
    y, x = lat.try_cast("double"), lon.try_cast("double")
    out = F.when(F.coalesce(F.trim(lat), F.lit("")) == "", "no_coord").when(F.coalesce(F.trim(lon), F.lit("")) == "", "no_coord").when(y.isNull() | x.isNull(), "bad_value").when(~in_box(y, x, *country), "out_of_country")
    return (out.when(~in_box(y, x, *box), "out_of_box") if box else out).otherwise("ok")


def splice(points: Column, start: Column, end: Column) -> Column:
    """A piece of a line (array of structs lat, lon) in the direction that lays its ends nearest to ``start`` and ``end`` (squared degrees, summed); as it is if both fit alike."""
    d2 = lambda a, b: F.pow(a["lat"] - b["lat"], 2) + F.pow(a["lon"] - b["lon"], 2)
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    return F.when(d2(first, start) + d2(last, end) > d2(last, start) + d2(first, end), F.reverse(points)).otherwise(points)
