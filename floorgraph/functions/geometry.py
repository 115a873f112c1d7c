"""Plane geometry as column expressions; points are pairs of double columns, rings arrays of (x, y) structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

XY = tuple[Column, Column]


def distance(a: XY, b: XY) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def rounded(x: Column, places: int) -> Column:
    """``F.round`` of a double, which goes by way of its text: only near halves, below zero and above a million this does, too."""
    scaled = x * 10.0**places
    whole = F.floor(scaled)
    over = scaled - whole
    plain = (x >= 0) & (x < 1e6) & (F.abs(over - 0.5) > 1e-4)
    return F.when(plain, (whole + F.when(over > 0.5, 1).otherwise(0)) / 10.0**places).otherwise(F.round(x, places))


def segment_parameter(p: XY, a: XY, b: XY) -> Column:
    """Place of p's projection along ab, clamped to 0..1; 0 on a segment without length."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    squared = dx * dx + dy * dy
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / squared
    return F.when(squared <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def point_segment_distance(p: XY, a: XY, b: XY) -> Column:
    t = segment_parameter(p, a, b)
    return distance(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def _turns(a: XY, b: XY, c: XY) -> Column:
    return (c[1] - a[1]) * (b[0] - a[0]) > (b[1] - a[1]) * (c[0] - a[0])


def segments_cross(a: XY, b: XY, c: XY, d: XY) -> Column:
    return (_turns(a, c, d) != _turns(b, c, d)) & (_turns(a, b, c) != _turns(a, b, d))


def segment_distance(a: XY, b: XY, c: XY, d: XY) -> Column:
    """Zero where the segments cross, else the least endpoint distance."""
    ends = F.least(point_segment_distance(a, c, d), point_segment_distance(b, c, d), point_segment_distance(c, a, b), point_segment_distance(d, a, b))
    return F.when(segments_cross(a, b, c, d), F.lit(0.0)).otherwise(ends)


def bbox_gap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of boxes (x0, y0, x1, y1); zero where they meet."""
    dx = F.greatest(F.lit(0.0), a[0] - b[2], b[0] - a[2])
    dy = F.greatest(F.lit(0.0), a[1] - b[3], b[1] - a[3])
    return F.sqrt(dx * dx + dy * dy)


def point_bbox_distance(p: XY, box: tuple[Column, ...]) -> Column:
    return bbox_gap((p[0], p[1], p[0], p[1]), box)


def crosses_upward_ray(p: XY, a: XY, b: XY) -> Column:
    """Whether the edge ab is crossed by the ray from p to the right; parity over a ring's edges tells inside."""
    dy = F.when(F.abs(b[1] - a[1]) < 1e-9, F.lit(1e-9)).otherwise(b[1] - a[1])
    return ((a[1] > p[1]) != (b[1] > p[1])) & (p[0] < (b[0] - a[0]) * (p[1] - a[1]) / dy + a[0])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rotated(ring: Column) -> Column:
    """The ring from its second point on, the first at the end."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    """Shoelace area; positive where the ring runs counter-clockwise."""
    cross = lambda r: F.zip_with(r, rotated(r), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(bound(ring, cross), F.lit(0.0), lambda s, c: s + c) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def wound(ring: Column, clockwise: bool = False) -> Column:
    def turned(r: Column) -> Column:
        area = signed_area(r)
        return F.when((area > 0) if clockwise else (area < 0), F.reverse(r)).otherwise(r)

    return bound(ring, turned)


def ring_centroid(ring: Column) -> Column:
    """Area centroid as a struct; the mean point where the area is zero."""
    cross = lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).alias("c")
    sums = lambda a, b: F.struct(cross(a, b), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))
    total = lambda values, of: F.aggregate(values, F.lit(0.0), lambda s, p: s + of(p))

    def centre(r: Column, pairs: Column, area: Column) -> Column:
        weighted = lambda k: total(pairs, lambda p: p["c"] * p[k]) / (6 * area)
        mean = lambda k: total(r, lambda p: p[k]) / F.size(r)
        return F.struct(*[F.when(F.abs(area) > 1e-12, weighted(k)).otherwise(mean(k)).alias(k) for k in ("x", "y")])

    both = lambda r: bound(F.zip_with(r, rotated(r), sums), lambda pairs: bound(signed_area(r), lambda area: centre(r, pairs, area)))
    return bound(ring, both)


def perspective(p: XY, m: list) -> XY:
    """Point under a row-major 3x3 matrix of numbers or columns."""
    w = m[6] * p[0] + m[7] * p[1] + m[8]
    return (m[0] * p[0] + m[1] * p[1] + m[2]) / w, (m[3] * p[0] + m[4] * p[1] + m[5]) / w


def facing_degrees(a: XY, b: XY) -> Column:
    """Direction of ab in degrees."""
    return F.degrees(F.atan2(b[1] - a[1], b[0] - a[0]))


def offset_by_angle(p: XY, degrees: Column, by: Column) -> XY:
    return p[0] + F.cos(F.radians(degrees)) * by, p[1] + F.sin(F.radians(degrees)) * by


def perpendicular_line(center: XY, other: XY, width: float) -> tuple[XY, XY]:
    """A line of ``width`` across the direction from center to other; along y where they coincide."""
    dx, dy = other[0] - center[0], other[1] - center[1]
    length = F.sqrt(dx * dx + dy * dy)
    nx = F.when(length > 1e-9, -dy / length).otherwise(F.lit(0.0)) * (width / 2)
    ny = F.when(length > 1e-9, dx / length).otherwise(F.lit(1.0)) * (width / 2)
    return (center[0] - nx, center[1] - ny), (center[0] + nx, center[1] + ny)


def layer_z(layer: Column, explicit: Column, floor_height: float, default_z: float = 0.0) -> Column:
    """Explicit height, else the floor number times the height (B2: two floors down), else the default."""
    below = F.nullif(F.regexp_extract(F.upper(layer), r"^B(\d+)", 1), F.lit("")).cast("int")
    above = F.nullif(F.regexp_extract(F.upper(layer), r"^(?:L|F)?(\d+)F?$", 1), F.lit("")).cast("int")
    return F.coalesce(explicit, -below * floor_height, (above - 1) * floor_height, F.lit(default_z))
