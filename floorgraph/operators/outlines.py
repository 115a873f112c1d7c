"""Distances of outlines, which of them are adjacent, and what lies near a bridge.

Outlines are filtered by their boxes in a hierarchical grid and refined by
their segments in the same grid: only segments within reach of each other meet,
however many an outline has.  Outlines whose segments stay apart are either
apart or one inside the other, which a single point of each tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.functions import geometry as g
from floorgraph.operators import grid
from floorgraph.operators import spatial as sp
from floorgraph.sources.shared import cut, dealt, unsent

_C = F.col
#: Outlines whose pairs one task holds.
_OUTLINES = 20_000


def box_of(ring: Column) -> list[Column]:
    """x0, y0, x1, y1 of a ring of (x, y) structs."""
    return [f(F.transform(ring, lambda p: p[c])).cast("double") for f in (F.array_min, F.array_max) for c in ("x", "y")]  # noqa: B023


def _segments(outlines: DataFrame, key: str, ring: str, end: str) -> DataFrame:
    edges = sp.ring_edges(outlines.where(F.size(ring) > 0), ring, [key])
    return edges.select(_C(key).alias(f"_k{end}"), *[_C(c).cast("double").alias(f"{c}{end}") for c in ("x0", "y0", "x1", "y1")])


def _segment_box(end: str) -> list[Column]:
    return [f(_C(f"{c}0{end}"), _C(f"{c}1{end}")) for f in (F.least, F.greatest) for c in "xy"]


def _apart(pairs: DataFrame) -> DataFrame:
    """(_ka, _kb, _d) of pairs of segments: zero where they cross, else the least distance of an end of one to the other.

    In steps, so that the places along the segments are worked out once.
    """
    ends = {end: [(_C(f"x{k}{end}"), _C(f"y{k}{end}")) for k in (0, 1)] for end in "ab"}
    sides = [(p, *ends[other]) for own, other in ("ab", "ba") for p in ends[own]]
    kept = ["_ka", "_kb", *[f"{c}{end}" for end in "ab" for c in ("x0", "y0", "x1", "y1")]]
    placed = pairs.select(*kept, *[g.segment_parameter(*side).alias(f"_t{k}") for k, side in enumerate(sides)])
    offset = lambda p, a, b, t, c: p[c] - a[c] - t * (b[c] - a[c])
    offsets = [offset(*side, _C(f"_t{k}"), c).alias(f"_o{k}{c}") for k, side in enumerate(sides) for c in (0, 1)]
    apart = placed.select(*kept, *offsets)
    least = F.sqrt(F.least(*[_C(f"_o{k}0") * _C(f"_o{k}0") + _C(f"_o{k}1") * _C(f"_o{k}1") for k in range(len(sides))]))
    return apart.select("_ka", "_kb", F.when(g.segments_cross(*ends["a"], *ends["b"]), F.lit(0.0)).otherwise(least).alias("_d"))


def _inside(a: DataFrame, b: DataFrame, a_key: str, b_key: str, a_ring: str, b_ring: str) -> DataFrame:
    """(_ka, _kb) of outlines a whose first point lies in outline b."""
    first = F.element_at(a_ring, 1)
    points = a.where(F.size(a_ring) > 0).select(_C(a_key).alias("_ka"), first["x"].cast("double").alias("_x"), first["y"].cast("double").alias("_y"))
    rings = b.where(F.size(b_ring) > 0).select(_C(b_key).alias("_kb"), _C(b_ring).alias("_r"))
    return sp.points_in_rings(points, rings, "_ka", "_x", "_y", "_kb", "_r").select("_ka", "_kb")


def outline_distances(a: DataFrame, b: DataFrame, a_key: str, b_key: str, reach: float, a_ring: str = "ring", b_ring: str = "ring") -> DataFrame:
    """(a, b, distance) of the outlines of ``a`` and ``b`` (key, ring of (x, y) structs) at most ``reach`` apart.

    Zero where they touch, cross, or one lies inside the other; else the least
    distance of their segments.  Null and empty rings and points that are not
    finite take no part; a ring of one point is that point.  Rows of one key are
    one outline in several rings.
    """
    a, b = dealt(a.select(a_key, a_ring), a_key, rows=_OUTLINES), dealt(b.select(b_key, b_ring), b_key, rows=_OUTLINES)
    left, right = _segments(a, a_key, a_ring, "a"), _segments(b, b_key, b_ring, "b")
    near = _apart(grid.meeting(left, right, _segment_box("a"), _segment_box("b"), reach))
    zero = F.lit(0.0).alias("_d")
    within = _inside(a, b, a_key, b_key, a_ring, b_ring).select("_ka", "_kb", zero)
    around = _inside(b, a, b_key, a_key, b_ring, a_ring).select(_C("_kb").alias("_ka"), _C("_ka").alias("_kb"), zero)
    least = near.unionAll(within).unionAll(around).groupBy(_C("_ka").alias("a"), _C("_kb").alias("b")).agg(F.min("_d").alias("distance"))
    return least.where(_C("distance") <= reach)


def _point_in_box(p: g.XY, box: list[Column]) -> Column:
    return p[0].between(box[0], box[2]) & p[1].between(box[1], box[3])


def adjacent_outlines(outlines: DataFrame, key: str, colour: str, adjacency: float, same_colour: float, ring: str = "ring") -> DataFrame:
    """(a, b, gap, distance, centre, reasons) of adjacent outlines (key, colour, ring), each pair once, a before b.

    Reasons, in this order: ``bbox_close`` (boxes at most ``adjacency`` apart),
    ``centroid_inside_bbox`` (of either in the other's box), ``polygon_distance``
    (outlines at most ``adjacency`` apart) and ``same_color_centroid`` (of one
    colour, centroids and boxes at most ``same_colour`` apart); pairs without any
    are left out.  ``distance`` is null beyond the greater of both limits.
    """
    reach = max(adjacency, same_colour)
    boxed = cut(outlines.where(F.size(ring) > 0).select(
        _C(key).alias("k"), _C(colour).alias("colour"), _C(ring).alias("ring"), g.ring_centroid(_C(ring)).alias("c"),
        *[c.alias(n) for c, n in zip(box_of(_C(ring)), ("x0", "y0", "x1", "y1"), strict=True)],
    ))
    pairs = sp.box_pairs(boxed.drop("ring"), "k", ["x0", "y0", "x1", "y1"], reach)
    rings = boxed.select("k", "ring")
    apart = outline_distances(rings, rings.withColumnRenamed("k", "_k2"), "k", "_k2", reach).where("a < b")
    rows = pairs.join(apart.withColumnsRenamed({"a": "_a", "b": "_b", "distance": "_d"}), (_C("k") == _C("_a")) & (_C("k_b") == _C("_b")), "left")
    box = lambda end: [_C(f"{c}{end}") for c in ("x0", "y0", "x1", "y1")]
    centre = lambda end: (_C(f"c{end}.x"), _C(f"c{end}.y"))
    between = g.distance(centre(""), centre("_b"))
    holds = {
        "bbox_close": _C("gap") <= adjacency,
        "centroid_inside_bbox": _point_in_box(centre(""), box("_b")) | _point_in_box(centre("_b"), box("")),
        "polygon_distance": F.coalesce(_C("_d") <= adjacency, F.lit(False)),
        "same_color_centroid": (_C("colour") == _C("colour_b")) & (between <= same_colour) & (_C("gap") <= same_colour),
    }
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in holds.items()]))
    out = rows.select(_C("k").alias("a"), _C("k_b").alias("b"), "gap", _C("_d").alias("distance"), between.alias("centre"), reasons.alias("reasons"))
    return out.where(F.size("reasons") > 0)


def near_bridges(polygons: DataFrame, bridges: DataFrame, polygon_id: str, bridge_id: str, search: float, most: int, ring: str = "ring") -> DataFrame:
    """(bridge, polygon, distance, centre, rank): of each bridge the ``most`` outlines nearest to its own, at most ``search`` away.

    Nearest first by outline distance, then by that of the centroids, then by id; both to nine places.
    """
    centroid = lambda df, key, end: df.where(F.size(ring) > 0).select(_C(key).alias(f"_id{end}"), g.ring_centroid(_C(ring)).alias(f"_c{end}"))
    apart = outline_distances(polygons, bridges, polygon_id, bridge_id, search, ring, ring)
    rows = apart.join(unsent(centroid(polygons, polygon_id, "a")), _C("a") == _C("_ida")).join(unsent(centroid(bridges, bridge_id, "b")), _C("b") == _C("_idb"))
    centre = g.distance((_C("_ca.x"), _C("_ca.y")), (_C("_cb.x"), _C("_cb.y")))
    rows = rows.select(_C("b").alias("bridge"), _C("a").alias("polygon"), F.round("distance", 9).alias("distance"), F.round(centre, 9).alias("centre"))
    w = Window.partitionBy("bridge").orderBy("distance", "centre", "polygon")
    return rows.withColumn("rank", F.row_number().over(w)).where(_C("rank") <= most)


def bridge_pairs(near: DataFrame, colours: DataFrame, search: float) -> DataFrame:
    """(bridge, first, second, distance, confidence): every two outlines near a bridge, as :func:`near_bridges` ranks them.

    The distance is the greater of both; confidence falls with it to zero at
    ``search``, and is a tenth higher, one at most, for different ``colours`` (polygon, colour).
    """
    of = near.join(unsent(colours), "polygon").select("bridge", "rank", "polygon", "distance", "colour")
    pairs = of.join(of.select(_C("bridge").alias("_b"), *[_C(c).alias(f"{c}_2") for c in ("rank", "polygon", "distance", "colour")]), (_C("bridge") == _C("_b")) & (_C("rank") < _C("rank_2")))
    far = F.greatest("distance", "distance_2")
    bonus = F.when(_C("colour").eqNullSafe(_C("colour_2")), 0.0).otherwise(0.1)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - far / max(1.0, search)) + bonus)
    return pairs.select("bridge", _C("polygon").alias("first"), _C("polygon_2").alias("second"), F.round(far, 2).alias("distance"), F.round(sure, 3).alias("confidence"))
