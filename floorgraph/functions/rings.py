"""Edits of rings as array expressions; positions are zero-based, results null where an edit is not allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorgraph.functions.geometry import bound, crosses_upward_ray, point_segment_distance, ring_area, rotated


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _valid(ring: Column, condition: Column) -> Column:
    """At least three points and an area above one."""
    return F.when(condition, bound(ring, lambda r: F.when((F.size(r) >= 3) & (ring_area(r) > 1), r)))


def move_vertex(ring: Column, at: Column, to: Column) -> Column:
    inside = (at >= 0) & (at < F.size(ring))
    return _valid(F.transform(ring, lambda p, i: F.when(i == at, to).otherwise(p)), inside)


def insert_vertex(ring: Column, after: Column, new: Column) -> Column:
    inside = (after >= 0) & (after < F.size(ring))
    return _valid(F.concat(F.slice(ring, F.lit(1), after + 1), F.array(new), F.slice(ring, after + 2, F.size(ring))), inside)


def keep_vertices(ring: Column, kept: Column) -> Column:
    """The vertices at the kept positions, in the ring's order."""
    return _valid(F.filter(ring, lambda p, i: F.array_contains(kept, i)), F.forall(kept, lambda i: (i >= 0) & (i < F.size(ring))))


def cyclic_path(ring: Column, start: Column, end: Column) -> Column:
    """Points from one position forward to another, around the end."""
    n = F.size(ring)
    count = F.pmod(end - start, n) + 1
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.element_at(ring, (F.pmod(start + i, n) + 1).cast("int")))


def straighten(ring: Column, start: Column, end: Column, remove_forward: bool = True) -> Column:
    """The ring without the inner points of one of the two paths between two positions."""
    kept = cyclic_path(ring, end, start) if remove_forward else cyclic_path(ring, start, end)
    return _valid(kept, start != end)


def split_by_vertices(ring: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """The two rings on either side of the line between two vertices."""
    apart = (F.pmod(b - a, F.size(ring)) > 1) & (F.pmod(a - b, F.size(ring)) > 1)
    return _valid(cyclic_path(ring, a, b), apart), _valid(cyclic_path(ring, b, a), apart)


def replace_path(ring: Column, start: Column, end: Column, path: Column, backward: bool = False, order: str = "auto") -> Column:
    """The path from one position forward (or ``backward``) to another, replaced by another path.

    ``order`` auto turns the new path the way that its ends are nearer, reverse
    takes it as it lies along the old one, keep against it.
    """
    if order not in ("auto", "keep", "reverse"):
        raise ValueError("order must be auto, keep or reverse")
    low, high = (end, start) if backward else (start, end)
    first, last = F.element_at(ring, (low + 1).cast("int")), F.element_at(ring, (high + 1).cast("int"))
    away = lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
    head, tail = F.element_at(path, 1), F.element_at(path, -1)
    nearer = away(first, head) + away(last, tail) <= away(first, tail) + away(last, head)
    turned = {"auto": F.when(nearer, path).otherwise(F.reverse(path)), "keep": F.reverse(path), "reverse": path}[order]
    rest = cyclic_path(ring, high, low)
    return _valid(F.concat(turned, F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 2, F.lit(0)))), (start != end) & (F.size(path) >= 2))


def _edges(ring: Column) -> Column:
    return bound(ring, lambda r: F.zip_with(r, rotated(r), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def split_by_line(ring: Column, p: Column, q: Column, holes: Column | None = None) -> Column:
    """The two rings, as (a, b), on either side of the line through two points; null unless it meets the boundary at two places.

    Hits nearer than 1e-4 to one before along the line are that one, hits so
    near to the begin of their edge are its vertex.  A ring with holes, equal
    points, and parts of fewer than three points or an area of one or less give
    null.
    """
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    near = lambda a, b, eps: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) <= eps * eps

    def hit(e: Column, i: Column) -> Column:
        ex, ey, ox, oy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"], e["a"]["x"] - p["x"], e["a"]["y"] - p["y"]
        turn = dx * ey - dy * ex
        t, u = (ox * ey - oy * ex) / turn, (ox * dy - oy * dx) / turn
        at = point(p["x"] + t * dx, p["y"] + t * dy)
        u_in = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u))
        fine = (F.abs(turn) > 1e-6) & (u >= -1e-6) & (u <= 1 + 1e-6)
        return F.when(fine, F.struct(t.alias("t"), i.alias("edge"), u_in.alias("u"), F.when(near(at, e["a"], 1e-4), e["a"]).otherwise(at).alias("at")))

    def kept(hits: Column) -> Column:
        empty = F.filter(hits, lambda h: F.lit(False))
        return F.aggregate(hits, empty, lambda s, h: F.when(F.exists(s, lambda k: near(k["at"], h["at"], 1e-4)), s).otherwise(F.concat(s, F.array(h))))

    def parts(two: Column) -> Column:
        one, other = two[0], two[1]
        n = F.size(ring)
        ahead = lambda a, b, count: F.transform(F.sequence(F.lit(1), count), lambda k: F.element_at(ring, (F.pmod(a["edge"] + k, n) + 1).cast("int")))
        inner = F.when(other["edge"] > one["edge"], ahead(one, other, other["edge"] - one["edge"])).otherwise(F.slice(ring, 1, 0))
        outer = ahead(other, one, n - (other["edge"] - one["edge"]))
        cut = lambda a, between, b: without_repeats(F.concat(F.array(a["at"]), between, F.array(b["at"])))
        return F.struct(_valid(cut(one, inner, other), F.lit(True)).alias("a"), _valid(cut(other, outer, one), F.lit(True)).alias("b"))

    by_place = lambda hits: F.array_sort(F.transform(hits, lambda h: F.struct(h["edge"].alias("edge"), h["u"].alias("u"), h["at"].alias("at"))))
    hits = kept(F.array_sort(F.array_compact(F.transform(_edges(ring), hit))))
    whole = (F.size(F.coalesce(holes, F.array())) == 0 if holes is not None else F.lit(True)) & ((dx * dx + dy * dy) > 1e-12)
    both = bound(hits, lambda h: F.when(whole & (F.size(h) == 2), bound(by_place(h), parts)))
    return bound(both, lambda b: F.when(b["a"].isNotNull() & b["b"].isNotNull(), b))


def _holds(edges: Column, p: Column) -> Column:
    at = (p["x"], p["y"])
    ends = lambda e: ((e["a"]["x"], e["a"]["y"]), (e["b"]["x"], e["b"]["y"]))
    crossed = F.aggregate(edges, F.lit(0), lambda s, e: s + crosses_upward_ray(at, *ends(e)).cast("int")) % 2 == 1
    return crossed | F.exists(edges, lambda e: point_segment_distance(at, *ends(e)) <= 1e-9)


def holds(ring: Column, p: Column) -> Column:
    """Whether a point lies in a ring or on its boundary."""
    return bound(_edges(ring), lambda edges: bound(p, lambda q: _holds(edges, q)))


def polygon(outer: Column, holes: Column) -> Column:
    """A ring with holes as one value (outer, holes); null unless all rings are sound and every hole's points lie in the outer one."""
    inside = lambda edges, held: F.forall(held, lambda h: (F.size(h) >= 3) & (ring_area(h) > 1) & F.forall(h, lambda p: _holds(edges, p)))
    whole = lambda o, held: F.when(o.isNotNull() & bound(_edges(o), lambda edges: inside(edges, held)), F.struct(o.alias("outer"), held.alias("holes")))
    return bound(holes, lambda held: bound(_valid(outer, F.lit(True)), lambda o: whole(o, held)))


def cut_hole(shape: Column, hole: Column) -> Column:
    """The polygon with one hole more; null where that is not allowed."""
    return bound(shape, lambda s: polygon(s["outer"], F.concat(s["holes"], F.array(without_repeats(hole)))))


def move_polygon_vertex(shape: Column, at: Column, to: Column, hole: Column | None = None) -> Column:
    """The polygon with a vertex of its outer ring, or of a hole by its position, moved; null where that is not allowed."""
    put = lambda ring: F.when((at >= 0) & (at < F.size(ring)), without_repeats(F.transform(ring, lambda p, i: F.when(i == at, to).otherwise(p))))
    if hole is None:
        return bound(shape, lambda s: polygon(bound(s["outer"], put), s["holes"]))
    known = lambda s: (hole >= 0) & (hole < F.size(s["holes"]))
    return bound(shape, lambda s: F.when(known(s), polygon(s["outer"], F.transform(s["holes"], lambda h, i: F.when(i == hole, put(h)).otherwise(h)))))


def splice(a: Column, a_at: Column, b: Column, b_at: Column) -> Column:
    """Two rings joined through one vertex of each: around the first, then around the second."""
    n, m = F.size(a), F.size(b)
    return F.concat(cyclic_path(a, a_at, F.pmod(a_at - 1, n)), cyclic_path(b, b_at, F.pmod(b_at - 1, m)))


def without_repeats(ring: Column, tolerance: float = 1e-8) -> Column:
    """Points that differ from the last one kept; a closing repeat goes as well."""
    same = lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance + 1e-5 * F.abs(q["x"])) & (F.abs(p["y"] - q["y"]) <= tolerance + 1e-5 * F.abs(q["y"]))
    kept = lambda r: F.aggregate(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1), lambda s, p: F.when(same(F.element_at(s, -1), p), s).otherwise(F.concat(s, F.array(p))))
    closed = lambda k: F.when((F.size(k) > 1) & same(F.element_at(k, 1), F.element_at(k, -1)), F.slice(k, F.lit(1), F.size(k) - 1)).otherwise(k)
    return bound(bound(ring, kept), closed)


def thinned(values: Column, eps: float) -> Column:
    """Sorted numbers without those within eps of one kept before."""
    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), lambda s, v: F.when(F.exists(s, lambda k: F.abs(k - v) < eps), s).otherwise(F.concat(s, F.array(v))))
