"""Queries over outlines: adjacency, what lies near a bridge, links that join outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorgraph.functions import geometry as g
from floorgraph.functions import rings as rg
from floorgraph.functions import tables
from floorgraph.operators import forest as fo
from floorgraph.operators import outlines as ol
from floorgraph.sources.shared import dealt
from floorgraph.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_C = F.col


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _sql_rings(name: str, table: str, key: str, colour: str, corners: list[tuple[str, str]]) -> str:
    """Rings ``name`` with box and centroid, and their segments ``name_s``."""
    xs, ys = (", ".join(p[k] for p in corners) for k in (0, 1))
    n = len(corners)
    return f"""{name}_r as (select {key} as k, {colour} as colour, [{xs}]::double[] as px, [{ys}]::double[] as py from {table}),
  {name}_s as (select k, i, px[i] as sx, py[i] as sy, px[i % {n} + 1] as tx, py[i % {n} + 1] as ty from {name}_r, range(1, {n + 1}) t(i)),
  {name} as (select r.k, colour, list_min(px) as x0, list_min(py) as y0, list_max(px) as x1, list_max(py) as y1, cx, cy from {name}_r r join
    (select k, sum((sx + tx) * (sx * ty - tx * sy)) / (3 * sum(sx * ty - tx * sy)) as cx, sum((sy + ty) * (sx * ty - tx * sy)) / (3 * sum(sx * ty - tx * sy)) as cy from {name}_s group by k) using (k))"""


def _sql_distance(a: str, b: str) -> str:
    """Distance ``d`` of the rings of all ``pairs`` (a, b): all segments against each other, all corners inside or not."""
    to_segment = lambda p, q, s, e: f"(select sqrt(power({p} - {s}x - t * ({e}x - {s}x), 2) + power({q} - {s}y - t * ({e}y - {s}y), 2)) from (select case when power({e}x - {s}x, 2) + power({e}y - {s}y, 2) <= 0 then 0 else greatest(0, least(1, (({p} - {s}x) * ({e}x - {s}x) + ({q} - {s}y) * ({e}y - {s}y)) / (power({e}x - {s}x, 2) + power({e}y - {s}y, 2)))) end as t))"
    turns = lambda p, q, r: f"(({r}y - {p}y) * ({q}x - {p}x) > ({q}y - {p}y) * ({r}x - {p}x))"
    ends = ", ".join([to_segment("u.sx", "u.sy", "v.s", "v.t"), to_segment("u.tx", "u.ty", "v.s", "v.t"), to_segment("v.sx", "v.sy", "u.s", "u.t"), to_segment("v.tx", "v.ty", "u.s", "u.t")])
    cross = f"{turns('u.s', 'v.s', 'v.t')} <> {turns('u.t', 'v.s', 'v.t')} and {turns('u.s', 'u.t', 'v.s')} <> {turns('u.s', 'u.t', 'v.t')}"
    inside = lambda p, q, pk, qk: f"""select a, b from (select a, b, v.i, sum(((e.sy > v.sy) <> (e.ty > v.sy) and v.sx < (e.tx - e.sx) * (v.sy - e.sy) / (case when abs(e.ty - e.sy) < 1e-9 then 1e-9 else e.ty - e.sy end) + e.sx)::int) as n
        from pairs join {p}_s v on v.k = {pk} join {q}_s e on e.k = {qk} group by a, b, v.i) where n % 2 = 1"""  # noqa: E731
    return f"""d as (select a, b, min(d) as d from (
      select a, b, case when {cross} then 0 else least({ends}) end as d from pairs join {a}_s u on u.k = a join {b}_s v on v.k = b
      union all select a, b, 0 from ({inside(a, b, 'a', 'b')}) union all select a, b, 0 from ({inside(b, a, 'b', 'a')})) group by a, b)"""


_GAP = "sqrt(power(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2))"
_BETWEEN = "sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2))"
_PART = _sql_rings("q", "part", "p_partkey", "p_brand", [
    ("p_size * 20.0", "p_partkey * 0.3"), ("p_size * 20.0 + 6", "p_partkey * 0.3 - p_partkey % 4"), ("p_size * 20.0 + 6 + p_partkey % 7", "p_partkey * 0.3 + 4 + p_partkey % 3"), ("p_size * 20.0 + p_partkey % 2", "p_partkey * 0.3 + 5"),
])
_BRIDGE = _sql_rings("w", "supplier", "s_suppkey", "s_nationkey", [
    ("s_nationkey * 40.0", "s_suppkey * 6.0"), ("s_nationkey * 40.0 + 45", "s_suppkey * 6.0 - s_suppkey % 5"), ("s_nationkey * 40.0 + 42", "s_suppkey * 6.0 + 9"), ("s_nationkey * 40.0 - 3", "s_suppkey * 6.0 + 7"),
])


def part_outlines(spark: SparkSession, d: str) -> DataFrame:
    """A quadrilateral of its own shape for each part: k, colour, ring."""
    x, y, k = _C("p_size") * 20.0, _C("p_partkey") * 0.3, _C("p_partkey")
    ring = F.array(rg.point(x, y), rg.point(x + 6, y - k % 4), rg.point(x + 6 + k % 7, y + 4 + k % 3), rg.point(x + k % 2, y + 5))
    return read_table(spark, d, "part").select(k.alias("k"), _C("p_brand").alias("colour"), ring.alias("ring"))


@query(f"""
with {_PART}, p as (select a.k as a, b.k as b, {_GAP} as gap, {_BETWEEN} as centre, a.colour = b.colour as same,
    (a.cx between b.x0 and b.x1 and a.cy between b.y0 and b.y1) or (b.cx between a.x0 and a.x1 and b.cy between a.y0 and a.y1) as held from q a join q b on a.k < b.k),
  pairs as (select * from p where gap <= 14), {_sql_distance("q", "q")},
  r as (select a, b, gap, case when d <= 14 then d end as d, centre, concat_ws(',', case when gap <= 6 then 'bbox_close' end, case when held then 'centroid_inside_bbox' end,
      case when d <= 6 then 'polygon_distance' end, case when same and centre <= 14 and gap <= 14 then 'same_color_centroid' end) as reasons from pairs join d using (a, b))
select a, b, round(gap, 6) as gap, round(d, 6) as distance, round(centre, 6) as centre, reasons from r where reasons <> ''""")
def outline_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Adjacent outlines of parts, by boxes, centroids, outlines and colour, with all reasons."""
    out = ol.adjacent_outlines(part_outlines(spark, d), "k", "colour", 6.0, 14.0)
    return out.select("a", "b", *[F.round(c, 6).alias(c) for c in ("gap", "distance", "centre")], F.array_join("reasons", ",").alias("reasons"))


@query(f"""
with {_PART}, {_BRIDGE}, pairs as (select a.k as a, b.k as b, {_BETWEEN} as centre, a.colour from q a join w b on {_GAP} <= 40), {_sql_distance("q", "w")},
  n as (select b as bridge, a as polygon, colour, round(d, 9) as d, row_number() over (partition by b order by round(d, 9), round(centre, 9), a) as r from pairs join d using (a, b) where d <= 40 qualify r <= 6)
select x.bridge, x.polygon as "first", y.polygon as second, round(greatest(x.d, y.d), 2) as distance, round(least(1, greatest(0, 1 - greatest(x.d, y.d) / 40) + case when x.colour <> y.colour then 0.1 else 0 end), 3) as confidence
from n x join n y on x.bridge = y.bridge and x.r < y.r""")
def bridge_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every two of the six outlines nearest to a bridge's own, with their confidence."""
    x, y, k = _C("s_nationkey") * 40.0, _C("s_suppkey") * 6.0, _C("s_suppkey")
    ring = F.array(rg.point(x, y), rg.point(x + 45, y - k % 5), rg.point(x + 42, y + 9), rg.point(x - 3, y + 7))
    bridges = read_table(spark, d, "supplier").select(k.alias("s"), ring.alias("ring"))
    parts = part_outlines(spark, d)
    near = ol.near_bridges(parts, bridges, "k", "s", 40.0, 6)
    return ol.bridge_pairs(near, parts.select(_C("k").alias("polygon"), "colour"), 40.0)


@query("""
with recursive q as (select p_brand as o, dense_rank() over (order by p_brand) as g, p_partkey as k, p_size * 40.0 as x, p_retailprice as y from part),
  c as (select a.o as a, b.o as b, a.g as ga, b.g as gb, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 9) as d, a.k as ka, b.k as kb from q a join q b on a.g < b.g),
  e as (select a, b, ga, gb, min(d) as d, arg_min(ka, (d, ka, kb)) as ka, arg_min(kb, (d, ka, kb)) as kb from c group by a, b, ga, gb),
  s as (select *, row_number() over (order by d, a, b) as i from e), n as (select count(distinct o) as n from q),
  r as (select 0::bigint as i, list_transform(range(0, n), lambda x: x::bigint) as lab, n, false as took from n
    union all select s.i, case when n > 3 and lab[ga] <> lab[gb] then list_transform(lab, lambda x: case when x = lab[gb] then lab[ga] else x end) else lab end,
      n - (n > 3 and lab[ga] <> lab[gb])::int, n > 3 and lab[ga] <> lab[gb] from r join s on s.i = r.i + 1)
select a, b, ka as point_a, kb as point_b, round(d, 6) as distance from r join s using (i) where took""")
def span_edges(spark: SparkSession, d: str) -> DataFrame:
    """The shortest links between the vertices of outlines (a brand's parts) that leave three components."""
    part = read_table(spark, d, "part").select("p_brand", "p_partkey", (_C("p_size") * 40.0).alias("x"), _C("p_retailprice").alias("y"))
    return fo.span_edges(part, "p_brand", "p_partkey", "x", "y", target=3).select("a", "b", "point_a", "point_b", F.round("distance", 6).alias("distance"))


_NOTCH = """k as (select p_partkey as k, p_size::double as s, (1 + p_partkey % 2)::double as a, (1 + p_partkey % 3)::double as h, 0.3137 + (p_partkey % 13) * 0.2911 as c, ((p_partkey % 5) - 2) * 0.17 as m from part),
  v as (select *, [0, 4, 4, a, 0]::double[] as vx, [0, 0, 4, h, 4]::double[] as vy from k),
  e as (select k, s, i, (vx[i] * s) as ax, (vy[i] * s) as ay, (vx[i % 5 + 1] * s) as bx, (vy[i % 5 + 1] * s) as ty, c * s as c, m from v, range(1, 6) t(i))"""


def _notched(spark: SparkSession, d: str) -> DataFrame:
    """A square with a notch for each part: k, s (its scale), c and m (a line's height at zero, in the scale, and slope), ring."""
    k, s = _C("p_partkey"), _C("p_size").cast("double")
    corners = ((F.lit(0), F.lit(0)), (F.lit(4), F.lit(0)), (F.lit(4), F.lit(4)), (1 + k % 2, 1 + k % 3), (F.lit(0), F.lit(4)))
    ring = F.array(*[rg.point(x * s, y * s) for x, y in corners])
    return dealt(read_table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("k"), s.alias("s"), (0.3137 + (k % 13) * 0.2911).alias("c"), ((k % 5 - 2) * 0.17).alias("m"), ring.alias("ring"))


# with the origin on the line, what runs along it adds nothing to the area: the clipped edges alone do
@query(f"""
with {_NOTCH}, f as (select *, ay - c - m * ax as fa, ty - c - m * bx as fb from e),
  g as (select *, case when (fa > 0) <> (fb > 0) then fa / (fa - fb) end as u from f),
  q as (select *, case when fa > 0 then 0 else u end as u0, case when fb > 0 then 1 else u end as u1, case when fa > 0 then u else 0 end as w0, case when fb > 0 then u else 1 end as w1 from g),
  p as (select k, s, count(u) as hits, sum(case when fa > 0 or fb > 0 then (ax + u0 * (bx - ax)) * (ay + u1 * (ty - ay) - c) - (ax + u1 * (bx - ax)) * (ay + u0 * (ty - ay) - c) else 0 end) / 2 as above,
      sum(case when fa <= 0 or fb <= 0 then (ax + coalesce(w0, 0) * (bx - ax)) * (ay + coalesce(w1, 1) * (ty - ay) - c) - (ax + coalesce(w1, 1) * (bx - ax)) * (ay + coalesce(w0, 0) * (ty - ay) - c) else 0 end) / 2 as below from q group by k, s)
select k, case when hits = 2 and abs(above) > 1 and abs(below) > 1 then round(greatest(abs(above), abs(below)), 4) end as larger, case when hits = 2 and abs(above) > 1 and abs(below) > 1 then round(least(abs(above), abs(below)), 4) end as smaller from p""")
def line_splits(spark: SparkSession, d: str) -> DataFrame:
    """Areas of the two parts of each outline along a line; null where the line does not meet it twice."""
    s, y = _C("s"), lambda x: (_C("c") + _C("m") * x) * _C("s")
    parts = rg.split_by_line(_C("ring"), rg.point(F.lit(-1) * s, y(-1)), rg.point(F.lit(5) * s, y(5)))
    out = _notched(spark, d).select("k", parts.alias("p")).select("k", g.ring_area(_C("p.a")).alias("a"), g.ring_area(_C("p.b")).alias("b"))
    return out.select("k", *[F.when(_C("a").isNotNull(), F.round(f("a", "b"), 4)).alias(n) for f, n in ((F.greatest, "larger"), (F.least, "smaller"))])


# the hole is a square of 0.6 in the scale at (0.2, 0.2); its far corner moves to (x, x), which is in the notched square up to the notch
@query("""
with k as (select p_partkey as k, p_size::double as s, 0.5 + (p_partkey % 8) * 0.5 as x, (1 + p_partkey % 2)::double as a, (1 + p_partkey % 3)::double as h from part),
  c as (select *, 0.36 * s * s > 1 as cut, case when x < 4 then ((a - 4) * (x - 4) >= 0 and (x - 4) / (a - 4) between 0 and 1 and x <= 4 + (h - 4) * (x - 4) / (a - 4)) or (x < a and x <= 4 + (h - 4) * x / a) else x = 4 end as held from k)
select k, case when cut then 1 else 0 end::int as n_holes, case when cut then round(0.36 * s * s, 4) end as hole,
  case when cut and held and 0.6 * (x - 0.2) * s * s > 1 then round(0.6 * (x - 0.2) * s * s, 4) end as moved, false as outside from c""")
def hole_edits(spark: SparkSession, d: str) -> DataFrame:
    """A hole is cut into each outline and one of its corners moved along the diagonal; null where the hole is too small or leaves the outline."""
    k, s = _C("k"), _C("s")
    at = lambda x, y: rg.point(x * s, y * s)
    square = lambda x, w: F.array(at(F.lit(x), F.lit(x)), at(F.lit(x + w), F.lit(x)), at(F.lit(x + w), F.lit(x + w)), at(F.lit(x), F.lit(x + w)))
    none = F.array().cast("array<array<struct<x: double, y: double>>>")
    shapes = _notched(spark, d).select(k, s, rg.polygon(_C("ring"), none).alias("p"))
    cut = shapes.select(k, s, rg.cut_hole(_C("p"), square(0.2, 0.6)).alias("c"), rg.cut_hole(_C("p"), square(3.9, 0.6)).alias("o"))
    x = 0.5 + (k % 8) * 0.5
    moved = cut.select(k, "c", "o", rg.move_polygon_vertex(_C("c"), F.lit(2), at(x, x), F.lit(0)).alias("m"))
    area = lambda p: F.round(g.ring_area(_C(f"{p}.holes")[0]), 4)
    return moved.select(k, F.coalesce(F.size("c.holes"), F.lit(0)).alias("n_holes"), area("c").alias("hole"), area("m").alias("moved"), _C("o").isNotNull().alias("outside"))


@query("""
with p as (select l_orderkey as path, l_quantity as x, l_linenumber * 3.0 as y, lead(l_quantity) over o as x1, lead(l_linenumber * 3.0) over o as y1, row_number() over o as i from lineitem window o as (partition by l_orderkey order by l_linenumber, l_extendedprice)),
  s as (select *, sqrt(power(x1 - x, 2) + power(y1 - y, 2)) as len from p where x1 is not null), c as (select *, sum(len) over (partition by path order by i) - len as before from s where len > 0),
  t as (select path, sum(len) as total, greatest(0, floor((sum(len) - 12) / 2 / 10.0))::int as n from c group by path),
  g as (select path, total, k::int as gate, case when n = 0 then total / 2 when k < n then 5.0 + k * 10.0 else total - 5.0 - (2 * n - 1 - k) * 10.0 end as along from t, lateral (select unnest(range(0, greatest(1, 2 * n))) as k)),
  m as (select g.path, gate, along, arg_min(struct_pack(x := c.x, y := c.y, x1 := c.x1, y1 := c.y1, f := (along - before) / len), i) as b from g join c on c.path = g.path and along <= before + len + 1e-9 group by all)
select path, gate, round(along, 4) as along, round(b.x + b.f * (b.x1 - b.x), 4) as x, round(b.y + b.f * (b.y1 - b.y), 4) as y from m""")
def gates_on_paths(spark: SparkSession, d: str) -> DataFrame:
    """Gates along the bent path through each order's lines, by a table function in SQL text."""
    tables.register(spark)
    points = read_table(spark, d, "lineitem").select(_C("l_orderkey").alias("path"), "l_linenumber", "l_extendedprice", _C("l_quantity").alias("x"), (_C("l_linenumber") * 3.0).alias("y"))
    text = "select path, gate, round(along, 4) as along, round(x, 4) as x, round(y, 4) as y from gates_along(table({points}) partition by path order by (l_linenumber, l_extendedprice), 10.0, 12.0)"
    return spark.sql(text, points=points)
