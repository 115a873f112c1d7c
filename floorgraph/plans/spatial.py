"""Queries of geometry and joins by place over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorgraph.functions import geometry as g
from floorgraph.operators import lookup as lk
from floorgraph.operators import spatial as sp
from floorgraph.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_C = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_EVENTS = """e as (select user_id, event_id, (event_id % 97)::double as x, round(value, 4) as y, lead((event_id % 97)::double) over w as x1, lead(round(value, 4)) over w as y1,
      row_number() over w as i from events window w as (partition by user_id order by ts, event_id))"""


def _path(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("user_id", "event_id", "ts", (_C("event_id") % 97).cast("double").alias("x"), F.round("value", 4).alias("y"))
    return sp.segments(e, "user_id", ["ts", "event_id"], "x", "y")


@query(f"""
with {_EVENTS}
select user_id, event_id, round(coalesce(sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)), 0), 4) as length,
       round(coalesce(sum(coalesce(sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)), 0)) over (partition by user_id order by i rows between unbounded preceding and 1 preceding), 0), 4) as before from e""")
def polyline_length(spark: SparkSession, d: str) -> DataFrame:
    return _path(spark, d).select("user_id", "event_id", F.round("length", 4).alias("length"), F.round("before", 4).alias("before"))


@query("""
with a as (select user_id, event_id::double as p, avg(value) as v from events group by all), s as (select user_id, min(p) as lo, max(p) as hi from a group by user_id),
     g as (select user_id, unnest(generate_series(0, 10)) as k, lo, hi from s), q0 as (select distinct user_id, floor(lo) - 5 + k * floor((hi - lo + 10) / 10) as place from g),
     q as (select q0.user_id, place, arg_max(a.v, a.p) filter (a.p <= place) as v0, max(a.p) filter (a.p <= place) as a0, arg_min(a.v, a.p) filter (a.p >= place) as v1, min(a.p) filter (a.p >= place) as a1
           from q0 join a using (user_id) group by q0.user_id, place)
select user_id, place, round(coalesce(v0 + case when a1 > a0 then (place - a0) / (a1 - a0) else 0 end * (v1 - v0), v0, v1), 4) as v from q""")
def interpolate_grid(spark: SparkSession, d: str) -> DataFrame:
    """A grid of eleven places for each user, values between the events around them."""
    a = read_table(spark, d, "events").groupBy("user_id", _C("event_id").cast("double").alias("place")).agg(F.avg("value").alias("v"))
    s = a.groupBy("user_id").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    place = F.floor("lo") - 5 + _C("k") * F.floor((_C("hi") - _C("lo") + 10) / 10)
    grid = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10)))).select("user_id", place.cast("double").alias("place")).distinct()
    return sp.interpolate(grid, a, "user_id", "place", "v").withColumn("v", F.round("v", 4))


# rings as (name, layer, points): a square, an L and a triangle
_RINGS = {
    "square": ("A", [(2.0, 1000.0), (12.0, 1000.0), (12.0, 6000.0), (2.0, 6000.0)]),
    "ell": (None, [(8.0, 0.0), (22.0, 0.0), (22.0, 3000.0), (15.0, 3000.0), (15.0, 9000.0), (8.0, 9000.0)]),
    "triangle": ("B", [(0.5, -1000.0), (24.5, -1000.0), (10.5, 4321.0)]),
}
_RING_SQL = "r as (select * from (values " + ", ".join(f"('{k}', {'null' if layer is None else repr(layer)}, {[{'x': x, 'y': y} for x, y in pts]})" for k, (layer, pts) in _RINGS.items()) + ") r(ring_id, layer, ring))"
_PARITY = """h as (select c.*, r.ring_id, r.layer, (select abs(sum(ring[i].x * ring[i % len(ring) + 1].y - ring[i % len(ring) + 1].x * ring[i].y)) / 2 from (select unnest(generate_series(1, len(ring))) as i)) as area
      from c join r on (select sum(case when ((ring[i].y > y) <> (ring[i % len(ring) + 1].y > y)) and x < (ring[i % len(ring) + 1].x - ring[i].x) * (y - ring[i].y) /
            (case when abs(ring[i % len(ring) + 1].y - ring[i].y) < 1e-9 then 1e-9 else ring[i % len(ring) + 1].y - ring[i].y end) + ring[i].x then 1 else 0 end) from (select unnest(generate_series(1, len(ring))) as i)) % 2 = 1)"""


def _rings(spark: SparkSession) -> DataFrame:
    rows = [(k, layer, pts) for k, (layer, pts) in _RINGS.items()]
    return spark.createDataFrame(rows, "ring_id string, layer string, ring array<struct<x: double, y: double>>")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select("c_custkey", _C("c_nationkey").cast("double").alias("x"), _C("c_acctbal").alias("y"), "c_mktsegment")


_CUSTOMERS = "c as (select c_custkey, c_nationkey::double as x, c_acctbal as y, c_mktsegment from customer)"


@query(f"with {_CUSTOMERS}, {_RING_SQL}, {_PARITY}, b as (select c_custkey, arg_min(ring_id, (area, ring_id)) as ring_id, count(*) as n from h group by 1) select c_custkey, ring_id, coalesce(n, 0)::bigint as n_rings from c left join b using (c_custkey)")
def point_in_ring(spark: SparkSession, d: str) -> DataFrame:
    """The smallest ring around each customer's point."""
    points = _customers(spark, d)
    hits = sp.points_in_rings(points, _rings(spark), "c_custkey", "x", "y", "ring_id", "ring")
    return sp.smallest_ring(points, hits, "c_custkey", "ring_id").select("c_custkey", "ring_id", "n_rings")


@query(f"""with {_CUSTOMERS}, {_RING_SQL}, {_PARITY}, m as (select c_custkey, arg_min(ring_id, ring_id) as zone from h where layer is null or c_mktsegment = 'BUILDING' or (c_mktsegment = 'MACHINERY' and layer = 'A') group by 1)
select c_custkey, coalesce(zone, 'public') as zone from c left join m using (c_custkey)""")
def zone_tag(spark: SparkSession, d: str) -> DataFrame:
    """First zone that holds the point, where the layers are equal or either is null; else public."""
    layer = F.when(_C("c_mktsegment") == "BUILDING", F.lit(None).cast("string")).when(_C("c_mktsegment") == "MACHINERY", F.lit("A")).otherwise(F.lit("other"))
    points = _customers(spark, d).withColumn("own", layer)
    hits = sp.points_in_rings(points, _rings(spark), "c_custkey", "x", "y", "ring_id", "ring", ["layer"]).where("layer is null or own is null or own = layer")
    zone = hits.groupBy(_C("c_custkey").alias("_k")).agg(F.min("ring_id").alias("zone"))
    return points.join(zone, _C("c_custkey") == _C("_k"), "left").select("c_custkey", F.coalesce("zone", F.lit("public")).alias("zone"))


@query("""
with b as (select s_suppkey, s_nationkey - 1.0 as x0, s_nationkey + 1.0 as x1, s_acctbal - 200 as y0, s_acctbal + 200 as y1 from supplier),
     p as (select c_custkey, s_suppkey, round(sqrt(power(greatest(0, x0 - c_nationkey, c_nationkey - x1), 2) + power(greatest(0, y0 - c_acctbal, c_acctbal - y1), 2)), 9) as d from customer, b)
select c_custkey, arg_min(s_suppkey, (d, s_suppkey)) as s_suppkey, round(min(d), 4) as distance from p group by c_custkey""")
def nearest_bbox(spark: SparkSession, d: str) -> DataFrame:
    s, n, a = read_table(spark, d, "supplier"), _C("s_nationkey"), _C("s_acctbal")
    boxes = s.select("s_suppkey", (n - 1.0).alias("x0"), (a - 200).alias("y0"), (n + 1.0).alias("x1"), (a + 200).alias("y1"))
    out = sp.nearest_box(_customers(spark, d), boxes, "c_custkey", (_C("x"), _C("y")), "s_suppkey", ("x0", "y0", "x1", "y1"))
    return out.withColumn("distance", F.round("distance", 4))


@query("""
with v as (select p_retailprice as p, list(p_partkey order by p_partkey)[1:7] as ks from part group by 1),
     w as (select p, list({'p': p, 'ks': ks}) over (order by p rows between 6 preceding and 6 following) as near from v),
     u as (select p, unnest(near) as x from w), c as (select p, abs(x.p - p) as d, unnest(x.ks) as b from u where abs(x.p - p) <= 5),
     n as (select p_partkey as a, b, d from part join c on p_retailprice = p where p_partkey <> b),
     k as (select a, b, d, p_type as tb, row_number() over (partition by a order by round(d, 6), b) as r from n join part on p_partkey = b qualify r <= 6)
select x.a, x.b as first_part, y.b as second_part, round(x.d + y.d, 2) as distance, round(greatest(0, 1 - (x.d + y.d) / 10) + case when x.tb <> y.tb then 0.1 else 0 end, 3) as confidence from k x join k y on x.a = y.a and x.r < y.r""")
def range_topk_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The six nearest parts by price of every part, and the pairs among them with a confidence."""
    part = read_table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    near = sp.nearest_in_range(part, "p_partkey", "p_retailprice", 5.0, 6).select(_C("p_partkey").alias("a"), _C("other").alias("b"), _C("distance").alias("d"), _C("rank").alias("r"))
    top = near.join(part.select(_C("p_partkey").alias("b"), _C("p_type").alias("t")), "b").select("a", "b", "t", "d", "r")
    two = top.select("a", *[_C(c).alias(f"{c}2") for c in ("b", "t", "d", "r")])
    pairs = top.join(two, "a").where("r < r2")
    total = _C("d") + _C("d2")
    confidence = F.greatest(F.lit(0.0), 1 - total / 10) + F.when(_C("t") != _C("t2"), 0.1).otherwise(0.0)
    return pairs.select("a", _C("b").alias("first_part"), _C("b2").alias("second_part"), F.round(total, 2).alias("distance"), F.round(confidence, 3).alias("confidence"))


_BOX = "q as (select p_partkey as k, p_brand, p_size * 20.0 as x0, p_retailprice as y0, p_size * 20.0 + 6 as x1, p_retailprice + 4 as y1 from part)"


@query(f"""
with {_BOX}, g as (select a.k as a, b.k as b, sqrt(power(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)) as gap, sqrt(power(a.x0 - b.x0, 2) + power(a.y0 - b.y0, 2)) as centre, a.p_brand = b.p_brand as same
  from q a join q b on a.k < b.k)
select a, b, round(gap, 4) as gap, round(centre, 4) as centre, gap = 0 as overlap, gap <= 8 as close, same as same_colour, same and centre <= 20 as same_colour_centroid from g where gap <= 20""")
def pair_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of boxes within a gap with the reasons for which they are adjacent."""
    size, price = _C("p_size") * 20.0, _C("p_retailprice")
    boxes = read_table(spark, d, "part").select(_C("p_partkey").alias("k"), "p_brand", size.alias("x0"), price.alias("y0"), (size + 6).alias("x1"), (price + 4).alias("y1"))
    pairs = sp.crowded_pairs(boxes, "k", ["x0", "y0", "x1", "y1"], 20.0)
    centre = g.distance((_C("x0"), _C("y0")), (_C("x0_b"), _C("y0_b")))
    same = _C("p_brand") == _C("p_brand_b")
    return pairs.select(_C("k").alias("a"), _C("k_b").alias("b"), g.rounded(_C("gap"), 4).alias("gap"), g.rounded(centre, 4).alias("centre"), (_C("gap") == 0).alias("overlap"), (_C("gap") <= 8).alias("close"), same.alias("same_colour"), (same & (centre <= 20)).alias("same_colour_centroid"))


@query("""
with q as (select p_brand, p_partkey as k, p_size::double as x, p_retailprice as y from part), n as (select p_brand as a, lead(p_brand) over (order by p_brand) as b from (select distinct p_brand from part))
select a.p_brand as brand_a, b.p_brand as brand_b, arg_min(a.k, (round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 9), a.k, b.k)) as a, arg_min(b.k, (round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 9), a.k, b.k)) as b,
       round(min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))), 4) as distance from n join q a on a.p_brand = n.a join q b on b.p_brand = n.b group by 1, 2""")
def closest_pair(spark: SparkSession, d: str) -> DataFrame:
    """The closest vertices of each outline (a brand's parts) and the next one."""
    part = read_table(spark, d, "part")
    brands = part.select("p_brand").distinct()
    after = F.lead("p_brand").over(Window.orderBy("p_brand"))  # a row for each brand
    neighbours = brands.select(_C("p_brand").alias("by_a"), after.alias("by_b")).where("by_b is not null")
    best = sp.closest_pairs(part, "p_brand", "p_partkey", "p_size", "p_retailprice", neighbours)
    return best.select(_C("by_a").alias("brand_a"), _C("by_b").alias("brand_b"), "a", "b", F.round("distance", 4).alias("distance"))


@query("""select l_orderkey, l_linenumber, round((1.2 * l_quantity + 0.001 * l_extendedprice + 5) / w, 4) as px, round((-0.1 * l_quantity + 0.002 * l_extendedprice - 3) / w, 4) as py
from (select *, 0.0005 * l_quantity + 0.000001 * l_extendedprice + 1 as w from lineitem)""")
def perspective_points(spark: SparkSession, d: str) -> DataFrame:
    m = [1.2, 0.001, 5.0, -0.1, 0.002, -3.0, 0.0005, 0.000001, 1.0]
    x, y = g.perspective((_C("l_quantity"), _C("l_extendedprice")), m)
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"))


@query("""
with z as (select p_partkey, p_size, (case when p_size = 7 then -7.0 when p_size % 3 = 0 then -(p_size % 6 + 1) * 5.0 when p_size % 3 = 1 then (p_size % 4) * 5.0 else 0.0 end)::double as z from part)
select p_partkey, z as layer_z, case when p_size % 5 = 0 then z - 1 when p_size % 5 = 1 then 2 else z end::double as polygon_z from z""")
def layer_z(spark: SparkSession, d: str) -> DataFrame:
    """Height of a layer, and of a polygon: its offset beats its own height."""
    s = _C("p_size")
    layer = F.when(s % 3 == 0, F.concat(F.lit("B"), (s % 6 + 1).cast("string"))).when(s % 3 == 1, F.concat((s % 4 + 1).cast("string"), F.lit("F"))).otherwise(F.lit("OUTSIDE"))
    z = g.layer_z(layer, F.when(s == 7, -7.0), 5.0)
    polygon = F.coalesce(z + F.when(s % 5 == 0, -1.0), F.when(s % 5 == 1, 2.0), z)
    return read_table(spark, d, "part").select("p_partkey", z.alias("layer_z"), polygon.alias("polygon_z"))


@query(f"""
with {_EVENTS}, t as (select *, case when (x1 - x) * (x1 - x) + (y1 - y) * (y1 - y) <= 0 then 0 else greatest(0, least(1, ((50 - x) * (x1 - x) + (50 - y) * (y1 - y)) / ((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)))) end as t from e where x1 is not null)
select user_id, event_id, round(sqrt(power(50 - (x + t * (x1 - x)), 2) + power(50 - (y + t * (y1 - y)), 2)), 4) as to_point,
       (((50 - y) * (x1 - x) > (y1 - y) * (0 - x)) <> ((50 - y) * (x1 - x) > (y1 - y) * (97 - x))) and (((y - 50) * 97 > 0) <> ((y1 - 50) * 97 > 0)) as crosses from t""")
def segment_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each path segment to a point, and whether it crosses a line."""
    s = _path(spark, d).where("x1 is not null")
    a, b = (_C("x"), _C("y")), (_C("x1"), _C("y1"))
    fixed = (F.lit(50.0), F.lit(50.0))
    # the line from (0, 50) to (97, 50)
    crosses = g.segments_cross(a, b, (F.lit(0.0), F.lit(50.0)), (F.lit(97.0), F.lit(50.0)))
    return s.select("user_id", "event_id", F.round(g.point_segment_distance(fixed, a, b), 4).alias("to_point"), crosses.alias("crosses"))


@query("""
with e as (select c_custkey, (c_custkey % 50)::double as x, c_acctbal / 100 as y, (c_custkey * 37 % 360)::double as deg, c_nationkey from customer),
     s as (select *, x + cos(radians(deg)) as xa, y + sin(radians(deg)) as ya, x - cos(radians(deg)) as xb, y - sin(radians(deg)) as yb from e),
     n as (select *, power(xa - c_nationkey, 2) + power(ya - 30, 2) as da, power(xb - c_nationkey, 2) + power(yb - 30, 2) as db from s)
select c_custkey, round(xa, 4) as ax, round(ya, 4) as ay, round(xb, 4) as bx, round(yb, 4) as by, case when (round(da, 6) <= round(db, 6)) <> (c_custkey % 10 = 0) then 'a' else 'b' end as public_side from n""")
def gate_sides(spark: SparkSession, d: str) -> DataFrame:
    """The two sides of a gate along its normal; the public one is nearer to a marked point, unless flipped."""
    x, y, deg = (_C("c_custkey") % 50).cast("double"), _C("c_acctbal") / 100, (_C("c_custkey") * 37 % 360).cast("double")
    a, b = g.offset_by_angle((x, y), deg, F.lit(1.0)), (x - F.cos(F.radians(deg)), y - F.sin(F.radians(deg)))
    mark = (_C("c_nationkey").cast("double"), F.lit(30.0))
    squared = lambda p: (p[0] - mark[0]) * (p[0] - mark[0]) + (p[1] - mark[1]) * (p[1] - mark[1])
    nearer = F.round(squared(a), 6) <= F.round(squared(b), 6)
    side = F.when(nearer != (_C("c_custkey") % 10 == 0), "a").otherwise("b")
    return read_table(spark, d, "customer").select("c_custkey", F.round(a[0], 4).alias("ax"), F.round(a[1], 4).alias("ay"), F.round(b[0], 4).alias("bx"), F.round(b[1], 4).alias("by"), side.alias("public_side"))


@query("""
with b as (select min(c_nationkey)::double as x0, max(c_nationkey)::double as x1, min(c_acctbal) as y0, max(c_acctbal) as y1 from customer),
     s as (select *, least((1600 - 80) / greatest(x1 - x0, 1e-9), (1000 - 80) / greatest(y1 - y0, 1e-9)) as s from b)
select c_custkey, round(40 + (c_nationkey - x0) * s, 4) as px, round(1000 - 40 - (c_acctbal - y0) * s, 4) as py, round(0.01 * 25 / greatest(x1 - x0, 1e-9), 6) as calibrated from customer, s""")
def scene_project(spark: SparkSession, d: str) -> DataFrame:
    """Scene to pixels: one scale that fits both axes, a margin, y upwards; and a calibrated scale."""
    c = _customers(spark, d)
    b = c.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))  # one row
    fit = lambda n, low, high: (n - 80) / F.greatest(_C(high) - _C(low), F.lit(1e-9))
    b = b.withColumn("s", F.least(fit(1600, "x0", "x1"), fit(1000, "y0", "y1")))
    calibrated = 0.01 * 25 / F.greatest(_C("x1") - _C("x0"), F.lit(1e-9))
    return c.join(F.broadcast(b)).select("c_custkey", F.round(40 + (_C("x") - _C("x0")) * _C("s"), 4).alias("px"), F.round(1000 - 40 - (_C("y") - _C("y0")) * _C("s"), 4).alias("py"), F.round(calibrated, 6).alias("calibrated"))


@query("""
with p as (select p_partkey, p_size::double as x, p_retailprice as y, 25.0 as ox, 1000.0 as oy from part), l as (select *, sqrt((ox - x) * (ox - x) + (oy - y) * (oy - y)) as len from p)
select p_partkey, round(degrees(atan2(oy - y, ox - x)), 4) as facing, round(x + case when len > 1e-9 then (oy - y) / len else 0 end * 0.5, 4) as x0, round(y - case when len > 1e-9 then (ox - x) / len else 1 end * 0.5, 4) as y0,
       round(x - case when len > 1e-9 then (oy - y) / len else 0 end * 0.5, 4) as x1, round(y + case when len > 1e-9 then (ox - x) / len else 1 end * 0.5, 4) as y1 from l""")
def facing_lines(spark: SparkSession, d: str) -> DataFrame:
    """Direction to a point, and the line across it."""
    p, o = (_C("p_size").cast("double"), _C("p_retailprice")), (F.lit(25.0), F.lit(1000.0))
    a, b = g.perpendicular_line(p, o, 1.0)
    return read_table(spark, d, "part").select("p_partkey", F.round(g.facing_degrees(p, o), 4).alias("facing"), *[F.round(c, 4).alias(n) for c, n in ((a[0], "x0"), (a[1], "y0"), (b[0], "x1"), (b[1], "y1"))])


@query("""
with p as (select p_partkey, p_size::double as len, 1.0 as w, 2.0 as pass from part where p_size >= 3), n as (select *, floor((len - pass) / 2 / w)::int as n from p)
select p_partkey, k::int as gate, round(case when k < n then w / 2 + k * w else len - w / 2 - (2 * n - 1 - k) * w end, 4) as centre, round(len / 2 - pass / 2, 4) as passage_from, round(len / 2 + pass / 2, 4) as passage_to
from n, lateral (select unnest(range(0, 2 * n)) as k)
union all select p_partkey, 0, round(len / 2, 4), round(len / 2 - pass / 2, 4), round(len / 2 + pass / 2, 4) from n where n = 0""")
def gate_positions(spark: SparkSession, d: str) -> DataFrame:
    """Gates placed from both ends of a path around a central passage; one in the middle where none fits."""
    length, w, gap = _C("p_size").cast("double"), 1.0, 2.0
    n = F.floor((length - gap) / 2 / w).cast("int")
    rows = read_table(spark, d, "part").where("p_size >= 3").select("p_partkey", length.alias("len"), n.alias("n"))
    rows = rows.withColumn("gate", F.explode(F.sequence(F.lit(0), F.greatest(2 * _C("n") - 1, F.lit(0)))))
    centre = F.when(_C("n") == 0, _C("len") / 2).when(_C("gate") < _C("n"), w / 2 + _C("gate") * w).otherwise(_C("len") - w / 2 - (2 * _C("n") - 1 - _C("gate")) * w)
    return rows.select("p_partkey", "gate", F.round(centre, 4).alias("centre"), F.round(_C("len") / 2 - gap / 2, 4).alias("passage_from"), F.round(_C("len") / 2 + gap / 2, 4).alias("passage_to"))


@query("""
with u as (select user_id, min(event_id % 1000)::int as x0, max(event_id % 1000)::int as x1, min(value) as y0, max(value) as y1 from events group by user_id),
     p as (select user_id, x0 - 120 as x0, x1 + 120 as x1, y0 - 120 as y0, y1 + 120 as y1 from u),
     q as (select user_id, case when x1 - x0 < 240 then (x0 + x1) / 2.0 - 120 else x0 end as x0, case when x1 - x0 < 240 then (x0 + x1) / 2.0 + 120 else x1 end as x1,
                  case when y1 - y0 < 240 then (y0 + y1) / 2.0 - 120 else y0 end as y0, case when y1 - y0 < 240 then (y0 + y1) / 2.0 + 120 else y1 end as y1 from p)
select user_id, trunc(greatest(0, x0))::int as left_px, trunc(greatest(0, y0))::int as top_px, trunc(least(1000, x1))::int as right_px, trunc(least(600, y1))::int as bottom_px from q""")
def crop_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Padded bounds of each user's points, of a least size, clamped to the image."""
    e = read_table(spark, d, "events").select("user_id", (_C("event_id") % 1000).cast("double").alias("x"), _C("value").alias("y"))
    b = e.groupBy("user_id").agg(*[(f(c) + s).alias(f"{c}{k}") for c in "xy" for k, f, s in ((0, F.min, -120), (1, F.max, 120))])
    wide = lambda c, k: F.when(_C(f"{c}1") - _C(f"{c}0") < 240, (_C(f"{c}0") + _C(f"{c}1")) / 2 + (120 if k else -120)).otherwise(_C(f"{c}{k}"))
    low = lambda c: F.greatest(F.lit(0.0), wide(c, 0)).cast("int")
    return b.select("user_id", low("x").alias("left_px"), low("y").alias("top_px"), F.least(F.lit(1000.0), wide("x", 1)).cast("int").alias("right_px"), F.least(F.lit(600.0), wide("y", 1)).cast("int").alias("bottom_px"))


@query("""
with p as (select c_custkey, c_nationkey * 40.0 as x, c_acctbal / 10 as y from customer), v as (select s_suppkey, s_nationkey * 40.0 as x, s_acctbal / 10 as y from supplier),
     e as (select s_suppkey as k, x as x0, y as y0, lead(x) over (order by s_suppkey) as x1, lead(y) over (order by s_suppkey) as y1 from v),
     dv as (select c_custkey, s_suppkey, round(sqrt(power(p.x - v.x, 2) + power(p.y - v.y, 2)), 9) as d from p join v on sqrt(power(p.x - v.x, 2) + power(p.y - v.y, 2)) <= 30),
     t as (select c_custkey, k, p.x, p.y, x0, y0, x1, y1, case when (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) <= 0 then 0 else greatest(0, least(1, ((p.x - x0) * (x1 - x0) + (p.y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) end as t from p, e where x1 is not null),
     de as (select c_custkey, k, round(sqrt(power(x - (x0 + t * (x1 - x0)), 2) + power(y - (y0 + t * (y1 - y0)), 2)), 9) as d from t where sqrt(power(x - (x0 + t * (x1 - x0)), 2) + power(y - (y0 + t * (y1 - y0)), 2)) <= 22),
     bv as (select c_custkey, arg_min(s_suppkey, (d, s_suppkey)) as id, min(d) as d from dv group by 1), be as (select c_custkey, arg_min(k, (d, k)) as id, min(d) as d from de group by 1)
select p.c_custkey, case when bv.id is not null then 'vertex' when be.id is not null then 'edge' else 'free' end as source, coalesce(bv.id, be.id) as target, round(coalesce(bv.d, be.d), 4) as distance
from p left join bv using (c_custkey) left join be using (c_custkey)""")
def snap_cascade(spark: SparkSession, d: str) -> DataFrame:
    points = read_table(spark, d, "customer").select("c_custkey", (_C("c_nationkey") * 40.0).alias("x"), (_C("c_acctbal") / 10).alias("y"))
    v = read_table(spark, d, "supplier").select("s_suppkey", (_C("s_nationkey") * 40.0).alias("vx"), (_C("s_acctbal") / 10).alias("vy"))
    w = Window.orderBy("s_suppkey")  # one polyline
    e = v.select(_C("s_suppkey").alias("edge"), _C("vx").alias("x0"), _C("vy").alias("y0"), F.lead("vx").over(w).alias("x1"), F.lead("vy").over(w).alias("y1")).where("x1 is not null")
    out = sp.snap(points, v, e, "c_custkey", (_C("x"), _C("y")), "s_suppkey", (_C("vx"), _C("vy")), "edge", (_C("x0"), _C("y0")), (_C("x1"), _C("y1")), 30.0, 22.0)
    return out.withColumn("distance", F.round("distance", 4))


@query("""
with l as (select l_orderkey, l_linenumber, l_quantity as x0, l_extendedprice / 1000 as y0, l_quantity + 3 as x1, l_extendedprice / 1000 + 4 * (l_linenumber % 2) as y1 from lineitem), m as (select *, (x0 + x1) / 2 as mx, (y0 + y1) / 2 as my, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as len from l)
select l_orderkey, l_linenumber, round(mx, 6) as mx, round(my, 6) as my, round(mx - (y1 - y0) / len * 2.37, 6) as ex, round(my + (x1 - x0) / len * 2.37, 6) as ey,
       round(x0 - (y1 - y0) / len * 2.37, 6) as px0, round(y0 + (x1 - x0) / len * 2.37, 6) as py0, 'zone_' || l_orderkey || '_' || l_linenumber as zone_label from m""")
def exit_lines(spark: SparkSession, d: str) -> DataFrame:
    """Midpoint of a line, the exit point off it along its normal, and the parallel line's start."""
    x0, y0 = _C("l_quantity"), _C("l_extendedprice") / 1000
    x1, y1 = x0 + 3, y0 + 4 * (_C("l_linenumber") % 2)
    length = g.distance((x0, y0), (x1, y1))
    nx, ny = -(y1 - y0) / length * 2.37, (x1 - x0) / length * 2.37
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    label = F.concat_ws("_", F.lit("zone"), _C("l_orderkey").cast("string"), _C("l_linenumber").cast("string"))
    named = ((mx, "mx"), (my, "my"), (mx + nx, "ex"), (my + ny, "ey"), (x0 + nx, "px0"), (y0 + ny, "py0"))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for c, n in named], label.alias("zone_label"))
