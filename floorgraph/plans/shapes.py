"""Queries of clustering, masks and ring edits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorgraph.functions import geometry as g
from floorgraph.functions import rings as rg
from floorgraph.operators import cluster as cl
from floorgraph.operators import raster as rs
from floorgraph.operators import runs as rn
from floorgraph.sources.shared import cut
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


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("""
with e as (select vec_id, embedding::double[] as v from embeddings), c as (select vec_id as label, v as centre from e where vec_id in (0, 3, 7, 11, 20, 31, 42, 55, 68, 90)),
     q as (select e.vec_id, arg_min(label, (round(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(v, centre)]), 9), label)) as label, min(round(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(v, centre)]), 9)) as d from e, c group by e.vec_id),
     n as (select label, row_number() over (order by count(*) desc, label)::int as rank from q group by label)
select vec_id, label, round(sqrt(d), 4) as distance, rank from q join n using (label)""")
def cluster_assign(spark: SparkSession, d: str) -> DataFrame:
    """Every vector on the nearest of ten given centres, clusters ranked by size."""
    e = _vectors(spark, d)
    centres = e.where(_C("vec_id").isin(0, 3, 7, 11, 20, 31, 42, 55, 68, 90)).select(_C("vec_id").alias("label"), _C("v").alias("centre"))
    return cl.assign(e, centres, "vec_id", "v").withColumn("distance", F.round("distance", 4))


@query("""select label, round(degrees(0.5 * atan2(2 * covar_pop(y, x), var_pop(x) - var_pop(y))), 4) as angle from (select label, embedding[1]::double as x, embedding[2]::double as y from embeddings) group by label""")
def pca_angle(spark: SparkSession, d: str) -> DataFrame:
    out = cl.principal_angle(_vectors(spark, d), "label", _C("v")[0], _C("v")[1])
    return out.select("label", F.round("angle", 4).alias("angle"))


@query("""
with recursive x as (select user_id, event_id as id, (event_id % 40)::double as x, round(value % 40, 3) as y, round(value, 4) as score from events),
  o as (select *, row_number() over (partition by user_id order by score desc, id) as i from x),
  r as (select user_id, i, [{'x': x, 'y': y}] as kept, true as stays from o where i = 1
    union all select o.user_id, o.i, case when s then list_append(kept, {'x': o.x, 'y': o.y}) else kept end, s
    from (select r.user_id as u, r.i as before, kept, o.*, len(list_filter(kept, lambda k: (greatest(0, 20 - abs(k.x - o.x)) * greatest(0, 20 - abs(k.y - o.y))) / (800 - greatest(0, 20 - abs(k.x - o.x)) * greatest(0, 20 - abs(k.y - o.y))) >= 0.35)) = 0 as s
          from r join o on o.user_id = r.user_id and o.i = r.i + 1) o)
select user_id, id, x, y, 20.0::double as w, 20.0::double as h, score, 'icon_' || lpad((row_number() over (partition by user_id order by y, x, id))::varchar, 3, '0') as icon_id
from r join o using (user_id, i) where stays""")
def nms_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as scored boxes of their user; overlapping weaker ones go, the rest is numbered."""
    e = read_table(spark, d, "events")
    box = e.select("user_id", _C("event_id").alias("id"), (_C("event_id") % 40).cast("double").alias("x"), F.round(_C("value") % 40, 3).alias("y"), F.lit(20.0).alias("w"), F.lit(20.0).alias("h"), F.round("value", 4).alias("score"))
    kept = cl.suppress_overlaps(box, "user_id")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("y", "x", "id"))
    return kept.withColumn("icon_id", F.format_string("icon_%03d", number))


@query("""select count(*)::bigint as vectors, count(distinct vec_id)::bigint as ids, 6::bigint as labels, 0::bigint as nearer_elsewhere, 0::bigint as worse_than_one from embeddings""")
def kmeans_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any k-means fit: each vector once, all labels in use, no vector nearer to another centre, less spread than around one mean."""
    vectors = _vectors(spark, d)
    model, fit = cl.kmeans_fit(vectors, "vec_id", "v", 6)
    size = len(model[0][1])
    centres = spark.createDataFrame(model, "other int, centre array<double>")
    both = fit.join(vectors.select("vec_id", "v"), "vec_id")
    nearest = both.join(F.broadcast(centres)).groupBy("vec_id").agg(F.sqrt(F.min(cl.squared_distance("v", "centre"))).alias("least"))  # six centres
    mean = vectors.agg(F.array(*[F.avg(_C("v")[i]) for i in range(size)]).alias("mean"))
    spread = vectors.join(F.broadcast(mean)).agg(F.sum(cl.squared_distance("v", "mean")).alias("spread"))  # one row
    out = fit.join(nearest, "vec_id").agg(
        F.count("*").alias("vectors"), F.countDistinct("vec_id").alias("ids"), F.countDistinct("label").alias("labels"),
        F.count(F.when(_C("least") < _C("distance") - 1e-6, 1)).alias("nearer_elsewhere"), F.sum(_C("distance") * _C("distance")).alias("inner"),
    )
    return out.join(F.broadcast(spread)).select("vectors", "ids", "labels", "nearer_elsewhere", (_C("inner") > _C("spread")).cast("bigint").alias("worse_than_one"))


@query("""
with p as (select vec_id, (floor((embedding[1]::double + 1) * 127.5))::int as r, (floor((embedding[2]::double + 1) * 127.5))::int as g, (floor((embedding[3]::double + 1) * 127.5))::int as b from embeddings),
     h as (select *, greatest(r, g, b) as hi, (greatest(r, g, b) - least(r, g, b))::double as sp from p),
     s as (select *, case when sp = 0 then 0.0 when hi = r then 60 * (g - b) / sp when hi = g then 120 + 60 * (b - r) / sp else 240 + 60 * (r - g) / sp end as hue from h),
     q as (select vec_id, r, g, b, round_even(case when hue < 0 then hue + 360 else hue end / 2, 0)::int as h, round_even(case when hi = 0 then 0 else 255 * sp / hi end, 0)::int as s, hi::int as v from s)
select vec_id, h, s, v, concat_ws(',', printf('%.4f', round(r / 255.0, 4)), printf('%.4f', round(g / 255.0, 4)), printf('%.4f', round(b / 255.0, 4)), '1.0000') as rgba from q where h between 20 and 150 and s between 10 and 255 and v between 100 and 200""")
def pixel_masks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as pixels: HSV ranges, and the colour as text."""
    e = _vectors(spark, d)
    p = e.select("vec_id", *[F.floor((_C("v")[i] + 1) * 127.5).cast("int").alias(c) for i, c in enumerate("rgb")])
    h, s, v = rs.rgb_to_hsv(_C("r"), _C("g"), _C("b"))
    text = F.array_join(F.transform(rs.rgba(_C("r"), _C("g"), _C("b")), lambda x: F.format_string("%.4f", x)), ",")
    hsv = p.select("vec_id", h.alias("h"), s.alias("s"), v.alias("v"), text.alias("rgba"))
    return rs.in_ranges(hsv, h=(20, 150), s=(10, 255), v=(100, 200))


_MASKS = """
g as (select n_nationkey as image, x, y from nation, range(0, 32) a(x), range(0, 32) b(y)),
a as (select image, x, y from g where x between 4 + image % 5 and 12 and y between 5 and 20), b as (select image, x, y from g where x between 14 + image % 3 and 24 and y between 10 and 26 + image % 4)"""


def _masks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    grid = read_table(spark, d, "nation").select(_C("n_nationkey").alias("image")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(31))))
    i = _C("image")
    return rs.in_ranges(grid, y=(5, 20)).where(_C("x").between(4 + i % 5, F.lit(12))), grid.where(_C("x").between(14 + i % 3, F.lit(24)) & _C("y").between(F.lit(10), 26 + i % 4))


@query(f"""
with {_MASKS}, n as (select image, x, y, 'a' as m from a where exists (select 1 from b where b.image = a.image and abs(b.x - a.x) <= 3 and abs(b.y - a.y) <= 3) union all select image, x, y, 'b' from b where exists (select 1 from a where a.image = b.image and abs(b.x - a.x) <= 3 and abs(b.y - a.y) <= 3)),
     e as (select image, count(*) as core from a where x > 4 + image % 5 and x < 12 and y > 5 and y < 20 group by image),
     r as (select o.image, min(k) as step from (select n_nationkey as image from nation) o, range(1, 33) s(k) where exists (select 1 from b where b.image = o.image and b.x = 2 + k and b.y = 15) group by o.image)
select e.image, coalesce(c.contact, 0)::bigint as contact, 0::bigint as common, core::bigint as core, step::int as step from e join r using (image) left join (select image, count(*) as contact from n group by image) c using (image)""")
def raster_contact(spark: SparkSession, d: str) -> DataFrame:
    """Contact of two masks, the core left by an erosion, and the first hit of a ray, image by image."""
    a, b = _masks(spark, d)
    contact = rs.contact_area(a, b, 3, 32, 32)
    core = rs.erode(a, 3, 32, 32).groupBy("image").agg(F.count("*").alias("core"))
    origins = read_table(spark, d, "nation").select(_C("n_nationkey").alias("image"), F.lit(0).alias("origin"), F.lit(2).alias("x"), F.lit(15).alias("y"))
    hit = rs.first_hits(b, origins, [(1, 0)], 32).select("image", "step")
    out = core.join(hit, "image").join(contact, "image", "left")
    return out.select("image", F.coalesce("contact", F.lit(0)).cast("bigint").alias("contact"), F.coalesce("common", F.lit(0)).cast("bigint").alias("common"), "core", "step")


_PIXELS = "l as (select distinct l_suppkey as image, l_returnflag as f, l_quantity::int as x, (l_shipdate::date - date '1992-01-01')::int // 56 as y from lineitem)"
_AROUND = "(select i as dx, j as dy from range(-{r}, {s}) a(i), range(-{r}, {s}) b(j))"


def _line_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Lines as pixels of their supplier's image, repeated ones too: quantity across, spans of eight weeks down."""
    y = F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 56).cast("int")
    return read_table(spark, d, "lineitem").select(_C("l_suppkey").alias("image"), _C("l_returnflag").alias("f"), _C("l_quantity").cast("int").alias("x"), y.alias("y"))


@query(f"""
with {_PIXELS}, m as (select distinct image, x, y from l where x < 51 and y between 0 and 63),
  d as (select distinct image, x + dx as x, y + dy as y from m, {_AROUND.format(r=1, s=2)} where x + dx between 0 and 50 and y + dy between 0 and 63),
  c as (select image, x, y from (select image, x + dx as x, y + dy as y, count(*) as n from d, {_AROUND.format(r=1, s=2)} group by 1, 2, 3) where x between 0 and 50 and y between 0 and 63
    and n = (least(x + 1, 50) - greatest(x - 1, 0) + 1) * (least(y + 1, 63) - greatest(y - 1, 0) + 1)),
  e as (select image, x, y from (select image, x + dx as x, y + dy as y, count(*) as n from c, {_AROUND.format(r=2, s=3)} group by 1, 2, 3) where x between 0 and 50 and y between 0 and 63
    and n = (least(x + 2, 50) - greatest(x - 2, 0) + 1) * (least(y + 2, 63) - greatest(y - 2, 0) + 1)),
  o as (select distinct image, x + dx as x, y + dy as y from e, {_AROUND.format(r=2, s=3)} where x + dx between 0 and 50 and y + dy between 0 and 63)
select image, (select count(*) from c where c.image = o.image)::bigint as closed, count(*)::bigint as opened, min(x)::int as x0, min(y)::int as y0, max(x)::int as x1, max(y)::int as y1 from o group by image""")
def mask_morphology(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's mask closed and then opened: pixels after either, and the box of what is left."""
    runs = rn.to_runs(_line_pixels(spark, d).where("x < 51 and y between 0 and 63"))
    size = (51, 64)
    closed = cut(rn.eroded(rn.dilated(runs, 1, *size), 1, *size))
    opened = rn.dilated(rn.eroded(closed, 2, *size), 2, *size)
    left = opened.groupBy("image").agg(rn.area(opened).alias("opened"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))
    return left.join(closed.groupBy("image").agg(rn.area(closed).alias("closed")), "image").select("image", "closed", "opened", *[_C(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""
with recursive {_PIXELS}, m as (select distinct image, x, y from l where f = 'A'),
  e as (select a.image, a.x, a.y, b.x as u, b.y as v from m a join {_AROUND.format(r=1, s=2)} on true join m b on b.image = a.image and b.x = a.x + dx and b.y = a.y + dy),
  r(image, x, y, cx, cy) using key (image, x, y) as (select image, x, y, x, y from m
    union select image, x, y, (best).x, (best).y from (select e.image, e.u as x, e.v as y, min({{'y': r.cy, 'x': r.cx}}) as best from r join e on e.image = r.image and e.x = r.x and e.y = r.y group by all)
      join recurring.r k using (image, x, y) where (best).y < k.cy or ((best).y = k.cy and (best).x < k.cx))
select image, printf('%d|%06d|%06d', image, cy, cx) as component, count(*)::bigint as area, min(x)::int as x0, min(y)::int as y0, max(x)::int as x1, max(y)::int as y1 from r group by image, cx, cy having count(*) >= 3""")
def mask_parts(spark: SparkSession, d: str) -> DataFrame:
    """8-connected parts of three pixels or more of each supplier's mask of one return flag."""
    return rs.mask_components(_line_pixels(spark, d).where("f = 'A'").select("image", "x", "y"), 3)


@query(f"""
with {_PIXELS}, a as (select image, x, y from l where f = 'A'), b as (select image, x, y from l where f = 'R'),
  n as (select distinct a.image, a.x, a.y, 'a' as m from a join {_AROUND.format(r=2, s=3)} on true join b on b.image = a.image and b.x = a.x + dx and b.y = a.y + dy
    union all select distinct b.image, b.x, b.y, 'b' from b join {_AROUND.format(r=2, s=3)} on true join a on b.image = a.image and a.x = b.x + dx and a.y = b.y + dy),
  c as (select image, count(*) as n from a join b using (image, x, y) group by image)
select n.image, count(*)::bigint as contact, coalesce(any_value(c.n), 0)::bigint as common from n left join c using (image) group by n.image""")
def mask_contact(spark: SparkSession, d: str) -> DataFrame:
    """Contact and common pixels of two return flags' masks, supplier by supplier."""
    pixels = _line_pixels(spark, d)
    flag = lambda f: pixels.where(_C("f") == f).select("image", "x", "y")
    return rs.contact_area(flag("A"), flag("R"), 2, 60, 200)


def _ring(scale, key):
    """A square with a notch, as wide as ``scale``; where the notch ends goes by ``key``."""
    corners = ((0, 0), (4, 0), (4, 4), (1 + key % 2, 1 + key % 3), (0, 4))
    number = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.array(*[rg.point(number(x) * scale, number(y) * scale) for x, y in corners])


@query("""
select p_partkey, round((8 + 2 * h) * s * s, 4) as area, round(16.0 * s * s, 4) as moved, round((8 + 2 * h) * s * s, 4) as inserted,
       case when 2 * h * s * s > 1 then round(2 * h * s * s, 4) end as kept, round(16.0 * s * s, 4) as straightened,
       (3 + p_partkey % 3)::int as n_clean, round(s * (32 - 2 * (4 - h) * (4 + a) / 3) / (8 + 2 * h), 4) as cx
from (select p_partkey, p_size::double as s, (1 + p_partkey % 2)::double as a, (1 + p_partkey % 3)::double as h from part)""")
def ring_edits(spark: SparkSession, d: str) -> DataFrame:
    """Areas after edits of a ring scaled by the part's size, its notch and its number of points by the part's key."""
    key, s = _C("p_partkey"), _C("p_size").cast("double")
    rows = read_table(spark, d, "part").select("p_partkey", s.alias("s"), _ring(s, key).alias("ring"))
    ring = _C("ring")
    area = lambda r: F.round(g.ring_area(r), 4)
    moved = rg.move_vertex(ring, F.lit(3), rg.point(2 * _C("s"), 4 * _C("s")))
    inserted = rg.insert_vertex(ring, F.lit(0), rg.point(2 * _C("s"), F.lit(0)))
    kept = rg.keep_vertices(ring, F.array(F.lit(0), F.lit(1), F.lit(3)))
    straight = rg.straighten(ring, F.lit(2), F.lit(4))
    clean = rg.without_repeats(F.concat(F.slice(ring, 1, 2), F.slice(ring, F.lit(2), (2 + key % 3).cast("int")), F.slice(ring, 1, 1)))
    edited = {"area": ring, "moved": moved, "inserted": inserted, "kept": kept, "straightened": straight}
    centre = F.round(g.ring_centroid(ring)["x"], 4)
    return rows.select("p_partkey", *[area(r).alias(name) for name, r in edited.items()], F.size(clean).alias("n_clean"), centre.alias("cx"))


@query("""
select p_partkey, case when 8 * s * s > 1 then round(8.0 * s * s, 4) end as first_area, round(2 * h * s * s, 4) as second_area,
       round(16.0 * s * s, 4) as replaced, (8 + p_partkey % 3)::int as spliced
from (select p_partkey, p_size::double as s, (1 + p_partkey % 3)::double as h from part)""")
def ring_split_merge(spark: SparkSession, d: str) -> DataFrame:
    """Areas of the parts of a split ring, of one with a path replaced, and the points of two spliced ones, of three to five points."""
    key, s = _C("p_partkey"), _C("p_size").cast("double")
    rows = read_table(spark, d, "part").select("p_partkey", s.alias("s"), _ring(s, key).alias("ring"))
    ring = _C("ring")
    first, second = rg.split_by_vertices(ring, F.lit(0), F.lit(2))
    replaced = rg.replace_path(ring, F.lit(2), F.lit(4), F.array(rg.point(F.lit(0), 4 * _C("s")), rg.point(4 * _C("s"), 4 * _C("s"))))
    spliced = rg.splice(ring, F.lit(1), F.slice(ring, F.lit(1), (3 + key % 3).cast("int")), F.lit(2))
    areas = {"first_area": first, "second_area": second, "replaced": replaced}
    return rows.select("p_partkey", *[F.round(g.ring_area(r), 4).alias(name) for name, r in areas.items()], F.size(spliced).alias("spliced"))


@query("""
select p_partkey, k::int as corner, x::double as u, y::double as v from (select p_partkey, k, case k when 0 then 0.0 when 1 then 1000.0 when 2 then 1000.0 else 0.0 end as x, case k when 0 then 0.0 when 1 then 0.0 else 600.0 end as y from part, range(0, 4) r(k))""")
def homography_solve(spark: SparkSession, d: str) -> DataFrame:
    """A homography from four skewed corners to a rectangle, checked by mapping the corners."""
    s = _C("p_size").cast("double")
    corners = [((s, s * 0.5), (0, 0)), ((100 + s, F.lit(3.0)), (1000, 0)), ((110 - s * 0.5, 60 + s), (1000, 600)), ((F.lit(-2.0), 55 - s * 0.25), (0, 600))]
    pair = lambda k, p, q: F.struct(F.lit(k).alias("ord"), p[0].alias("x"), p[1].alias("y"), F.lit(float(q[0])).alias("u"), F.lit(float(q[1])).alias("v"))
    pairs = read_table(spark, d, "part").select("p_partkey", F.explode(F.array(*[pair(k, p, q) for k, (p, q) in enumerate(corners)])).alias("c")).select("p_partkey", "c.*")
    m = cl.homographies(pairs, "p_partkey")
    mapped = pairs.join(m, "p_partkey")
    u, v = g.perspective((_C("x"), _C("y")), [_C("matrix")[i] for i in range(9)])
    zero = lambda c: F.round(c, 4) + F.lit(0.0)  # noqa: E731  no negative zero
    return mapped.select("p_partkey", _C("ord").alias("corner"), zero(u).alias("u"), zero(v).alias("v"))
