"""Queries of guards, parsing, ordered folds, fills, merges and scene records, and of what Spark has built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorgraph.functions import geometry as g
from floorgraph.functions import rings as rg
from floorgraph.functions import text as tx
from floorgraph.operators import aggregates as ag
from floorgraph.operators import images as im
from floorgraph.operators import scene as sc
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


@query("""
with p as (select s_suppkey as k, case s_suppkey % 6 when 0 then '/out/a/' || s_suppkey when 1 then '/out/../etc/' || s_suppkey when 2 then '/output/' || s_suppkey when 3 then '/data//x/./y/../' || s_suppkey
                  when 4 then 'out/' || s_suppkey else '/out' end as path from supplier)
select k, path, case k % 6 when 0 then path when 1 then '/etc/' || k when 2 then path when 3 then '/data/x/' || k when 4 then '/' || path else path end as resolved, k % 6 in (0, 3, 5) as allowed from p""")
def path_guard(spark: SparkSession, d: str) -> DataFrame:
    """Paths that may be served: resolved, at or below one of two roots."""
    k = _C("s_suppkey").cast("string")
    cases = ["/out/a/", "/out/../etc/", "/output/", "/data//x/./y/../", "out/"]
    path = F.lit("/out")
    for n, start in enumerate(cases):
        path = F.when(_C("s_suppkey") % 6 == n, F.concat(F.lit(start), k)).otherwise(path)
    rows = read_table(spark, d, "supplier").select(_C("s_suppkey").alias("k"), path.alias("path"))
    return rows.select("k", "path", tx.resolved_path(_C("path")).alias("resolved"), tx.within_roots(_C("path"), ("/out", "/data/x")).alias("allowed"))


@query("""select c_custkey, case when c_nationkey % 4 = 0 or c_custkey % 3 = 0 or 'v' || c_nationkey = 'v' || (c_custkey % 25) then 200 else 409 end as status from customer""")
def stale_saves(spark: SparkSession, d: str) -> DataFrame:
    """Saves against the active version: stale ones conflict, those that name no version pass."""
    c = read_table(spark, d, "customer")
    seen = F.when(_C("c_nationkey") % 4 == 0, F.lit(None).cast("string")).when(_C("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), _C("c_nationkey").cast("string")))
    return c.select("c_custkey", tx.save_status(seen, F.concat(F.lit("v"), (_C("c_custkey") % 25).cast("string"))).alias("status"))


@query("""
with n as (select n_nationkey as k from nation)
select k, case k % 4 when 0 then 'none,elevator' when 1 then 'none' when 2 then 'elevator,none' else 'elevator' end as preferences, k::varchar as z, 'a=b' as rest, 2::int as n_pairs,
       case when k > 1 then k / 100.0 else k end::double as share, case when k % 2 = 0 then 'bad ' || k || ' / why' else '' end as error, 'st' || k || 'X' as with_end, 'st' || k as without_end from n""")
def parsed_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Preference lists, key-value lists, percent thresholds, error texts of XML, and names with and without their suffix."""
    k, text = _C("n_nationkey"), _C("n_nationkey").cast("string")
    asked = F.when(k % 4 == 0, "all").when(k % 4 == 1, "bus, ,train").when(k % 4 == 2, "Elevator, none,elevator").otherwise(" ELEVATOR ")
    pairs = tx.key_values(F.concat(F.lit(" z = "), text, F.lit(", rest=a=b, =lost, alone,")))
    xml = F.concat(F.lit("<r><code>"), F.when(k % 2 == 0, F.concat(F.lit("bad "), text)).otherwise(F.lit("")), F.lit("</code><msg>"), F.when(k % 2 == 0, "why").otherwise(""), F.lit("</msg></r>"))
    name = F.concat(F.lit("st"), text, F.when(k % 3 == 0, "X").otherwise(""))
    return read_table(spark, d, "nation").select(
        k.alias("k"), F.array_join(tx.preferences(asked), ",").alias("preferences"), pairs["z"].alias("z"), pairs["rest"].alias("rest"), F.size(pairs).alias("n_pairs"),
        tx.share(k.cast("double")).alias("share"), tx.xml_error(xml, ("code", "msg", "none")).alias("error"), tx.with_suffix(name, "X").alias("with_end"), tx.without_suffix(name, "X").alias("without_end"),
    )


@query("""
with recursive s as (select l_orderkey, l_linenumber, l_discount as v, row_number() over (partition by l_orderkey order by l_discount, l_linenumber) as i from lineitem),
  r as (select l_orderkey, i, v as last, 1 as n, v as total from s where i = 1 union all
        select r.l_orderkey, s.i, case when s.v - last >= 0.0299 then s.v else last end, n + (s.v - last >= 0.0299)::int, total + case when s.v - last >= 0.0299 then s.v else 0 end from r join s on s.l_orderkey = r.l_orderkey and s.i = r.i + 1)
select l_orderkey, arg_max(n, i)::int as n_kept, round(arg_max(total, i), 4) as total from r group by l_orderkey""")
def thinned_values(spark: SparkSession, d: str) -> DataFrame:
    """Discounts of each order without those near one kept before."""
    kept = rg.thinned(F.collect_list(_C("l_discount").cast("double")), 0.0299)
    out = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(kept.alias("_kept"))
    return out.select("l_orderkey", F.size("_kept").alias("n_kept"), F.round(F.aggregate("_kept", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("""
with recursive c as (select n_nationkey as image, k as ord, (k * 2 + n_nationkey) % 5 as reference, (k * 3 + 1) % 5 as moving, k * 1.5 as rx, (n_nationkey % 7) * 0.5 as ry, n_nationkey * 0.25 as mx, k * 0.75 as my, (k + n_nationkey) % 5 as p from nation, range(1, 9) r(k)),
  s as (select n_nationkey as image, 0::bigint as ord, [0.0, 0.0, 0.0, 0.0, 0.0]::double[] as dx, [0.0, 0.0, 0.0, 0.0, 0.0]::double[] as dy from nation union all
        select s.image, c.ord, list_transform(dx, lambda v, i: case when i - 1 in (c.p, (c.p + 1) % 5) then v + (c.rx + dx[c.reference + 1]) - (c.mx + dx[c.moving + 1]) else v end),
               list_transform(dy, lambda v, i: case when i - 1 in (c.p, (c.p + 1) % 5) then v + (c.ry + dy[c.reference + 1]) - (c.my + dy[c.moving + 1]) else v end)
        from s join c on c.image = s.image and c.ord = s.ord + 1)
select image, k::bigint as polygon_id, round(dx[k + 1], 6) as dx, round(dy[k + 1], 6) as dy from s, range(0, 5) r(k) where ord = 8""")
def local_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Shifts of five polygons after eight corrections in order, each with the shifts so far."""
    n, k = _C("n_nationkey"), _C("ord")
    rows = read_table(spark, d, "nation").select(n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint"))).alias("ord"))
    first = F.pmod(k + n, F.lit(5)).cast("bigint")
    rows = rows.select(
        n.alias("image"), "ord", F.pmod(k * 2 + n, F.lit(5)).cast("bigint").alias("reference"), F.pmod(k * 3 + 1, F.lit(5)).cast("bigint").alias("moving"),
        (k * 1.5).alias("rx"), ((n % 7) * 0.5).alias("ry"), (n * 0.25).alias("mx"), (k * 0.75).alias("my"), F.array(first, (first + 1) % 5).alias("polygons"),
    )
    out = ag.local_shifts(rows, "image")
    return out.withColumn("dx", F.round("dx", 6) + F.lit(0.0)).withColumn("dy", F.round("dy", 6) + F.lit(0.0))


@query("""
select n_nationkey as image, x::int as x, y::int as y, (case when n_nationkey % 2 = 0 then 40 + 150 * ((y // 3) % 2) + n_nationkey else 40 + 150 * ((x // 3) % 2) + n_nationkey end)::double as value
from nation, range(0, 20) a(x), range(0, 20) b(y)""")
def fill_directions(spark: SparkSession, d: str) -> DataFrame:
    """Striped images with a hole, filled along the direction of the stripes: the stripes are whole again."""
    n = _C("n_nationkey")
    span = F.sequence(F.lit(0), F.lit(19))
    grid = read_table(spark, d, "nation").select(n.alias("image")).withColumn("x", F.explode(span)).withColumn("y", F.explode(span))
    stripe = F.when(_C("image") % 2 == 0, F.floor(_C("y") / 3) % 2).otherwise(F.floor(_C("x") / 3) % 2)
    hole = _C("x").between(7, 11) & _C("y").between(6, 12)
    pixels = grid.select("image", "x", "y", F.when(hole, 0.0).otherwise(40.0 + 150 * stripe + _C("image")).alias("value"), hole.alias("hole"))
    return im.fill_along(pixels)


@query("""
select p_partkey, (3 * s + 2 * gap) * s as area, 12::int as n_points, round((3 * s + 2 * gap) / 2, 4) as cx from (select p_partkey, p_size::double as s, (p_size * 0.25)::double as gap from part where p_size > 1)""")
def auto_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three squares in a row, given out of order, spliced into one outline by their facing sides."""
    s = _C("p_size").cast("double")
    step = s * 1.25
    square = lambda k: F.array(*[rg.point(step * k + s * x, s * y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    rings = F.array(*[F.struct(F.lit(at).alias("ord"), square(k).alias("ring")) for at, k in enumerate((0, 2, 1))])
    rows = read_table(spark, d, "part").where("p_size > 1").select("p_partkey", F.explode(rings).alias("r")).select("p_partkey", "r.*")
    out = sc.auto_merge(rows, "p_partkey")
    return out.select("p_partkey", F.round(g.ring_area(_C("ring")), 9).alias("area"), F.size("ring").alias("n_points"), F.round(g.ring_centroid(_C("ring"))["x"], 4).alias("cx"))


@query("""
with w as (select l_orderkey, l_linenumber, l_quantity as x0, l_discount * 100 as y0, lead(l_quantity) over o as x1, lead(l_discount * 100) over o as y1, row_number() over o as i from lineitem window o as (partition by l_orderkey order by l_linenumber, l_extendedprice)),
     s as (select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as length from w where x1 is not null)
select l_orderkey as wall_id, row_number() over (partition by l_orderkey order by i)::int as segment, round(length, 4) as length, round(degrees(atan2(y1 - y0, x1 - x0)), 4) as angle_deg from s where length > 1e-9""")
def wall_records(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the path through each order's lines."""
    walls = read_table(spark, d, "lineitem").select(_C("l_orderkey").alias("wall_id"), F.struct("l_linenumber", "l_extendedprice").alias("ord"), _C("l_quantity").alias("x"), (_C("l_discount") * 100).alias("y"))
    out = sc.wall_segments(walls)
    return out.select("wall_id", "segment", F.round("length", 4).alias("length"), F.round("angle_deg", 4).alias("angle_deg"))


@query("""
with c as (select s_suppkey, s_nationkey::double as x0, 0.0 as y0, (s_suppkey % 3)::double as z0, s_nationkey + 4.0 as x1, 3.0 as y1, (s_suppkey % 5)::double as z1 from supplier)
select s_suppkey as connection_id, round(x0 + 0.3, 4) as lower_x, round(x0 + 2, 4) as cx, round(abs(z1 - z0), 4) as rise, round(degrees(atan2(3.0, 4.0)), 4) as turn from c where not z0 > z1
union all select s_suppkey, round(x1 - 0.3, 4), round(x0 + 2, 4), round(abs(z1 - z0), 4), round(degrees(atan2(-3.0, -4.0)), 4) from c where z0 > z1""")
def connection_records(spark: SparkSession, d: str) -> DataFrame:
    """Ends of connections as lines across the way, the lower one first."""
    k, x = _C("s_suppkey"), _C("s_nationkey").cast("double")
    rows = read_table(spark, d, "supplier").select(
        k.alias("connection_id"), F.lit("stair").alias("type"), x.alias("x0"), F.lit(0.0).alias("y0"), (k % 3).cast("double").alias("z0"), (x + 4).alias("x1"), F.lit(3.0).alias("y1"), (k % 5).cast("double").alias("z1")
    )
    out = sc.connection_assets(rows, 1.0)
    return out.select("connection_id", F.round(_C("lower")[0][0], 4).alias("lower_x"), F.round(_C("center")[0], 4).alias("cx"), F.round("rise", 4).alias("rise"), F.round("rotation_deg", 4).alias("turn"))


@query("""
select c_custkey, rank() over w as r, dense_rank() over w as dr, ntile(4) over (partition by c_nationkey order by c_acctbal, c_custkey) as quarter,
       round(avg(c_acctbal) over (partition by c_nationkey order by c_acctbal, c_custkey rows between 2 preceding and 1 following), 4) as around from customer window w as (partition by c_nationkey order by c_mktsegment)""")
def ranked_frames(spark: SparkSession, d: str) -> DataFrame:
    """Ranks, quarters and a moving mean over an explicit frame."""
    by = Window.partitionBy("c_nationkey")
    w, v = by.orderBy("c_mktsegment"), by.orderBy("c_acctbal", "c_custkey")
    c = read_table(spark, d, "customer")
    wide = lambda f: f.over(w).cast("bigint")
    return c.select("c_custkey", wide(F.rank()).alias("r"), wide(F.dense_rank()).alias("dr"), F.ntile(4).over(v).cast("bigint").alias("quarter"), F.round(F.avg("c_acctbal").over(v.rowsBetween(-2, 1)), 4).alias("around"))


@query("""
select 'both' as kind, k from (select c_nationkey as k from customer intersect select s_nationkey from supplier)
union all select 'customers_only', k from (select c_nationkey as k from customer except select s_nationkey from supplier)
union all select 'suppliers_only', k from (select s_nationkey as k from supplier except select c_nationkey from customer)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Nations with customers and suppliers, and with either only."""
    c, s = read_table(spark, d, "customer").select(_C("c_nationkey").alias("k")), read_table(spark, d, "supplier").select(_C("s_nationkey").alias("k"))
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "k")
    return named("both", c.intersect(s)).unionByName(named("customers_only", c.subtract(s))).unionByName(named("suppliers_only", s.subtract(c)))


@query("""
select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, count(*)::bigint as n, round(sum(l_quantity), 2) as quantity, grouping(l_returnflag, l_linestatus)::bigint as level
from lineitem group by cube (l_returnflag, l_linestatus) having count(*) > 10""")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines by flag, by status, by both and in all, with a condition on the groups."""
    out = read_table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level")).where("n > 10")
    return out.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity", "level")


@query("""
select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month, count(*)::bigint as n, strftime(max(o_orderdate + interval 45 day), '%Y-%m-%d') as due, max(date_diff('day', date_trunc('month', o_orderdate), o_orderdate))::bigint as last_day from orders group by 1""")
def months(spark: SparkSession, d: str) -> DataFrame:
    """Orders by month, the last due date and the last day of the month with an order."""
    o = read_table(spark, d, "orders").select(F.to_date("o_orderdate").alias("o"))
    month = F.trunc("o", "month")
    out = o.groupBy(month.alias("m")).agg(F.count("*").alias("n"), F.max(F.date_add("o", 45)).alias("due"), F.max(F.date_diff("o", month)).alias("last_day"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select(text("m").alias("month"), "n", text("due").alias("due"), _C("last_day").cast("bigint").alias("last_day"))
