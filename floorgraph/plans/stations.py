"""Navigation graphs of stations, built from records bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorgraph.functions import rings as rg
from floorgraph.operators import navigation as nv
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


def _xyz(*values: Column) -> Column:
    return F.array(*[v.cast("double") for v in values])


def _station(key: str) -> Column:
    return F.format_string("st%02d", (_C(key) % 25).cast("int"))


def _text(prefix: str, *keys: str) -> Column:
    return F.concat_ws("_", F.lit(prefix), *[_C(k).cast("string") for k in keys])


def station_records(spark: SparkSession, d: str) -> list[DataFrame]:
    """Records of connections, assets, platforms, elevators and zones of 25 stations: lines are connections, parts assets, suppliers doors of their nation's platform, customers stops of elevators, nations zones."""
    none = F.lit(None)
    line, n = read_table(spark, d, "lineitem"), _C("l_linenumber")
    connections = line.select(
        _station("l_suppkey").alias("graph"), F.concat_ws("_", F.lit("c"), *[_C(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], _C("l_quantity").cast("int").cast("string")).alias("connection_id"),
        F.when(_C("l_returnflag") == "A", "exit_stair").when(_C("l_returnflag") == "R", "stair").otherwise("escalator").alias("type"), none.cast("string").alias("asset_type"),
        F.when(_C("l_returnflag") == "A", n.cast("string")).alias("exit_number"), (n % 4 != 0).alias("bidirectional"),
        F.lit("B1").alias("from_layer"), F.when(n % 3 == 0, "p").alias("from_polygon"), _xyz(_C("l_quantity"), n, F.lit(0)).alias("from_position"),
        F.when(_C("l_linestatus") == "O", "OUTSIDE").otherwise("B1").alias("to_layer"), F.when(n % 2 == 0, "q").alias("to_polygon"),
        _xyz(_C("l_quantity") + 3, n + 4, F.round(_C("l_discount") * 100 - 5, 4)).alias("to_position"),
    )
    size = _C("p_size")
    kinds = F.array(*[F.lit(k) for k in ("ticket_gate", "toilet", "exit", "subway", "moving_walkway", "bench")])
    assets = read_table(spark, d, "part").select(
        _station("p_partkey").alias("graph"), _text("a", "p_partkey").alias("asset_id"), none.cast("string").alias("label"), F.get(kinds, size % 6).alias("type"), F.lit("B1").alias("layer"), none.cast("string").alias("polygon_id"),
        _xyz(size, _C("p_retailprice") / 100).alias("location"), F.when(size % 4 != 0, (size * 10).cast("double")).alias("rotation_z"), _xyz(size, F.lit(0)).alias("facing"), _xyz(F.lit(0), F.lit(0)).alias("public_side"),
        F.when(size % 5 == 0, _xyz(F.lit(100), F.lit(0))).alias("paid_side"), F.when(size % 7 == 0, 3.5).alias("cost"),
    )
    platforms = read_table(spark, d, "supplier").select(
        _station("s_suppkey").alias("graph"), _text("pl", "s_nationkey").alias("platform_id"), F.lit("B2").alias("layer"), F.lit("q").alias("polygon_id"), _C("s_suppkey").alias("ord"), _text("d", "s_suppkey").alias("node_id"),
        _xyz(_C("s_nationkey"), _C("s_acctbal") / 100, F.lit(-5)).alias("position"), _C("s_suppkey").cast("string").alias("car_door"),
    )
    k = _C("c_custkey")
    elevators = read_table(spark, d, "customer").select(
        _station("c_custkey").alias("graph"), _text("e", "c_nationkey", "c_mktsegment").alias("elevator_id"), _text("s", "c_custkey").alias("elevator_point_id"), k.alias("ord"), F.lit("B1").alias("layer"), none.cast("string").alias("polygon_id"),
        _xyz(_C("c_nationkey"), k % 9, k % 4).alias("position"), F.lit(0.0).alias("facing_angle"), none.cast("array<double>").alias("facing"), (k % 10 == 0).alias("exit"), (k % 5).cast("string").alias("exit_number"),
    )
    at = lambda x, y: rg.point(F.lit(x), F.lit(y))
    zones = read_table(spark, d, "nation").select(
        _station("n_nationkey").alias("graph"), _text("z", "n_nationkey").alias("zone_id"), F.lit("paid").alias("zone_type"), F.lit("B1").alias("layer"), _C("n_nationkey").alias("ord"),
        F.array(at(10.25, 1.25), at(30.25, 1.25), at(30.25, 9.75), at(10.25, 9.75)).alias("ring"),
    )
    return [connections, assets, platforms, elevators, zones]


_RECORDS = """
c as (select printf('st%02d', l_suppkey % 25) as g, 'c_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || l_quantity::int as id, l_returnflag = 'A' as outward, case when l_returnflag = 'R' then 'stair' when l_returnflag = 'A' then 'exit_stair' else 'escalator' end as con, l_linenumber % 4 <> 0 as bi,
      l_quantity::double as x, l_linenumber::double as y, round(l_discount * 100 - 5, 4) as z1, l_linenumber % 3 = 0 as pf, l_linenumber % 2 = 0 as pt, l_linestatus = 'O' as o from lineitem),
k as (select *, case when pf <> pt then pf when o then true else 0 <= z1 end as keep_from from c),
p as (select printf('st%02d', p_partkey % 25) as g, 'a_' || p_partkey as id, ['ticket_gate', 'toilet', 'exit', 'subway', 'moving_walkway', 'bench'][p_size % 6 + 1] as kind, p_size::double as x, p_retailprice / 100 as y,
      case when p_size % 4 <> 0 then radians(p_size * 10.0) end as r, p_size % 5 = 0 as paid, case when p_size % 7 = 0 then 3.5 else 10.0 end as cost from part where p_size % 6 <> 5),
q as (select *, x + cos(coalesce(r, 0)) as ax, y + sin(coalesce(r, 0)) as ay, x - cos(coalesce(r, 0)) as bx, y - sin(coalesce(r, 0)) as bw from p where kind = 'ticket_gate'),
s as (select *, case when paid then not (sqrt((ax - 100) * (ax - 100) + ay * ay) <= sqrt((bx - 100) * (bx - 100) + bw * bw)) else sqrt(ax * ax + ay * ay) <= sqrt(bx * bx + bw * bw) end as a_first from q),
e as (select printf('st%02d', c_custkey % 25) as g, 'e_' || c_nationkey || '_' || c_mktsegment as el, 's_' || c_custkey || '_node' as id, c_custkey as ord, c_nationkey + 0.4 as x, (c_custkey % 9)::double as y, (c_custkey % 4)::double as z, c_custkey % 10 = 0 as out from customer),
d as (select printf('st%02d', s_suppkey % 25) as g, s_nationkey as pl, s_suppkey as ord, 'd_' || s_suppkey as id, s_nationkey::double as x, s_acctbal / 100 as y from supplier)"""


@query(f"""
with {_RECORDS},
n as (select g, id || '_from' as node_id, case when outward then 'exit' else 'connector' end as type, 'B1' as layer, x, y, null as zt, null as zi from k where not outward or keep_from
  union all select g, id || '_to', case when outward then 'exit' else 'connector' end, case when o then 'OUTSIDE' else 'B1' end, x + 3, y + 4, null, null from k where not outward or not keep_from
  union all select g, id || '_front_node', 'gate', 'B1', case when a_first then ax else bx end, case when a_first then ay else bw end, 'public', id || '_front' from s
  union all select g, id || '_back_node', 'gate', 'B1', case when a_first then bx else ax end, case when a_first then bw else ay end, 'paid', id || '_back' from s
  union all select g, id || '_node', case kind when 'exit' then 'exit' when 'toilet' then 'poi' else 'asset' end, 'B1', case when kind = 'toilet' then x + 0.4 * case when r is null then 0 else cos(r) end else x end,
    case when kind = 'toilet' then y + 0.4 * case when r is null then -1 else sin(r) end else y end, null, null from p where kind <> 'ticket_gate'
  union all select g, id, 'platform_position', 'B2', x, y, null, null from d
  union all select g, id, case when out then 'exit_elevator' else 'elevator' end, 'B1', x, y, null, null from e),
z as (select *, layer = 'B1' and x > 10.25 and x < 30.25 and y > 1.25 and y < 9.75 as held from n)
select g as station, node_id, type, layer, round(x, 4) as x, round(y, 4) as y, coalesce(zt, case when held then 'paid' else 'public' end) as zone_type, coalesce(zi, case when held then 'z_' || substr(g, 3)::int end) as zone_id,
  row_number() over (partition by g order by node_id) as node_key from z""")
def station_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of all kinds with their zones and dense keys."""
    nodes = nv.build_nodes(*station_records(spark, d))
    at = lambda k: F.round(_C("position")[k], 4)
    return nodes.select(_C("graph").alias("station"), "node_id", "type", "layer", at(0).alias("x"), at(1).alias("y"), "zone_type", "zone_id", "node_key")


@query(f"""
with {_RECORDS},
t as (select *, row_number() over (partition by g, el order by ord, id) as n from e where not out),
w as (select *, lag(id) over o as before, lag(x) over o as x0, lag(y) over o as y0 from d window o as (partition by g, pl order by ord, id))
select g as station, id || '_edge' as edge_id, id || '_from' as "from", id || '_to' as "to", 'vertical' as type, con as connector_type, round(sqrt(25 + z1 * z1), 4) as cost, bi as bidirectional from k where not outward
union all select g, id || '_gate_crossing', id || '_front_node', id || '_back_node', 'gate_crossing', null, cost, true from s
union all select g, before || '_to_' || id, before, id, 'platform_walk', null, round(sqrt(power(x - x0, 2) + power(y - y0, 2)), 4), true from w where before is not null
union all select a.g, a.el || '_' || a.n || '_to_' || b.n, a.id, b.id, 'elevator', null, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), 4), true from t a join t b on a.g = b.g and a.el = b.el and a.n < b.n""")
def station_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of all kinds."""
    edges = nv.build_edges(*station_records(spark, d)[:4])
    return edges.select(_C("graph").alias("station"), "edge_id", "from", "to", "type", "connector_type", F.round("cost", 4).alias("cost"), "bidirectional")
