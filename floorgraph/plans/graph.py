"""Queries of navigation graphs over the driver's tables.

The test network: nations are nodes, regions layers and zones, nation k has
edges to k + 1 and k + 7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorgraph.operators import bands as bd
from floorgraph.operators import forest as fo
from floorgraph.operators import graph as gr
from floorgraph.operators import layers as la
from floorgraph.sources.shared import unsent
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


def network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the test network; text ids of two digits, positions on a grid."""
    n = read_table(spark, d, "nation")
    k, text = _C("n_nationkey"), lambda c: F.format_string("%02d", c.cast("int"))
    zone = F.when(_C("n_regionkey") == 0, "paid").otherwise("public")
    nodes = n.select(
        text(k).alias("node_id"), F.when(k % 5 == 0, "gate").otherwise("stop").alias("type"), _C("n_regionkey").cast("string").alias("layer"),
        F.when(k % 2 == 0, F.lit("p")).alias("polygon_id"), F.array(*[(k % m).cast("double") for m in (5, 7, 3)]).alias("position"),
        zone.alias("zone_type"), _C("n_regionkey").cast("string").alias("zone_id"), _C("n_regionkey").cast("string").alias("zone_label"),
    )
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders")
    per = c.join(o, _C("c_custkey") == _C("o_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    costs = n.join(per, k == _C("c_nationkey"), "left").select(k.alias("k"), (F.coalesce("n", F.lit(0)) % 17 + 1).cast("double").alias("cost"))
    kinds = F.element_at(F.array(*[F.lit(t) for t in ("platform_walk", "stair", "escalator", "elevator")]), (_C("k") % 4 + 1).cast("int"))
    ends = costs.withColumn("to", F.explode(F.array((_C("k") + 1) % 25, (_C("k") + 7) % 25)))
    kind = F.when(_C("k") % 5 == 0, "gate_crossing").otherwise(kinds)
    edges = ends.select(
        F.concat_ws("_", text(_C("k")), text(_C("to"))).alias("edge_id"), text(_C("k")).alias("from"), text(_C("to")).alias("to"), kind.alias("type"),
        F.lit(None).cast("string").alias("connector_type"), _C("cost"), (_C("k") % 6 != 1).alias("bidirectional"),
    )
    return nodes, edges


def _preferences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in gr.PREFERENCES], "preference string")


_NET = """
nn as (select n_nationkey as k, printf('%02d', n_nationkey) as id, case when n_nationkey % 5 = 0 then 'gate' else 'stop' end as type, n_regionkey as layer, case when n_nationkey % 2 = 0 then 'p' end as poly,
       (n_nationkey % 5)::double as x, (n_nationkey % 7)::double as y, (n_nationkey % 3)::double as z, case when n_regionkey = 0 then 'paid' else 'public' end as zone,
       case when n_nationkey % 5 = 0 and n_regionkey <> 0 then '' else n_regionkey::varchar end as sig from nation),
pc as (select k, (coalesce(n, 0) % 17 + 1)::double as cost from nn left join (select c_nationkey, count(*) as n from customer join orders on c_custkey = o_custkey group by 1) on k = c_nationkey),
ee as (select printf('%02d', k) as f, printf('%02d', (k + s) % 25) as t, case when k % 5 = 0 then 'gate_crossing' else ['platform_walk', 'stair', 'escalator', 'elevator'][k % 4 + 1] end as type, cost, k % 6 <> 1 as bi
       from pc, (values (1), (7)) v(s)),
xe as (select f || '_' || t as edge_id, f, t, case when ee.type in ('stair', 'escalator', 'elevator') then ee.type end as mode, cost as base_cost, false as synthetic, bi,
       case when ee.type in ('stair', 'escalator', 'elevator') or (a.zone = b.zone and a.sig = b.sig) then 0.0 when a.zone <> b.zone then 1000.0 else 100.0 end::double as zone_penalty
       from ee join nn a on f = a.id join nn b on t = b.id where a.zone = b.zone or ee.type = 'gate_crossing'),
we as (select 'walk_' || a.id || '_to_' || b.id, a.id, b.id, null, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), true, true, 0.0
       from nn a join nn b on a.layer = b.layer and a.zone = b.zone and a.sig = b.sig and a.poly is not distinct from b.poly and a.id < b.id and not (a.type = 'gate' and b.type = 'gate')),
ae as (select * from xe union all select * from we),
de as (select edge_id, f, t, mode, base_cost, synthetic, zone_penalty from ae union all select edge_id || '_reverse', t, f, mode, base_cost, synthetic, zone_penalty from ae where bi),
re as (select p.p as preference, *, case when synthetic or mode is null then 1.0 when mode = 'elevator' then case when p.p = 'elevator' then 0.15 else 8.0 end when p.p = 'elevator' and mode = 'escalator' then 3.0
       when p.p = 'elevator' and mode = 'stair' then 10.0 else 1.0 end::double as multiplier from de, (values ('none'), ('elevator')) p(p))"""
_COSTED = _NET + ", ce as materialized (select preference, f, t, min(base_cost * multiplier + zone_penalty) as c, 1 as h from re group by all), s0 as materialized (select preference, f, t, c, h from ce union all select p.p, id, id, 0.0, 0 from nn, (values ('none'), ('elevator')) p(p))"
for _i in range(5):  # five squarings reach paths of 32 edges, of 24 that there can be
    _COSTED += f""", s{_i + 1} as materialized (select preference, f, t, m.c as c, m.h as h from (select a.preference, a.f, b.t, min({{'c': round(a.c + b.c, 9), 'h': a.h + b.h}}) as m
       from s{_i} a join s{_i} b on a.preference = b.preference and a.t = b.f group by all))"""


@query(f"with {_NET} select preference, edge_id, f as \"from\", t as \"to\", mode, round(base_cost, 4) as base_cost, zone_penalty, synthetic, multiplier, round(base_cost * multiplier + zone_penalty, 4) as route_cost from re")
def route_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = network(spark, d)
    out = gr.route_edges(nodes, edges, _preferences(spark))
    return out.withColumn("base_cost", F.round("base_cost", 4)).withColumn("route_cost", F.round("route_cost", 4))


def _shortest(spark: SparkSession, d: str, preferences: DataFrame) -> DataFrame:
    nodes, edges = network(spark, d)
    weighted = gr.route_edges(nodes, edges, preferences).select(_C("preference").alias("graph"), "from", "to", _C("route_cost").alias("cost"))
    sources = nodes.select(_C("node_id").alias("node")).join(F.broadcast(preferences.select(_C("preference").alias("graph"))))  # two preferences
    return gr.shortest_paths(weighted, sources)


@query(f"with {_COSTED} select preference, f as source, t as node, round(c, 4) as cost from s5")
def shortest_cost_all(spark: SparkSession, d: str) -> DataFrame:
    """Costs of the cheapest routes between all nodes, for both preferences."""
    return _shortest(spark, d, _preferences(spark)).select(_C("graph").alias("preference"), "source", "node", F.round("cost", 4).alias("cost"))


@query(f"""with {_COSTED}, w as (select a.f, b.t, min({{'c': round(a.c + b.c, 6), 'w': a.t}}) as m from s5 a join s5 b on a.preference = b.preference and a.t = b.f
  where a.preference = 'none' and a.t::int % 6 = 0 and a.f <> b.t group by all) select f as source, t as goal, m.w as waypoint, round(m.c, 4) as cost from w""")
def waypoint_best(spark: SparkSession, d: str) -> DataFrame:
    """The best way over one of the waypoints for each pair."""
    costs = _shortest(spark, d, spark.createDataFrame([("none",)], "preference string"))
    points = read_table(spark, d, "nation").where("n_nationkey % 6 = 0").select(F.format_string("%02d", "n_nationkey").alias("waypoint"))
    return gr.via_waypoint(costs, points).select("source", "goal", "waypoint", F.round("cost", 4).alias("cost"))


@query(f"""
with recursive {_COSTED}, pv as materialized (select p.preference, p.f, p.t, min(e.f) as u from s5 p join ce e on e.preference = p.preference and e.t = p.t join s5 b on b.preference = p.preference and b.f = p.f and b.t = e.f
       where abs(b.c + e.c - p.c) < 1e-6 and b.h + 1 = p.h group by all),
  w as (select f as source, t as goal, c, h, t as here, t as way from s5 where preference = 'none' and f <> t union all
        select source, goal, c, h, u, u || '>' || way from w join pv on pv.preference = 'none' and pv.f = source and pv.t = here where here <> source)
select source, goal, round(c, 4) as cost, h::int as edge_count, (h + 1)::int as node_count, way as nodes from w where here = source""")
def route_payload(spark: SparkSession, d: str) -> DataFrame:
    """Cost and nodes of the routes between all pairs of nodes; unreachable ones are missing."""
    tree = _shortest(spark, d, spark.createDataFrame([("none",)], "preference string"))
    out = gr.paths(tree, tree.where("source <> node").select("graph", "source", _C("node").alias("goal")))
    return out.select("source", "goal", F.round("cost", 4).alias("cost"), _C("hops").alias("edge_count"), F.size("nodes").alias("node_count"), F.array_join("nodes", ">").alias("nodes"))


_EXPRESS = (1, 8, 64, 512, 4096)
_WALKED = f"""
ke as materialized (select c_custkey % 25 as g, c_custkey as f, c_custkey + 25 * s as t, (1 + (c_custkey * 31 + s) % 17 + s)::double as c from customer, (values {", ".join(f"({s})" for s in _EXPRESS)}) v(s)),
kd as materialized (select g, f, t, c from ke semi join customer on t = c_custkey union all select g, t, f, c from ke semi join customer on t = c_custkey),
k0 as materialized (select g, s, s as n, 0.0::double as c, 0 as h, null::bigint as p from (select distinct c_custkey % 25 as g, min(c_custkey) over (partition by c_custkey % 25, c_mktsegment) as s from customer))"""
for _i in range(40):  # rounds of minimum relaxation; the longest way of 600 nodes has 18 edges
    _WALKED += f""", k{_i + 1} as materialized (select g, s, n, m.c as c, m.h as h, m.p as p from (select g, s, n, min({{'c': c, 'h': h, 'p': p}}) as m from (
       select * from k{_i} union all select k.g, s, e.t, k.c + e.c, h + 1, e.f from k{_i} k join kd e on k.n = e.f) group by all))"""


def express_network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges and sources of a network that grows with the customers: every 25th is a node of one graph, with links to the next and to far ones."""
    k = read_table(spark, d, "customer").select(_C("c_custkey").cast("bigint").alias("k"), "c_mktsegment")
    ends = k.select("k", F.explode(F.array(*[F.lit(s) for s in _EXPRESS])).alias("s")).select((_C("k") % 25).alias("graph"), _C("k").alias("from"), (_C("k") + 25 * _C("s")).alias("to"), (1 + (_C("k") * 31 + _C("s")) % 17 + _C("s")).cast("double").alias("cost"))
    ends = ends.join(unsent(k.select(_C("k").alias("to"))), "to", "left_semi").select("graph", "from", "to", "cost")
    back = ends.select("graph", _C("to").alias("from"), _C("from").alias("to"), "cost")
    sources = k.groupBy((_C("k") % 25).alias("graph"), "c_mktsegment").agg(F.min("k").alias("node")).select("graph", "node")
    return ends.unionByName(back), sources


@query(f"with {_WALKED} select g as graph, s as source, n as node, c as cost, h as hops, p as previous from k40")
def express_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest routes from up to five nodes of each graph to all others, a graph in a task."""
    return gr.cheapest(*express_network(spark, d))


@query(f"""with recursive {_WALKED}, w as (select g, s, n, c, h, n as here, n::varchar as way from k40 union all
  select w.g, w.s, w.n, w.c, w.h, k.p, k.p || '>' || way from w join k40 k on k.g = w.g and k.s = w.s and k.n = here where here <> w.s)
select g as graph, s as source, n as goal, c as cost, h as hops, way as nodes from w where here = s""")
def express_routes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of these routes; in graphs too large for a task, bounds of 512 keep the far ones from being reached too dearly first."""
    edges, sources = express_network(spark, d)
    tree = gr.cheapest(edges, sources, delta=512.0)
    found = gr.paths(tree, tree.select("graph", "source", _C("node").alias("goal")))
    return found.select("graph", "source", "goal", "cost", "hops", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">").alias("nodes"))


@query(f"""with {_NET} select f || '_' || t as edge_id, ee.type = 'gate_crossing' or a.type = 'gate' or b.type = 'gate' as by_ends, contains(lower(concat_ws(' ', f || '_' || t, ee.type, a.type, b.type)), 'gate') as by_text
from ee join nn a on f = a.id join nn b on t = b.id where ee.type = 'gate_crossing' or a.type = 'gate' or b.type = 'gate' or contains(lower(concat_ws(' ', f || '_' || t, ee.type, a.type, b.type)), 'gate')""")
def gate_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that touch a gate, by their ends and by their text."""
    nodes, edges = network(spark, d)
    end = lambda s: nodes.select(_C("node_id").alias(f"{s}_id"), _C("type").alias(f"{s}_type"))
    e = edges.join(end("a"), _C("from") == _C("a_id")).join(end("b"), _C("to") == _C("b_id"))
    by_ends = (_C("type") == "gate_crossing") | (_C("a_type") == "gate") | (_C("b_type") == "gate")
    by_text = F.contains(F.lower(F.concat_ws(" ", "edge_id", "type", "a_type", "b_type")), F.lit("gate"))
    return e.select("edge_id", by_ends.alias("by_ends"), by_text.alias("by_text")).where("by_ends or by_text")


@query("""
with o as (select c_custkey, c_nationkey, c_mktsegment, c_acctbal, coalesce(c_acctbal - lag(c_acctbal) over w > 40, true) as starts, row_number() over w as i from customer window w as (partition by c_nationkey, c_mktsegment order by c_acctbal, c_custkey)),
     g as (select *, sum(starts::int) over (partition by c_nationkey, c_mktsegment order by i) as run from o)
select c_custkey as node, min(c_custkey) over (partition by c_nationkey, c_mktsegment, run) as component from g""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation and segment are linked where their balances are at most 40 apart."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_acctbal", "c_custkey")
    c = read_table(spark, d, "customer")
    linked = c.select(_C("c_custkey").alias("to"), F.lag("c_custkey").over(w).alias("from"), (_C("c_acctbal") - F.lag("c_acctbal").over(w)).alias("gap")).where("from is not null and gap <= 40")
    return gr.components(c.select(_C("c_custkey").alias("node")), linked)


@query(f"""
with recursive {_NET},
  oe as (select least(f, t) as a, greatest(f, t) as b, cost as score, row_number() over (order by cost, least(f, t), greatest(f, t)) as i from ee),
  r as (select 0::bigint as i, list_transform(range(0, 25), lambda x: x::bigint) as lab, 25 as n, false as took
    union all select oe.i, case when n > 5 and lab[a::int + 1] <> lab[b::int + 1] then list_transform(lab, lambda x: case when x = lab[b::int + 1] then lab[a::int + 1] else x end) else lab end,
      n - (n > 5 and lab[a::int + 1] <> lab[b::int + 1])::int, n > 5 and lab[a::int + 1] <> lab[b::int + 1] from r join oe on oe.i = r.i + 1)
select a as "from", b as "to", score from r join oe using (i) where took""")
def kruskal_target(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest edges of the undirected network until five components are left."""
    nodes, edges = network(spark, d)
    e = edges.select(F.lit("net").alias("graph"), F.least("from", "to").alias("from"), F.greatest("from", "to").alias("to"), _C("cost").alias("score"))
    n = nodes.agg(F.count("*").alias("nodes")).select(F.lit("net").alias("graph"), "nodes")
    return fo.spanning_forest(e, n, 5).select("from", "to", "score")


@query("""
with recursive l as (select n_nationkey as child, (n_nationkey - 1) // 2 as parent, 1 + (n_nationkey % 3) * 0.25 as s, n_nationkey::double as o from nation where n_nationkey > 0),
  t as (select 0 as node, 1.0::double as scale, 0.0::double as off, 0 as depth union all select child, scale * s, scale * o + off, depth + 1 from t join l on node = parent)
select node, round(scale, 4) as scale, round(off, 4) as "offset", depth from t""")
def transform_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Scale and offset of every node of a tree, composed from the root."""
    k = _C("n_nationkey")
    n = read_table(spark, d, "nation")
    links = n.where(k > 0).select(F.floor((k - 1) / 2).cast("int").alias("parent"), k.alias("child"), (1 + k % 3 * 0.25).alias("scale"), k.cast("double").alias("offset"))
    out = gr.propagate(n.select(k.alias("node")), links, 0)
    return out.select("node", F.round("scale", 4).alias("scale"), F.round("offset", 4).alias("offset"), "depth")


@query("""
with recursive p as (select c_custkey as k, case when c_custkey % 3 = 0 then 'B' else 'F' end as f, x as n, x + w as t, w * 10 + x as o, (1 + x * 0.25)::double as u, ((c_custkey % 4) * 0.5)::double as v, (c_custkey % 7)::double as e, x::double as g
    from customer, range(0, 5) r(x), (values (1), (2)) s(w) where (w = 1 and (c_custkey % 4 <> 0 or x < 3)) or (w = 2 and x % 2 = 0 and x < 4)),
  d as (select k, f, n as this, t as next, o, u, v, e, g from p union all select k, f, t, n, o, u / (u * u + v * v), -v / (u * u + v * v), -(u * e + v * g) / (u * u + v * v), (v * e - u * g) / (u * u + v * v) from p),
  r as (select k, f, case when f = 'B' then 1 when k % 3 = 2 and k % 5 <> 0 then 2 else 0 end as root from (select distinct k, f from p)),
  w as (select k, f, root, root as here, [root] as seen, []::bigint[] as turns, 1.0::double as u, 0.0::double as v, 0.0::double as e, 0.0::double as g from r union all
    select w.k, w.f, w.root, d.next, list_append(seen, d.next), list_append(turns, d.o::bigint), w.u * d.u - w.v * d.v, w.v * d.u + w.u * d.v, w.u * d.e - w.v * d.g + w.e, w.v * d.e + w.u * d.g + w.g
    from w join d on d.k = w.k and d.this = w.here where not list_contains(seen, d.next)),
  m as (select k, f, root, here, min({'n': len(turns), 'turns': turns, 'u': u, 'v': v, 'e': e, 'g': g}) as m from w group by all)
select k as station, f || here as layer, f || root as root, m.n::int as depth, round(m.u, 6) as u, round(m.v, 6) + 0.0::double as v, round(m.e, 6) + 0.0::double as x, round(m.g, 6) + 0.0::double as y from m""")
def layer_transforms(spark: SparkSession, d: str) -> DataFrame:
    """Each customer is a station of six layers in two kinds of pairs; some ask for a root, some of these for one that is not there."""
    k, x, w = _C("c_custkey").cast("bigint"), _C("x"), _C("w")
    n = lambda *v: F.array(*[F.lit(i) for i in v])
    each = read_table(spark, d, "customer").select(k.alias("k"), F.explode(n(0, 1, 2, 3, 4)).alias("x")).select("k", "x", F.explode(n(1, 2)).alias("w"))
    each = each.where(((w == 1) & ((_C("k") % 4 != 0) | (x < 3))) | ((w == 2) & (x % 2 == 0) & (x < 4)))
    name = lambda at: F.concat(F.when(_C("k") % 3 == 0, "B").otherwise("F"), at.cast("string"))
    u, v, none = 1 + x * 0.25, (_C("k") % 4) * 0.5, F.lit(0.0)
    matrix = F.array(*[c.cast("double") for c in (u, -v, _C("k") % 7, v, u, x, none, none, F.lit(1.0))])
    pairs = each.select(_C("k").alias("graph"), (w * 10 + x).cast("bigint").alias("ord"), name(x).alias("a"), name(x + w).alias("b"), matrix.alias("matrix"))
    asked = read_table(spark, d, "customer").where("c_custkey % 3 = 2").select(k.alias("graph"), F.when(k % 5 == 0, "X9").otherwise("F2").alias("layer"))
    at = lambda i, c: (F.round(_C("matrix")[i], 6) + F.lit(0.0)).alias(c)
    out = la.align_layers(pairs, asked)
    return out.select(_C("graph").alias("station"), "layer", "root", "depth", at(0, "u"), at(3, "v"), at(2, "x"), at(5, "y"))


_LLOYD = "b0 as materialized (select g, i, min(k) + (max(k) - min(k)) * (i - 0.5) / 4 as c from bn, range(1, 5) r(i) group by g, i)"
for _i in range(6):
    _LLOYD += f", l{_i} as materialized (select bn.g, k, arg_min(i, {{'d': abs(k - c), 'i': i}}) as i from bn join b{_i} using (g) group by all), b{_i + 1} as materialized (select g, i, avg(k) as c from l{_i} group by all)"


@query(f"""
with bn as (select c_custkey % 25 as g, c_custkey as k from customer), {_LLOYD},
  be as (select a.g, a.k as f, a.k + 25 as t, (1 + (a.k * 31 + 1) % 17)::double as score, x.i = y.i as inside, x.i as band from bn a join l5 x on x.g = a.g and x.k = a.k join l5 y on y.g = a.g and y.k = a.k + 25),
  bs as (select *, row_number() over (partition by g order by score, f, t) as place, (select count(*) from bn where bn.g = be.g) as n from be)
select g as graph, f as "from", t as "to", score, case when g % 2 = 1 then band end::int as band, case when g % 2 = 1 then 'bands' else 'strongest' end as selection from bs where case when g % 2 = 1 then inside else place <= n - 4 end""")
def banded_edges(spark: SparkSession, d: str) -> DataFrame:
    """Chains of customers in four groups: by bands of their keys, and, where values go round and no link stays in a band, by the strongest links."""
    c = read_table(spark, d, "customer").select(_C("c_custkey").cast("bigint").alias("node"))
    nodes = c.select((_C("node") % 25).alias("graph"), "node", F.when(_C("node") % 25 % 2 == 1, _C("node")).otherwise(F.floor(_C("node") / 25) % 4).cast("double").alias("value"))
    ends = c.select((_C("node") % 25).alias("graph"), _C("node").alias("from"), (_C("node") + 25).alias("to"), (1 + (_C("node") * 31 + 1) % 17).cast("double").alias("score"))
    return bd.banded_edges(nodes, ends.join(unsent(c.select(_C("node").alias("to"))), "to", "left_semi"), 4)


@query("""
select 'chain_' || f || '_' || event_id as edge_id, f as "from", event_id as "to" from (select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as f from events) where f is not null
union all select 'lift_' || a.n || '_' || b.n, a.n, b.n from (select l_orderkey, l_returnflag, l_orderkey * 10 + l_linenumber as n from lineitem) a join (select l_orderkey, l_returnflag, l_orderkey * 10 + l_linenumber as n from lineitem) b
on a.l_orderkey = b.l_orderkey and a.l_returnflag = b.l_returnflag and a.n < b.n""")
def platform_chain(spark: SparkSession, d: str) -> DataFrame:
    """Edges between consecutive nodes, and between all stops of an elevator."""
    chain = gr.chain_edges(read_table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_id", "chain")
    stops = read_table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (_C("l_orderkey") * 10 + _C("l_linenumber")).alias("n"))
    return chain.unionByName(gr.clique_edges(stops, ["l_orderkey", "l_returnflag"], "n", "lift"))


@query("""
select 'conn_' || l_orderkey || '_' || l_linenumber as node_id, case when l_returnflag = 'A' then 'exit' else 'connector' end as type,
       case when l_returnflag <> 'A' then null when l_quantity < 5 then 'start' when l_quantity > 45 then 'end' when l_linestatus = 'O' then 'end' when l_discount < l_tax then 'start' else 'end' end as endpoint from lineitem
union all select 'plat_' || s_suppkey, 'platform_position', null from supplier union all select 'poi_' || p_partkey, case when p_size > 40 then 'toilet' else 'poi' end, null from part where p_size > 20
union all select 'gate_' || n_nationkey || '_' || side, 'gate', side from nation, (values ('front'), ('back')) s(side)""")
def nav_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A rule for each kind of node; exits choose the endpoint that leads outside."""
    line = read_table(spark, d, "lineitem")
    outside = F.when(_C("l_quantity") < 5, "start").when(_C("l_quantity") > 45, "end").when(_C("l_linestatus") == "O", "end").when(_C("l_discount") < _C("l_tax"), "start").otherwise("end")
    is_exit = _C("l_returnflag") == "A"
    none = F.lit(None).cast("string").alias("endpoint")
    connectors = line.select(F.concat_ws("_", F.lit("conn"), _C("l_orderkey").cast("string"), _C("l_linenumber").cast("string")).alias("node_id"), F.when(is_exit, "exit").otherwise("connector").alias("type"), F.when(is_exit, outside).alias("endpoint"))
    platforms = read_table(spark, d, "supplier").select(F.concat(F.lit("plat_"), _C("s_suppkey").cast("string")).alias("node_id"), F.lit("platform_position").alias("type"), none)
    pois = read_table(spark, d, "part").where("p_size > 20").select(F.concat(F.lit("poi_"), _C("p_partkey").cast("string")).alias("node_id"), F.when(_C("p_size") > 40, "toilet").otherwise("poi").alias("type"), none)
    sides = read_table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit("front"), F.lit("back"))).alias("endpoint"))
    gates = sides.select(F.concat_ws("_", F.lit("gate"), _C("n_nationkey").cast("string"), "endpoint").alias("node_id"), F.lit("gate").alias("type"), "endpoint")
    return connectors.unionByName(platforms).unionByName(pois).unionByName(gates)
