"""Hand-made cases of the operators and expressions, with answers worked out by hand."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floorgraph import catalog
from floorgraph.functions import geometry as g
from floorgraph.functions import rings as rg
from floorgraph.functions import text as tx
from floorgraph.operators import aggregates as ag
from floorgraph.operators import cluster as cl
from floorgraph.operators import forest as fo
from floorgraph.operators import graph as gr
from floorgraph.operators import held
from floorgraph.operators import lookup as lk
from floorgraph.operators import raster as rs
from floorgraph.operators import scene as sc
from floorgraph.operators import spatial as sp
from floorgraph.sources import shared

NODES = "node_id string, type string, layer string, polygon_id string, position array<double>, zone_type string, zone_id string, zone_label string"
EDGES = "edge_id string, `from` string, `to` string, type string, connector_type string, cost double, bidirectional boolean"


def station(spark, **changes):
    nodes = [
        ["A", "platform_position", "B1", "p1", [0.0, 0.0, 0.0], "paid", "z1", "z1"], ["B", "connector", "B1", "p1", [3.0, 4.0, 0.0], "paid", "z1", "z1"],
        ["C", "connector", "B2", "p2", [3.0, 4.0, -5.0], "paid", "z1", "z1"], ["D", "gate", "B2", "p2", [6.0, 8.0, -5.0], "paid", "g_back", changes.get("label", "z1")],
        ["E", "gate", "B2", "p2", [6.0, 10.0, -5.0], "public", "g_front", None], ["F", "exit", "B2", "p2", [6.0, 13.0, -5.0], None, None, None],
    ]
    edges = [("bc", "B", "C", "vertical", "stair", changes.get("bc", 10.0), None), ("ac", "A", "C", "elevator", None, 10.0, True), ("de", "D", "E", changes.get("de", "gate_crossing"), None, 10.0, True), ("xx", "A", "nowhere", "vertical", None, 1.0, True)]
    prefs = spark.createDataFrame([(p,) for p in gr.PREFERENCES], "preference string")
    return gr.route_edges(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), prefs)


def route(spark, edges, a, b):
    named = edges.select(F.col("preference").alias("graph"), "from", "to", F.col("route_cost").alias("cost"))
    sources = spark.createDataFrame([(p, a) for p in gr.PREFERENCES], "graph string, node string")
    wanted = spark.createDataFrame([(p, a, b) for p in gr.PREFERENCES], "graph string, source string, goal string")
    return {r.graph: (r.cost, "".join(r.nodes)) for r in gr.paths(gr.shortest_paths(named, sources), wanted).collect()}


def test_routes_of_the_small_station(spark):
    edges = station(spark)
    walks = {(r["from"], r["to"]): r.base_cost for r in edges.where("synthetic and preference = 'none'").collect()}
    assert {k: v for k, v in walks.items() if k[0] < k[1]} == {("A", "B"): 5.0, ("C", "D"): 5.0, ("E", "F"): 3.0}
    assert route(spark, edges, "A", "F") == {"none": (1033.0, "ABCDEF"), "elevator": (1019.5, "ACDEF")}


def test_variants_of_the_small_station(spark):
    assert route(spark, station(spark, label="other"), "A", "F") == {}
    assert route(spark, station(spark, de="vertical"), "A", "F") == {}
    free = station(spark, bc=0.0).where("edge_id = 'bc' and preference = 'none'").first()
    assert free.base_cost == 5.0 and free.zone_penalty == 0.0


def test_way_over_a_waypoint(spark):
    costs = spark.createDataFrame([("g", a, b, c) for a, b, c in (("a", "w", 1.0), ("a", "v", 5.0), ("w", "b", 9.0), ("v", "b", 5.0), ("w", "w", 0.0))], "graph string, source string, node string, cost double")
    best = gr.via_waypoint(costs, spark.createDataFrame([("v",), ("w",)], "waypoint string")).where("source = 'a' and goal = 'b'").first()
    assert (best.waypoint, best.cost) == ("v", 10.0)


def test_shortest_paths_against_brute_force(spark):
    rng = random.Random(1)
    edges = [("g", f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", float(rng.randrange(1, 50))) for _ in range(90)]
    dist = {(f"n{i}", f"n{j}"): (0.0 if i == j else math.inf) for i in range(30) for j in range(30)}
    for _, a, b, c in edges:
        dist[a, b] = min(dist[a, b], c)
    for k in range(30):
        for i in range(30):
            for j in range(30):
                dist[f"n{i}", f"n{j}"] = min(dist[f"n{i}", f"n{j}"], dist[f"n{i}", f"n{k}"] + dist[f"n{k}", f"n{j}"])
    df = spark.createDataFrame(edges, "graph string, from string, to string, cost double")
    got = gr.shortest_paths(df, spark.createDataFrame([("g", f"n{i}") for i in range(30)], "graph string, node string")).collect()
    assert {(r.source, r.node): r.cost for r in got} == {k: v for k, v in dist.items() if v < math.inf}


def test_rounds_write_only_what_improved(spark, monkeypatch):
    """A chain with dear shortcuts: without a bound nodes are improved again and again, with one hardly ever; the results agree."""
    written = []
    real = gr.stored

    def counted(df, folder):
        out = real(df, folder)
        if "/round=" in folder and "-offers" not in folder:
            written.append(out.count())
        return out

    monkeypatch.setattr(gr, "stored", counted)
    steps = [("g", i, i + 1, 1.0) for i in range(12)] + [("g", i, i + 4, 9.0) for i in range(0, 9, 4)] + [("g", 0, None, 1.0), ("g", 3, 0, None)]
    edges = spark.createDataFrame(steps, "graph string, from int, to int, cost double")
    sources = spark.createDataFrame([("g", 0), ("g", 0), ("g", 9), ("h", 5)], "graph string, node int")
    told = lambda delta: sorted((r.graph, r.source, r.node, r.cost, r.hops, r.previous or -1) for r in gr.shortest_paths(edges, sources, delta=delta).collect())
    plain, free = told(None), list(written)
    written.clear()
    assert told(2.0) == plain and sum(written) <= sum(free)
    assert [r[3] for r in plain if r[:2] == ("g", 0)] == [float(i) for i in range(13)] and ("h", 5, 5, 0.0, 0, -1) in plain
    assert free[0] == 3 and free[-1] == 0 and max(free[1:]) <= 6  # the edges of a front, never the whole state of 18 rows


def test_ways_of_many_steps_by_doubling(spark):
    edges = spark.range(37).select(F.lit("g").alias("graph"), F.col("id").alias("from"), (F.col("id") + 1).alias("to"), F.lit(1.0).alias("cost"))
    tree = spark.createDataFrame([("g", 0, i, float(i), i, i - 1 if i else None) for i in range(38)], "graph string, source long, node long, cost double, hops int, previous long")
    wanted = spark.createDataFrame([("g", 0, 37), ("g", 0, 37), ("g", 0, 0), ("g", 0, 8), ("g", 0, 99), ("h", 0, 1)], "graph string, source long, goal long")
    got = {r.goal: r.nodes for r in gr.paths(tree, wanted).collect()}
    assert got == {37: list(range(38)), 0: [0], 8: list(range(9))}
    few = gr.shortest_paths(edges, spark.createDataFrame([("g", 0)], "graph string, node long"), max_rounds=3)
    assert sorted(r.node for r in few.collect()) == [0, 1, 2, 3]
    assert gr.paths(tree.limit(0), wanted).count() == gr.shortest_paths(edges.limit(0), wanted.limit(0).select("graph", F.col("goal").alias("node"))).count() == 0


def test_bounds_widen(spark, monkeypatch):
    kept, stored = [], gr.stored
    monkeypatch.setattr(gr, "stored", lambda df, folder: kept.append(folder) or stored(df, folder))
    edges = spark.range(1, 41).select(F.lit("g").alias("graph"), F.lit(0).cast("long").alias("from"), F.col("id").alias("to"), (F.col("id") * 10.0).alias("cost"))
    sources = spark.createDataFrame([("g", 0)], "graph string, node long")
    got = {r.node: r.cost for r in gr.shortest_paths(edges, sources, delta=10.0).collect()}
    assert got == {i: i * 10.0 for i in range(41)}
    assert len(kept) < 20  # two a round, of which there were 40


def _told(tree):
    return sorted((r.graph, r.source, r.node, r.cost, r.hops, r.previous) for r in tree.collect())


def _ways(found):
    return sorted((r.graph, r.source, r.goal, r.cost, r.hops, r.nodes) for r in found.collect())


def test_graphs_that_a_task_holds(spark, monkeypatch):
    """Solved in tasks or by rounds, followed in tasks or by doubling: the same routes of the same ties, by bytes of the ids."""
    rng = random.Random(5)
    names = [f"{c}{i}" for c in ("a", "Z", "\uffee", "\U0001f600") for i in range(10)]
    costs = [0.0, 1.0, 1.0, 2.0, 0.1, 0.0000000005, 0.12345678951, None]
    rows = [("gh"[rng.randrange(2)], rng.choice(names), rng.choice([*names, None]), rng.choice(costs)) for _ in range(260)]
    edges = spark.createDataFrame([*rows, ("below", "a0", "a1", 3.0), ("below", "a1", "a2", -1.0), ("endless", "a0", "a1", math.inf), (None, "a0", "a1", 1.0)], "graph string, from string, to string, cost double")
    asked = [("g", n) for n in names] + [("h", n) for n in names[:3]] * 2 + [("below", "a0"), ("endless", "a0"), ("alone", "a0")]
    sources = spark.createDataFrame(asked, "graph string, node string")
    plain = _told(gr.shortest_paths(edges, sources).fillna("", "previous"))
    rounds, doubled = [], []
    shortest_paths, by_doubling = gr.shortest_paths, gr._doubled
    monkeypatch.setattr(gr, "shortest_paths", lambda e, s, **k: rounds.append(sorted(r.graph for r in s.select("graph").distinct().collect())) or shortest_paths(e, s, **k))
    monkeypatch.setattr(gr, "_doubled", lambda *a: doubled.append(1) or by_doubling(*a))
    tree = gr.cheapest(edges, sources)
    assert _told(tree.fillna("", "previous")) == plain and rounds == [["below", "endless"]]  # 40 sources of "g" in three parts
    wanted = tree.select("graph", "source", F.col("node").alias("goal")).unionByName(spark.createDataFrame([("g", "a0", "none"), ("g", None, "a0"), ("alone", "a0", "a0")], "graph string, source string, goal string"))
    ways = _ways(gr.paths(tree, wanted))
    assert len(ways) == len(plain) and not doubled and all(len(w[-1]) == w[-2] + 1 and w[-1][0] == w[1] and w[-1][-1] == w[2] for w in ways)
    monkeypatch.setattr(gr, "HELD", 5)
    assert _told(gr.cheapest(edges, sources).fillna("", "previous")) == plain and rounds[1] == ["below", "endless", "g", "h"]
    assert _ways(gr.paths(tree, wanted)) == ways and doubled


def test_sources_without_a_place(spark):
    edges = spark.createDataFrame([("g", 1, 2, 1.0)], "graph string, from long, to long, cost double")
    sources = spark.createDataFrame([("g", None), (None, 1), ("g", 7), ("g", 1)], "graph string, node long")
    none = lambda tree: {tuple(r) for r in tree.collect()}
    assert none(gr.cheapest(edges, sources)) == none(gr.shortest_paths(edges, sources))
    assert gr.cheapest(edges.limit(0), sources.limit(0)).count() == 0


def test_ways_in_batches(spark, monkeypatch):
    monkeypatch.setattr(held, "_NODES", 10)
    names = ["graph", "source", "goal", "cost", "hops", "nodes"]
    rows = pa.RecordBatch.from_pydict({"node": [*range(9), 8, 0, 3, 77], "cost": [float(i) for i in range(9)] + [None] * 4, "hops": pa.array([*range(9)] + [None] * 4, pa.int32()), "previous": [None, *range(8)] + [None] * 4})
    out = list(held.walker(names)((pa.scalar("g"), pa.scalar(0)), iter([rows])))
    assert [b.column(5).to_pylist() for b in out] == [[[0], [0, 1, 2, 3]], [list(range(9))]]


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(2)
    values = [0.0000000005, 0.1234567895, 2.0000000015, 1234567.1234567895, 0.1 + 0.2, 8388607.123456789, 1e300, math.inf, 5e-324] + [rng.random() * 10 ** rng.randrange(-9, 9) for _ in range(2000)]
    values += [round(rng.random() * 10 ** rng.randrange(0, 7), 9) + 5e-10 for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.round("v", 9).alias("r")).collect()
    assert [r.v for r in rows if held.nine(r.v) != r.r] == []


def test_express_routes_without_rounds(spark, sf_dir, monkeypatch):
    """It wrote two tables a round, and 18 rounds at the least."""
    kept, stored = [], gr.stored
    monkeypatch.setattr(gr, "stored", lambda df, folder: kept.append(folder) or stored(df, folder))
    found = catalog.queries()["express_routes"](spark, sf_dir)
    assert found.count() == catalog.queries()["express_costs"](spark, sf_dir).count() > 0
    assert not [f for f in kept if "/round=" in f]


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    edges = spark.range(48).select(F.col("id").alias("from"), (F.col("id") + 1).alias("to")).where("from <> 20")
    got = {r.node: r.component for r in gr.components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 if i <= 48 else i for i in range(60)}


def test_components_in_few_rounds_of_known_size(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(gr, "cut", lambda df: cuts.append(shared.cut(df)) or cuts[-1])
    order = [i * 89 % 240 for i in range(240)]  # neighbours on the chain are far apart by number
    edges = spark.createDataFrame(list(zip(order, order[1:])), "from long, to long")
    found = gr.components(spark.range(240).select(F.col("id").alias("node")), edges)
    assert {r.component for r in found.collect()} == {0} and len(cuts) < 32
    # the plan's estimate is that of the rows, not the product of all that was joined
    assert all(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 30 for df in cuts)


def test_kruskal_stops_at_the_target(spark):
    e = [("g", a, b, s) for a, b, s in (("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.5), ("d", "e", 4.0), ("c", "d", 3.0))]
    edges = spark.createDataFrame(e, "graph string, from string, to string, score double")
    n = spark.createDataFrame([("g", 5)], "graph string, nodes int")
    taken = lambda k: sorted((r["from"], r["to"]) for r in fo.spanning_forest(edges, n, k).collect())
    assert taken(1) == [("a", "b"), ("a", "c"), ("c", "d"), ("d", "e")] and taken(3) == [("a", "b"), ("a", "c")]


def test_chain_and_clique(spark):
    doors = spark.createDataFrame([("p", 3, "c"), ("p", 1, "a"), ("p", 2, "b"), ("q", 1, "x")], "platform string, ord int, node string")
    assert sorted((r["from"], r["to"]) for r in gr.chain_edges(doors, "platform", ["ord", "node"], "node", "walk").collect()) == [("a", "b"), ("b", "c")]
    assert sorted((r["from"], r["to"]) for r in gr.clique_edges(doors, ["platform"], "node", "lift").collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def ring(*points):
    return F.array(*[rg.point(F.lit(x), F.lit(y)) for x, y in points])


SQUARE = ((0, 0), (4, 0), (4, 4), (0, 4))


def test_rings(spark):
    square = ring(*SQUARE)
    r = one(spark, g.ring_area(square), g.signed_area(square), g.ring_centroid(square), g.signed_area(g.wound(square, clockwise=True)))
    assert (r.c0, r.c1, r.c2.asDict(), r.c3) == (16.0, 16.0, {"x": 2.0, "y": 2.0}, -16.0)
    edges = lambda p: F.aggregate(F.zip_with(square, g.rotated(square), lambda a, b: g.crosses_upward_ray(p, (a["x"], a["y"]), (b["x"], b["y"])).cast("int")), F.lit(0), lambda s, x: s + x) % 2
    r = one(spark, edges((F.lit(3.0), F.lit(3.0))), edges((F.lit(5.0), F.lit(1.0))))
    assert (r.c0, r.c1) == (1, 0)


def test_ring_edits(spark):
    square = ring(*SQUARE)
    first, second = rg.split_by_vertices(square, F.lit(0), F.lit(2))
    bad, _ = rg.split_by_vertices(square, F.lit(0), F.lit(1))
    repeated = ring((0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 4), (0, 0))
    r = one(
        spark, g.ring_area(first), g.ring_area(second), bad, rg.move_vertex(square, F.lit(9), rg.point(F.lit(1), F.lit(1))), F.size(rg.insert_vertex(square, F.lit(3), rg.point(F.lit(0), F.lit(2)))),
        rg.without_repeats(repeated) == square, F.size(rg.cyclic_path(square, F.lit(3), F.lit(1))), rg.thinned(F.array(*[F.lit(x) for x in (0.5, 0.1, 0.10005, 0.1002)]), F.lit(1e-4)),
    )
    assert (r.c0, r.c1, r.c2, r.c3, r.c4, r.c5, r.c6, r.c7) == (8.0, 8.0, None, None, 5, True, 3, [0.1, 0.1002, 0.5])


def test_segments(spark):
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    r = one(
        spark, g.point_segment_distance(p(0, 5), p(0, 0), p(4, 0)), g.point_segment_distance(p(7, 4), p(0, 0), p(4, 0)), g.point_segment_distance(p(3, 4), p(0, 0), p(0, 0)),
        g.segments_cross(p(0, 0), p(4, 4), p(0, 4), p(4, 0)), g.segments_cross(p(0, 0), p(1, 1), p(0, 4), p(4, 0)), g.segment_distance(p(0, 0), p(0, 4), p(3, 0), p(3, 9)),
    )
    assert tuple(r) == (5.0, 5.0, 5.0, True, False, 3.0)


@pytest.mark.parametrize(("layer", "explicit", "z"), [("B2", None, -10.0), ("B2", -7.0, -7.0), ("B1", None, -5.0), ("3F", None, 10.0), ("OUTSIDE", None, 0.0)])
def test_layer_heights(spark, layer, explicit, z):
    assert one(spark, g.layer_z(F.lit(layer), F.lit(explicit).cast("double"), 5.0)).c0 == z


def test_text(spark):
    r = one(
        spark, tx.name_tokens(F.lit("X （Y）")), tx.name_key(F.lit(" Old Town Station"), "station"), tx.safe_part(F.lit("a b/ñ!")), tx.safe_part(F.lit("//")), tx.url_part(F.lit("a b/ñ")),
        tx.preferences(F.lit("both")), tx.preferences(F.lit("elevator,elevator")), tx.preferences(F.lit("bus")), tx.toilet_subtypes(F.lit("male")), tx.toilet_subtypes(F.lit("any")),
        tx.xml_error(F.lit("<e><m>bad key</m><c></c><r>30</r></e>"), ("m", "c", "r")),
    )
    assert list(r) == [["x(y)", "y", "x"], "oldtown", "a_b_ñ", "unknown", "a%20b%2F%C3%B1", ["none", "elevator"], ["elevator"], ["none"], ["male", "both"], None, "bad key / 30"]


@pytest.mark.parametrize(("number", "text"), [(1.5, "1.5"), (2.0, "2"), (-0.0, "0"), (0.1234567, "0.123457"), (3, "3"), (100.0, "100")])
def test_compact_numbers(spark, number, text):
    assert one(spark, tx.compact_number(F.lit(number))).c0 == text


def test_doors(spark):
    car, door = tx.door_parts(F.lit("3 - 2"))
    bad, _ = tx.door_parts(F.lit("x"))
    back = tx.ordinal_door(F.lit(10), 4)
    r = one(spark, tx.door_ordinal(car, door, 4), bad, *back)
    assert tuple(r) == (10, None, 3, 2)


def test_axis_fits(spark):
    rows = [("x", 0.0, 1.0), ("x", 1.0, 3.0), ("y", 0.0, 2.0), ("y", 0.0, 2.0), ("one", 1.0, 4.0), ("none", None, None), ("down", 0.0, 4.0), ("down", 2.0, 0.0)]
    out = {r.k: (r.method, r.scale, r.offset) for r in ag.axis_fit(spark.createDataFrame(rows, "k string, s double, t double"), "k", "s", "t").collect()}
    assert out == {"x": ("scale_translate", 2.0, 1.0), "y": ("translation", 1.0, 2.0), "one": ("translation", 1.0, 3.0), "none": ("identity", 1.0, 0.0), "down": ("scale_translate", 2.0, 0.0)}


def test_weighted_mean_and_dominant(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0, "r", 1), ("a", 3.0, 4.0, "b", 2), ("z", 0.0, 1.0, "q", 1), ("z", 0.0, 3.0, "p", 2)], "k string, w double, x double, colour string, ord int")
    assert {r.k: r.m for r in rows.groupBy("k").agg(ag.weighted_mean(F.col("x"), F.col("w")).alias("m")).collect()} == {"a": 3.0, "z": 2.0}
    assert {r.k: r.colour for r in ag.dominant(rows, "k", "colour", F.col("w"), F.col("ord")).collect()} == {"a": "b", "z": "q"}


def test_first_seen(spark):
    rows = spark.createDataFrame([("e", 3, "b", "x"), ("e", 1, "a", "y"), ("e", 2, "b", None), ("e", 4, "a", "x")], "k string, ord int, kind string, tag string")
    r = ag.first_seen(rows, ["k"], F.col("ord"), ["tag"], ["kind"]).first()
    assert (r.tag, r.n_records, r.kind_seen) == ("y", 4, ["a", "b"])


def test_optional_filters(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "id int, line string, car int")
    q = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 9), (4, "b", None)], "req int, l string, c int")
    out = {r.req: (r.n_matches, r.status, r.id) for r in lk.resolve_optional(q, t, "req", "id", {"l": "line", "c": "car"}).collect()}
    assert out == {1: (1, "ok", 1), 2: (2, "ambiguous", None), 3: (0, "none", None), 4: (1, "ok", 3)}


def test_exit_choice(spark):
    exits = spark.createDataFrame([("3", "N0005", "exit"), ("3", "N0002", "exit_elevator")], "number string, key string, type string")
    pick = lambda elevator: lk.first_by(exits, ["number"], [F.when((F.col("type") == "exit_elevator") == elevator, 0).otherwise(1), F.col("key")]).first().key
    assert (pick(False), pick(True)) == ("N0005", "N0002")


def test_overlap_suppression(spark):
    boxes = spark.createDataFrame([("i", k, x, 0.0, 10.0, 10.0, s) for k, x, s in ((1, 0.0, 0.9), (2, 5.0, 0.8), (3, 4.0, 0.7))], "image string, id int, x double, y double, w double, h double, score double")
    assert sorted(r.id for r in cl.suppress_overlaps(boxes, "image").collect()) == [1, 2]


def test_degenerate_homography(spark):
    flat = [("f", k, float(k), 0.0, float(k), 1.0) for k in range(4)]
    assert cl.homographies(spark.createDataFrame(flat, "g string, ord int, x double, y double, u double, v double"), "g").first().matrix is None


def test_masks(spark):
    square = [("m", x, y) for x in range(2, 7) for y in range(2, 7)]
    mask = spark.createDataFrame([*square, ("m", 12, 12), ("m", 13, 13), ("n", 0, 0)], "image string, x int, y int")
    assert rs.opened(mask, 3, 20, 20).where("image = 'm'").count() == 25
    assert rs.dilate(mask, 3, 20, 20).where("image = 'n'").count() == 4
    assert sorted((r.image, r.area) for r in rs.mask_components(mask).collect()) == [("m", 2), ("m", 25), ("n", 1)]
    holed = mask.where("not (x = 4 and y = 4)")
    assert rs.closed(holed, 3, 20, 20).where("image = 'm' and x = 4 and y = 4").count() == 1


def test_snapping(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 10.0), (3, 500.0, 500.0)], "p int, x double, y double")
    v = spark.createDataFrame([(7, 0.0, 0.0), (8, 100.0, 0.0)], "v int, vx double, vy double")
    e = spark.createDataFrame([(9, 0.0, 0.0, 100.0, 0.0)], "e int, ax double, ay double, bx double, by double")
    c = F.col
    out = sp.snap(points, v, e, "p", (c("x"), c("y")), "v", (c("vx"), c("vy")), "e", (c("ax"), c("ay")), (c("bx"), c("by")), 30.0, 22.0)
    assert {r.p: (r.source, r.target) for r in out.collect()} == {1: ("vertex", 7), 2: ("edge", 9), 3: ("free", None)}


def test_nearest_in_range_chooses_within_a_row(spark):
    rows = spark.createDataFrame([(i, float(i % 9)) for i in range(60)], "k int, v double")
    near = sp.nearest_in_range(rows, "k", "v", 2.0, 3)
    by = {i: sorted((abs(i % 9 - j % 9), j) for j in range(60) if j != i and abs(i % 9 - j % 9) <= 2)[:3] for i in range(60)}
    assert {(r.k, r["rank"]): (r.distance, r.other) for r in near.collect()} == {(i, n + 1): (float(d), j) for i, found in by.items() for n, (d, j) in enumerate(found)}
    assert "windowspecdefinition(k#" not in near._jdf.queryExecution().optimizedPlan().toString()  # no exchange of all candidates


def test_nearest_box_meets_few_of_many_around(spark, monkeypatch):
    met, close = [], sp._close
    monkeypatch.setattr(sp, "_close", lambda *args: met.append(close(*args)) or met[-1])
    points = spark.range(400).select("id", (F.col("id") % 200 * 1.0).alias("x"), F.lit(0.0).alias("y"))
    boxes = spark.range(8000).select(F.col("id").alias("b"), (-F.col("id") - 1.0).alias("x0"), F.lit(-1.0).alias("y0"), F.when(F.col("id") == 5, -0.5).otherwise(150.0 + F.col("id") % 7).alias("x1"), F.lit(1.0).alias("y1"))
    got = {r.id: (r.b, r.distance) for r in sp.nearest_box(points, boxes, "id", (F.col("x"), F.col("y")), "b", ("x0", "y0", "x1", "y1")).collect()}
    of = lambda x: (0, 0.0) if x <= 150 else (x - 150, 0.0) if x - 150 < 5 else (6, max(0.0, x - 156.0))  # noqa: E731  the fifth ends before all
    assert got == {i: of(i % 200) for i in range(400)}
    assert sum(df.count() for df in met) < 600000  # of 3,200,000 pairs


def test_snapping_asks_edges_only_where_no_vertex_is(spark, monkeypatch):
    met, reached = [], sp._reached
    monkeypatch.setattr(sp, "_reached", lambda *args: met.append(reached(*args)) or met[-1])
    points = spark.range(500).select("id", (F.col("id") * 2.0).alias("x"), F.when(F.col("id") < 400, F.col("id") * 2.0 + 1).otherwise(0.0).alias("y"))
    vertices = spark.range(350).select(F.col("id").alias("v"), (F.col("id") * 2.0).alias("vx"), (F.col("id") * 2.0).alias("vy"))
    edges = spark.createDataFrame([(k, 0.0, k / 4, 1000.0, 1000 + k / 4) for k in range(4)], "e int, ax double, ay double, bx double, by double")
    c = F.col
    out = sp.snap(points, vertices, edges, "id", (c("x"), c("y")), "v", (c("vx"), c("vy")), "e", (c("ax"), c("ay")), (c("bx"), c("by")), 1.2, 5.0)
    assert {r.id: (r.source, r.target) for r in out.collect()} == {i: ("vertex", i) if i < 350 else ("edge", 3) if i < 400 else ("free", None) for i in range(500)}
    assert sum(df.count() for df in met) < 150 * 4 * 3  # pieces about 50 places, not 500 times the boxes of all edges


def test_nearest_box_far_away_and_without_boxes(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 90000.0, -70000.0), (3, None, 1.0)], "p int, x double, y double")
    boxes = spark.createDataFrame([(5, 10.0, 10.0, 12.0, 12.0), (6, 89000.0, -70000.0, 89001.0, -69000.0)], "b int, x0 double, y0 double, x1 double, y1 double")
    near = lambda b: {r.p: r.b for r in sp.nearest_box(points, b, "p", (F.col("x"), F.col("y")), "b", ("x0", "y0", "x1", "y1")).collect()}
    assert near(boxes) == {1: 5, 2: 6, 3: None} and near(boxes.limit(0)) == {1: None, 2: None, 3: None}


def test_nearest_box_ends_for_coordinates_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    points = spark.createDataFrame([(1, nan, 0.0), (2, 1.0, inf), (3, -inf, nan), (4, 11.0, 11.0)], "p int, x double, y double")
    boxes = spark.createDataFrame([(5, 10.0, 10.0, 12.0, 12.0), (6, nan, 0.0, 1.0, 1.0), (7, None, None, None, None), (8, 0.0, 0.0, inf, 1.0)], "b int, x0 double, y0 double, x1 double, y1 double")
    near = lambda b: {r.p: r.b for r in sp.nearest_box(points, b, "p", (F.col("x"), F.col("y")), "b", ("x0", "y0", "x1", "y1")).collect()}
    assert near(boxes) == {1: None, 2: None, 3: None, 4: 5} and near(boxes.where("b = 7")) == {1: None, 2: None, 3: None, 4: None}


def test_interpolation_is_clamped(spark):
    grid = spark.createDataFrame([("u", float(x)) for x in (-1, 0, 1, 3, 9)], "k string, place double")
    anchors = spark.createDataFrame([("u", 0.0, 0.0), ("u", 2.0, 4.0), ("u", 4.0, 4.0)], "k string, place double, v double")
    assert {r.place: r.v for r in sp.interpolate(grid, anchors, "k", "place", "v").collect()} == {-1.0: 0.0, 0.0: 0.0, 1.0: 2.0, 3.0: 4.0, 9.0: 4.0}


def test_shifts_are_fed_back(spark):
    rows = [("g", 1, "a", 1.0, 1.0, "b", 0.0, 0.0, ["b"]), ("g", 2, "b", 5.0, 5.0, "c", 5.0, 5.0, ["c", "b"]), ("g", 3, "a", None, 1.0, "b", 0.0, 0.0, ["b"]), ("g", 4, "a", 0.0, 0.0, "b", 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "k string, ord int, reference string, rx double, ry double, moving string, mx double, my double, polygons array<string>")
    # the second correction takes b where the first has put it
    assert {r.polygon_id: (r.dx, r.dy) for r in ag.local_shifts(df, "k").collect()} == {"b": (2.0, 2.0), "c": (1.0, 1.0)}


def test_merge_needs_two_polygons(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [("one", 0, square), ("two", 0, square), ("two", 1, [(x + 5, y) for x, y in square]), ("flat", 0, square), ("flat", 1, [(9.0, 9.0)])]
    df = spark.createDataFrame(rows, "k string, ord int, ring array<struct<x: double, y: double>>")
    out = {r.k: r.ring for r in sc.auto_merge(df, "k").collect()}
    assert out.keys() == {"two"} and {(p.x, p.y) for p in out["two"]} == set(square) | {(x + 5, y) for x, y in square}


def test_paths_below_roots(spark):
    cases = {"/out/x": True, "/out": True, "/outer": False, "/out/../x": False, "/../../out/./a//b": True, "out/x": False, None: False, "": False, "/": False}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.ok for r in df.select("p", tx.within_roots(F.col("p"), ("/out/", "/data")).alias("ok")).collect()} == cases


def test_closest_pairs_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, 100 * i + k, rng.choice([rng.uniform(0, 900), 7.0]), rng.uniform(0, 5)) for i, g in enumerate("abcd") for k in range(40)]
    rows += [("a", 900, 7.0, 1.0), ("b", 901, 7.0, 1.0), ("b", 902, 7.0, 1.0), ("c", 903, float("nan"), 1.0), ("c", 904, None, 1.0), ("c", 905, 1.0, float("inf"))]
    rows += [("far", 990, 3e4, 1e4), ("null", 991, None, None), (None, 992, 1.0, 1.0)]
    pairs = [("a", "b"), ("b", "a"), ("c", "d"), ("a", "far"), ("a", "null"), ("a", "nobody"), (None, "a"), ("a", "a")]
    points = spark.createDataFrame(rows, "g string, id long, x double, y double")
    neighbours = spark.createDataFrame(pairs, "by_a string, by_b string")
    sound = [r for r in rows if r[0] and all(v is not None and math.isfinite(v) for v in r[2:])]
    expected = {}
    for a, b in pairs:
        found = [(round(math.dist(p[2:], q[2:]), 9), p[1], q[1]) for p in sound for q in sound if (p[0], q[0]) == (a, b)]
        if found:
            expected[a, b] = min(found)
    out = sp.closest_pairs(points, "g", "id", "x", "y", neighbours).collect()
    assert {(r.by_a, r.by_b): (r.distance, r.a, r.b) for r in out} == expected and len(out) == len(expected)
    assert sp.closest_pairs(points.limit(0), "g", "id", "x", "y", neighbours).count() == 0
