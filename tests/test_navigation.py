"""The graph builder on one station worked out by hand, and dense numbers."""

import random

import pytest
from pyspark.sql import functions as F

from floorgraph.operators import navigation as nv
from floorgraph.plans import stations

RING = "array<struct<x: double, y: double>>"
CONNECTIONS = "graph string, connection_id string, type string, asset_type string, exit_number string, bidirectional boolean, from_layer string, from_polygon string, from_position array<double>, to_layer string, to_polygon string, to_position array<double>"
ASSETS = "graph string, asset_id string, label string, type string, layer string, polygon_id string, location array<double>, rotation_z double, facing array<double>, public_side array<double>, paid_side array<double>, cost double"
PLATFORMS = "graph string, platform_id string, layer string, polygon_id string, ord int, node_id string, position array<double>, car_door string"
ELEVATORS = "graph string, elevator_id string, elevator_point_id string, ord int, layer string, polygon_id string, position array<double>, facing_angle double, facing array<double>, exit boolean, exit_number string"
ZONES = f"graph string, zone_id string, zone_type string, layer string, ord int, ring {RING}"


@pytest.fixture(scope="module")
def graph(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    connections = [
        ("s", "c1", "stair", None, None, None, "B1", "p", [0.0, 0.0, -5.0], "B2", "q", [3.0, 4.0, -5.0]), ("s", "c2", "exit_stair", "stair", "1", None, "B1", "p", [1.0, 1.0, 0.0], "OUTSIDE", None, [9.0, 9.0, 5.0]),
        ("s", "c3", "exit_escalator", None, "2", None, "OUTSIDE", "p", [1.0, 1.0, 0.0], "B1", "q", [2.0, 2.0, 5.0]), ("s", "c4", "exit_stair", None, "3", None, "B1", None, [0.0, 0.0, 7.0], "B1", None, [0.5, 0.5, 6.0]),
        ("s", None, "stair", None, None, None, "B1", None, [0.0], "B1", None, [0.0]), ("s", "c5", "stair", None, None, None, "B1", None, None, "B1", None, [0.0]), ("t", "c1", "stair", None, None, False, None, None, [0.0, 0.0], None, None, [0.0, 2.0]),
    ]
    assets = [
        ("s", "g1", None, "ticket_gate", "B1", None, [5.0, 5.0, 0.0], 90.0, None, [5.0, 0.0], None, None), ("s", "g2", None, "ticket_gate", "B1", None, [8.0, 5.0], 0.0, None, [0.0, 5.0], [0.0, 5.0], 3.0),
        ("s", None, "wc", "toilet", "B1", "p", [2.0, 2.0], None, [2.0, 9.0], None, None, None), ("s", "x", None, "exit", "B1", None, [0.0, 0.0], None, None, None, None, 4.0), ("s", "tr", None, "subway", "B2", None, [20.0, 20.0], None, None, None, None, None),
        ("s", "no", None, "bench", "B1", None, [0.0, 0.0], None, None, None, None, None), ("s", "nowhere", None, "exit", "B1", None, None, None, None, None, None, None),
    ]
    platforms = [("s", "pl", "B2", "q", k, f"d{k}", [float(3 * k), 0.0, -5.0], f"1-{k}") for k in (2, 0, 1)] + [("s", "pl", "B2", "q", 3, None, [9.0, 9.0], None)]
    elevators = [("s", "e", f"e{k}", k, f"B{k}", None, [0.0, 0.0, -5.0 * k], 0.0, None, None, None) for k in (1, 2, 3)] + [("s", "e", "out", 4, "B1", None, [1.0, 1.0], None, [1.0, 5.0], True, "5")]
    zones = [("s", "z1", "paid", "B1", 1, square(1.5, 1.5, 3.0)), ("s", "z0", "staff", "B1", 2, square(0.9, 0.9, 9.0)), ("t", "z9", "paid", None, 0, square(-1.0, 1.0, 3.0))]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes, edges = nv.build_graph(make(connections, CONNECTIONS), make(assets, ASSETS), make(platforms, PLATFORMS), make(elevators, ELEVATORS), make(zones, ZONES))
    return {(r.graph, r.node_id): r for r in nodes.collect()}, {(r.graph, r.edge_id): r for r in edges.collect()}


def test_nodes_of_all_kinds(graph):
    nodes, _ = graph
    kinds = {i: r.type for (g, i), r in nodes.items() if g == "s"}
    assert kinds == {
        "c1_from": "connector", "c1_to": "connector", "c2_from": "exit", "c3_to": "exit", "c4_to": "exit", "g1_front_node": "gate", "g1_back_node": "gate", "g2_front_node": "gate", "g2_back_node": "gate", "wc_node": "poi",
        "x_node": "exit", "tr_node": "asset", "d0": "platform_position", "d1": "platform_position", "d2": "platform_position", "e1_node": "elevator", "e2_node": "elevator", "e3_node": "elevator", "out_node": "exit_elevator",
    }
    at = lambda i: [round(v, 9) for v in nodes["s", i].position]
    assert at("g1_front_node") == [5.0, 4.0, 0.0] and at("g1_back_node") == [5.0, 6.0, 0.0] and at("g2_front_node") == [9.0, 5.0, 0.0]  # the paid side beats the public one
    assert at("wc_node") == [2.0, 2.4, 0.0] and at("e2_node") == [0.4, 0.0, -10.0] and at("out_node") == [1.0, 1.4, 0.0]
    zone = lambda i, g="s": (nodes[g, i].zone_type, nodes[g, i].zone_id)
    assert zone("wc_node") == ("paid", "z1") and zone("c2_from") == ("staff", "z0") and zone("tr_node") == ("public", None) and zone("g1_back_node") == ("paid", "g1_back")
    assert zone("c1_to", "t") == ("paid", "z9") and zone("c1_from", "t") == ("public", None)
    for g in "st":
        ids = sorted(i for h, i in nodes if h == g)
        assert [nodes[g, i].node_key for i in ids] == list(range(1, len(ids) + 1)) and nodes[g, ids[0]].node_key_str == "N0001"
    assert nodes["s", "out_node"].exit_number == "5" and nodes["s", "c2_from"].exit_number == "1"


def test_edges_of_all_kinds(graph):
    _, edges = graph
    got = {k: (r["from"], r["to"], r.type, r.connector_type, round(r.cost, 9), r.bidirectional) for k, r in edges.items()}
    assert got == {
        ("s", "c1_edge"): ("c1_from", "c1_to", "vertical", "stair", 5.0, True), ("t", "c1_edge"): ("c1_from", "c1_to", "vertical", "stair", 2.0, False),
        ("s", "g1_gate_crossing"): ("g1_front_node", "g1_back_node", "gate_crossing", None, 10.0, True), ("s", "g2_gate_crossing"): ("g2_front_node", "g2_back_node", "gate_crossing", None, 3.0, True),
        ("s", "d0_to_d1"): ("d0", "d1", "platform_walk", None, 3.0, True), ("s", "d1_to_d2"): ("d1", "d2", "platform_walk", None, 3.0, True),
        **{("s", f"e_{a}_to_{b}"): (f"e{a}_node", f"e{b}_node", "elevator", None, 5.0 * (b - a), True) for a, b in ((1, 2), (1, 3), (2, 3))},
    }


def test_dense_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(300)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    out = {}
    for r in nv.numbered(df, "g", ["v"]).collect():
        out.setdefault(r.g, []).append((r.number, r.v))
    for g, found in out.items():
        values = sorted(v for h, v in rows if h == g)
        assert [n for n, _ in sorted(found)] == list(range(1, len(values) + 1)) and [v for _, v in sorted(found)] == values
    assert nv.numbered(df.where(F.lit(False)), "g", ["v"]).count() == 0


def test_nodes_take_one_wide_exchange(spark, monkeypatch):
    written, cut = [], nv.cut
    square = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    monkeypatch.setattr(nv, "cut", lambda df: written.append(df) or cut(df))
    points = spark.range(40).select(F.lit("s").alias("graph"), F.lit("pl").alias("platform_id"), F.lit("B1").alias("layer"), F.lit("q").alias("polygon_id"), F.col("id").alias("ord"), F.format_string("d%02d", "id").alias("node_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("position"), F.lit("1").alias("car_door"))
    zones = spark.createDataFrame([("s", f"z{k}", "paid", "B1", k, square(5.0, 1.0, float(k))) for k in (2, 3)] + [("t", "z9", "paid", "B1", 0, square(5.0, 1.0, 9.0))], ZONES)
    nothing = [spark.createDataFrame([], schema) for schema in (CONNECTIONS, ASSETS, ELEVATORS)]
    nodes, _ = nv.build_graph(nothing[0], nothing[1], points, nothing[2], zones)
    got = {r.node_id: (r.zone_id, r.node_key) for r in nodes.collect()}
    assert len(got) == 40 and all(got[f"d{k:02}"][1] == k + 1 for k in range(40))
    assert got["d04"][0] == "z2" and got["d35"][0] is None and {z for z, _ in got.values()} <= {"z2", "z3", None}
    # the nodes are written once, behind a range exchange, and again for nothing; their zones and numbers come without another exchange
    wide = [df._jdf.queryExecution().executedPlan().toString() for df in written if "position" in df.columns]
    assert len(wide) == 1 and wide[0].count("Exchange rangepartitioning") == 1
    assert "Join" not in wide[0].split("Exchange rangepartitioning")[0]
    joined = nodes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined and "SortMergeJoin" not in joined


def test_edges_write_no_nodes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(nv, "cut", lambda df: pytest.fail("nodes were written for edges"))
    assert stations.station_edges(spark, sf_dir).where("type = 'vertical'").limit(1).count() == 1
