"""Requests and exports over a small two-level station."""

import pytest
from pyspark.sql import functions as F

from floorgraph import catalog
from floorgraph.operators import routing
from floorgraph.sources import packages, schemas
from tests.test_sources import write_package


def node(i, kind, layer, polygon, at, zone, zone_id=None, zone_label=None, **more):
    return {"node_id": i, "type": kind, "layer": layer, "polygon_id": polygon, "position": list(map(float, at)), "zone_type": zone, "zone_id": zone_id, "zone_label": zone_label, **more}


NODES = [
    node("A", "platform_position", "B1", "p1", (0, 0, 0), "paid", "z1", "z1", platform_id="P", car=1, car_door="1-1", line_id="1", direction="up"),
    node("B", "connector", "B1", "p1", (3, 4, 0), "paid", "z1", "z1", connector_type="stair"), node("C", "connector", "B2", "p2", (3, 4, -5), "paid", "z1", "z1"),
    node("D", "gate", "B2", "p2", (6, 8, -5), "paid", "g_back", "z1", gate_type="wide"), node("E", "gate", "B2", "p2", (6, 10, -5), "public", "g_front"),
    node("F", "exit", "B2", "p2", (6, 13, -5), None, exit_number="3"), node("T", "poi", "B2", "p2", (6, 14, -5), None, poi_type="toilet", toilet_gender="female", label="WC north"),
    node("U", "poi", "B2", "p2", (6, 33, -5), None, poi_type="toilet", label="WC south"),
    node("Q", "platform_position", "B1", "p9", (50, 0, 0), "paid", "z1", "z1", platform_id="R", car=1, car_door="1-1", line_id="2", direction="down"),
]
EDGES = [
    {"edge_id": "bc", "from": "B", "to": "C", "type": "vertical", "connector_type": "stair", "cost": 10}, {"edge_id": "ac", "from": "A", "to": "C", "type": "elevator", "cost": 10},
    {"edge_id": "de", "from": "D", "to": "E", "type": "gate_crossing", "cost": 10},
]


@pytest.fixture(scope="module")
def station(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("packages")
    write_package(root, "s1", "v1", NODES, EDGES)
    write_package(root, "s2", "v1", NODES[:6], EDGES)
    read = packages.read_packages(spark, str(root))
    tables = {k: t.cache() for k, t in packages.index_tables(read).items()}
    return tables, read["nodes"].cache(), read["edges"].cache()


def ask(spark, *requests):
    fields = ("type", "line_id", "direction", "platform_id", "car", "exit_number", "facility_type", "facility_subtype", "label", "node")
    end = lambda e: tuple(e.get(f) for f in fields)
    rows = [(i, r.get("station", "s1"), end(r["start"]), end(r["goal"]), r.get("pref"), r.get("toilet", False), r.get("gender")) for i, r in enumerate(requests)]
    return spark.createDataFrame(rows, schemas.ROUTE_REQUEST).withColumn("version", F.lit("v1"))


PLATFORM, EXIT = {"type": "platform", "line_id": "1"}, {"type": "exit", "exit_number": "3"}


def test_answers(spark, station):
    out = {
        r.request_id: r
        for r in routing.answer(
            ask(
                spark,
                {"start": PLATFORM, "goal": EXIT}, {"start": PLATFORM, "goal": EXIT, "pref": "elevator"}, {"start": {"node": "N0002"}, "goal": {"node": "4"}},
                {"start": {"type": "platform"}, "goal": EXIT}, {"start": {"type": "platform", "line_id": "9"}, "goal": EXIT}, {"start": PLATFORM, "goal": {"type": "platform", "line_id": "2"}},
                {"start": {"node": "D"}, "goal": EXIT, "toilet": True, "gender": "any"}, {"start": {"node": "D"}, "goal": EXIT, "toilet": True, "gender": "male"},
                {"start": {"node": "F"}, "goal": {"type": "facility", "facility_type": "toilet"}}, {"start": {"node": "F"}, "goal": {"type": "facility", "facility_type": "toilet", "label": "SOUTH"}},
                {"start": {"node": "A"}, "goal": EXIT, "pref": "bus", "station": "s2"},
            ),
            *station,
        ).collect()
    }
    assert [out[i].status for i in range(11)] == ["ok", "ok", "ok", "start_ambiguous", "start_none", "no_route", "ok", "ok", "goal_ambiguous", "ok", "ok"]
    assert (out[0].cost, "".join(out[0].nodes)) == (1033.0, "ABCDEF")
    assert (out[1].cost, "".join(out[1].nodes)) == (1019.5, "ACDEF")
    assert out[0].zones == ["paid"] * 4 + ["public"] * 2
    assert "".join(out[2].nodes) == "BCD"
    assert (out[6].waypoint, "".join(out[6].nodes)) == ("T", "DETF") and out[6].cost == 1010 + 4 + 1
    assert out[7].waypoint == "U" and out[9].nodes == ["F", "U"] and out[10].cost == 1033.0


def test_export(spark, station):
    made = routing.export_edges(*station, route_preference="both")
    edges = {(r.station_id, r.edge_id): r for r in made["edges"].collect()}
    assert {r.preference: (r.pairs, r.routed, r.failed) for r in made["summary"].collect()} == {"none": (8, 4, 4), "elevator": (8, 4, 4)}
    gate = next(r for k, r in edges.items() if k[0] == "s1" and set(k[1].split("_")) == {"N0004", "N0005"})
    assert gate.used_by_count == 4 and gate.pair_types == ["exit_platform", "platform_exit"] and sorted(gate.preferences) == ["elevator", "none"]
    assert len([k for k in edges if k[0] == "s1"]) == 6


def test_videos(spark):
    route = spark.createDataFrame([("a", "N1", "N2", None), ("b", "N3", "N2", "stair"), ("c", "N8", "N9", "elevator"), ("d", "N8", "N7", None)], "edge string, a_key string, b_key string, mode string")
    videos = spark.createDataFrame([("s 1", "N1_N2", "t1", None), ("s 1", "N2_N3", None, "http://v")], "station_id string, edge_id string, video_title string, url string")
    out = {r.edge: (r.video, r.found_by, r.missing) for r in routing.match_videos(route, videos, "http://h/").collect()}
    assert out == {"a": ("http://h/videos/s_1/t1.mp4", "directed", False), "b": ("http://v", "sorted", False), "c": (None, "missing", False), "d": (None, "missing", True)}


def test_new_edges(spark):
    schema = "edge_id string, video_required boolean"
    current = spark.createDataFrame([("N1_N2", True), ("N2_N3", False), ("N4_N5", None)], schema)
    missing, skipped = routing.new_edges(current, spark.createDataFrame([("N1_N2", True)], schema))
    assert [r.edge_id for r in missing.collect()] == ["N4_N5"] and [r.edge_id for r in skipped.collect()] == ["N2_N3"]


def test_representatives_and_neighbours(spark):
    doors = spark.createDataFrame([("P", 1, f"d{i}", [x, 0.0, 0.0], i) for i, x in enumerate((0.0, 1.0, 5.0))], "platform string, car int, node string, position array<double>, ord int")
    r = routing.representatives(doors, ["platform", "car"], "position", "ord").first()
    assert (r.node, r.source_count) == ("d1", 3)
    stops = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", "1", "4"), ("x", "1", "n/a")], "station string, line string, seq string")
    assert {r.station: (r.before, r.after) for r in routing.line_neighbours(stops).collect()} == {"a": (None, "b"), "b": ("a", None), "c": (None, None)}


def test_pairs_of_all_ends_are_made_by_many_tasks(spark, sf_dir):
    from floorgraph import catalog

    pairs = catalog.queries()["od_pairs"](spark, sf_dir).where("pair_type = 'platform_platform'")
    assert len({r.p for r in pairs.select(F.spark_partition_id().alias("p")).collect()}) > 2


def test_pairs_take_little_disk(spark, sf_dir, tmp_path):
    """Written as they came, a pair took as many bits as there are digits in the number of suppliers, and more."""
    rows = spark.range(1_500).select((F.col("id") * 7_919).alias("s_suppkey"), (F.xxhash64("id") % 12 + 12).cast("int").alias("s_nationkey"))
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    catalog.queries()["od_pairs"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    per = [r["count"] for r in rows.groupBy("s_nationkey").count().collect()]
    exits = spark.read.parquet(f"{tmp_path}/nation.parquet").where("n_regionkey = 1").count()
    assert out.count() == out.distinct().count() == 1_500**2 - sum(n * n for n in per) + 2 * 1_500 * exits
    assert sum(f.stat().st_size for f in (tmp_path / "out").iterdir()) < 0.8 * out.count()
