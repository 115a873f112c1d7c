"""Scene records of hand-made shapes."""

import math

from floorgraph.operators import scene

POINTS = "polygon_id string, layer string, part int, ord int, x double, y double"


def square(spark, scale=100.0, reverse=False):
    ring = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2)]
    rows = [("p", "B2", 0, i, x * scale, y * scale) for i, (x, y) in enumerate(ring[::-1] if reverse else ring)] + [("p", "B2", 1, i, x * scale, y * scale) for i, (x, y) in enumerate(hole)]
    return spark.createDataFrame([*rows, ("q", "B1", 0, 0, 0.0, 0.0)], POINTS)


def test_planes(spark):
    schema = "polygon_id string, layer string, layer_z double, z_offset double, z_value double, r int, g int, b int"
    polygons = spark.createDataFrame([("p", "B2", None, 1.0, 2.0, 255, 0, 51), ("q", "B1", None, None, None, 0, 0, 0)], schema)
    for reverse in (False, True):
        out = scene.planes(polygons, scene.scene_points(square(spark, reverse=reverse))).collect()
        assert len(out) == 1
        plane = out[0]
        assert plane.name == "plane_p" and plane.color == [1.0, 0.0, 0.2, 1.0]
        assert {v[2] for v in plane.vertices} == {-9.0} and len(plane.holes) == 1
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(plane.vertices, plane.vertices[1:] + plane.vertices[:1], strict=True)) / 2
        assert area == 16.0
        assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(plane.holes[0], plane.holes[0][1:] + plane.holes[0][:1], strict=True)) / 2 == -1.0


def test_points_pass_the_chain_in_order(spark):
    points = spark.createDataFrame([("p", "B1", 100.0, 200.0), ("q", "B2", 100.0, 200.0), ("r", "B3", 100.0, 200.0)], "polygon_id string, layer string, x double, y double")
    layers = spark.createDataFrame([("B1", [2.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0])], "layer string, m array<double>")
    shifts = spark.createDataFrame([("p", 0.5, 0.0), ("q", 0.0, 3.0)], "polygon_id string, dx double, dy double")
    out = scene.scene_points(points, invert_y=True, layers=layers, shifts=shifts)
    assert {r.polygon_id: (r.x, r.y) for r in out.collect()} == {"p": (3.5, -4.0), "q": (1.0, 1.0), "r": (1.0, -2.0)}


def test_drawn_axes_are_made_right_angled(spark):
    schema = "polygon_id string, ox double, oy double, ux double, uy double, vx double, vy double"
    corrections = spark.createDataFrame([("p", 0.0, 0.0, 1.0, 0.0, 0.6, 0.8), ("q", 0.0, 0.0, 1.0, 0.0, 2.0, 0.0)], schema)
    points = spark.createDataFrame([("p", "B1", 160.0, 80.0), ("q", "B1", 160.0, 80.0)], "polygon_id string, layer string, x double, y double")
    out = {r.polygon_id: (round(r.x, 9), round(r.y, 9)) for r in scene.scene_points(points, corrections=corrections).collect()}
    assert out == {"p": (1.0, 1.0), "q": (1.6, 0.8)}  # a degenerate correction changes nothing


def test_walls(spark):
    walls = spark.createDataFrame([("w", 2, 3.0, 4.0), ("w", 1, 0.0, 0.0), ("w", 3, 3.0, 4.0), ("w", 4, 3.0, 10.0)], "wall_id string, ord int, x double, y double")
    out = [(r.segment, r.length, round(r.angle_deg, 4)) for r in scene.wall_segments(walls).orderBy("segment").collect()]
    assert out == [(1, 5.0, 53.1301), (2, 6.0, 90.0)]


def test_connections(spark):
    rows = [("c", "stair", 0.0, 0.0, 0.0, 10.0, 0.0, -5.0), ("d", "lift", 1.0, 1.0, -5.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "connection_id string, type string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    out = {r.connection_id: r for r in scene.connection_assets(df).collect()}
    assert {p[2] for p in out["c"].lower} == {-5.0} and abs(out["c"].rotation_deg) == 180.0 and out["c"].center == [5.0, 0.0, -2.5]
    assert out["d"].rise == 5.0 and math.dist(*out["d"].lower) == 1.0
    assets = spark.createDataFrame([("c", 1, "a1"), ("c", 2, "a2")], "connection_id string, ord int, asset_id string")
    assert {r.connection_id: r.asset_id for r in scene.attach_assets(df, assets).collect()} == {"c": "a2", "d": None}


def test_bands_and_layers(spark):
    rows = [("m", float(v)) for v in (1, 2, 50, 52, 99, 100, 101)]
    out = {r.y: r.band for r in scene.bands(spark.createDataFrame(rows, "image string, y double"), "image", "y", 3).collect()}
    assert [out[v] for _, v in rows] == [0, 0, 1, 1, 2, 2, 2]
    polygons = spark.createDataFrame([("p", "B1"), ("q", None)], "polygon_id string, semantic_layer string")
    annotated = spark.createDataFrame([("p", "B2")], "polygon_id string, layer string")
    assert {r.polygon_id: r.layer for r in scene.effective_layer(polygons, annotated).collect()} == {"p": "B2", "q": None}
