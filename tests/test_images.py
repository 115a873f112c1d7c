"""Kernels on small drawn images."""

import numpy as np
from pyspark.sql import functions as F

from floorgraph.operators import cluster, images


def mask(spark, *boxes, image="m"):
    pixels = {(x, y) for x0, y0, x1, y1 in boxes for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
    return spark.createDataFrame([(image, x, y) for x, y in pixels], "image string, x int, y int")


def test_outlines_of_boxes(spark):
    df = mask(spark, (10, 10, 40, 30), (60, 10, 62, 12), (5, 50, 25, 80), (15, 60, 60, 70))
    out = {r.outline: r for r in images.outlines(df, least_area=100, epsilon_ratio=0.01).collect()}
    assert len(out) == 2
    assert out[0].area == 600 and sorted((p.x, p.y) for p in out[0].points) == [(10, 10), (10, 30), (40, 10), (40, 30)]
    assert len(out[1].points) == 8


def test_single_pixels_and_lines_have_no_area(spark):
    assert images.outlines(mask(spark, (1, 1, 1, 1), (5, 5, 9, 5)), least_area=0).count() == 0


def test_labels_are_eight_connected():
    grid = np.zeros((6, 6), bool)
    for x, y in ((0, 0), (1, 1), (2, 2), (5, 0), (5, 5)):
        grid[y, x] = True
    labels = images.labelled(grid)
    assert labels[0, 0] == labels[1, 1] == labels[2, 2] == 1 and labels[0, 5] == 2 and labels[5, 5] == 3 and labels[3, 3] == 0


def test_templates_are_found_where_they_were_drawn(spark):
    rng = np.random.default_rng(0)
    template = rng.integers(0, 255, (10, 12)).astype(float)
    canvas = rng.integers(0, 40, (60, 80)).astype(float)
    canvas[20:30, 15:27] = template
    canvas[40:50, 50:62] = template[:, ::-1]
    rows = [("i", x, y, float(canvas[y, x])) for y in range(60) for x in range(80)]
    found = images.template_matches(spark.createDataFrame(rows, "image string, x int, y int, value double"), {"stair": template}, scales=(1.0,), threshold=0.9).collect()
    assert sorted((r.x, r.y, r.flipped) for r in found) == [(15, 20, False), (50, 40, True)]
    assert all(abs(r.score - 1) < 1e-6 for r in found)


def test_resizing_keeps_the_mean():
    image = np.arange(48, dtype=float).reshape(6, 8)
    assert images.resized(image, 0.5).shape == (3, 4) and abs(images.resized(image, 0.5).mean() - image.mean()) < 1e-9
    assert np.allclose(images.resized(image, 1.0), image)


def test_holes_are_filled_along_a_direction(spark):
    rows = [("i", x, 0, float(10 * x), x in (3, 4)) for x in range(8)] + [("i", x, 1, 5.0, x == 0) for x in range(8)] + [("i", x, 2, 7.0, True) for x in range(8)]
    out = {(r.x, r.y): r.value for r in images.fill_along(spark.createDataFrame(rows, "image string, x int, y int, value double, hole boolean"), 0.0).collect()}
    assert (out[3, 0], out[4, 0], out[0, 1], out[5, 2]) == (30.0, 40.0, 5.0, 7.0)


def test_scan_bridges_cross_the_gap(spark):
    out = images.scan_bridges(mask(spark, (0, 0, 10, 20), (20, 0, 30, 20)), mask(spark, (12, 4, 18, 16)), reach=15, step=4, angles=[0.0, 90.0]).collect()
    assert len(out) == 4 and {r.angle for r in out} == {0.0}
    # a mask within one pixel is touched
    assert {(r.x0, r.x1) for r in out} == {(11.0, 19.0)} or {(r.x0, r.x1) for r in out} == {(10.0, 20.0)}


def test_icon_bridges(spark):
    icons = spark.createDataFrame([("m", "icon_001", 40, 40, 10, 10), ("m", "icon_002", 200, 200, 4, 4)], "image string, icon string, x int, y int, w int, h int")
    out = images.icon_bridges(mask(spark, (0, 42, 35, 48), (60, 42, 90, 48)), icons).collect()
    assert [(r.icon, r.angle, r.x0, r.x1) for r in out] == [("icon_001", 0.0, 35, 60)] and abs(out[0].score - 1 / 25) < 1e-9


def test_markers_and_corners(spark):
    parts = images.outlines(mask(spark, (0, 0, 8, 8), (20, 0, 90, 1)), least_area=10, epsilon_ratio=0.0)
    assert [(r.x, r.y) for r in images.markers(parts).collect()] == [(4.0, 4.0)]
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    r = spark.range(1).select(images.ordered_corners(F.array(point(9, 9), point(0, 1), point(10, 0), point(1, 10))).alias("c"), images.fourth_corner(point(0, 0), point(4, 0), point(5, 3)).alias("d")).first()
    assert [(p.x, p.y) for p in r.c] == [(0, 1), (10, 0), (9, 9), (1, 10)] and (r.d.x, r.d.y) == (1, 3)


def test_region_pick_keeps_to_its_part_and_colour(spark):
    rows = [("i", x, y, *((200, 30, 30) if x < 5 else (30, 30, 200) if x < 8 else (200, 32, 30))) for x in range(12) for y in range(6)]
    pixels = spark.createDataFrame(rows, "image string, x int, y int, r int, g int, b int")
    seeds = spark.createDataFrame([("i", 1, 1), ("i", 2, 2)], "image string, x int, y int")
    assert sorted({r.x for r in images.pick_regions(pixels, seeds).collect()}) == [0, 1, 2, 3, 4]


def test_lab_of_known_colours():
    assert images.lab(np.array([[255.0, 255, 255], [0, 0, 0], [255, 0, 0]])).tolist() == [[255, 128, 128], [0, 128, 128], [136, 208, 195]]


def test_matches_are_thinned(spark):
    boxes = spark.createDataFrame([("i", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("i", 2, 1.0, 0.0, 10.0, 10.0, 0.95)], "image string, id int, x double, y double, w double, h double, score double")
    assert [r.id for r in cluster.suppress_overlaps(boxes, "image").collect()] == [2]
