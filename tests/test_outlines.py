"""Grid, outline distances, spanning forests and suppression against brute force on random shapes."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from floorgraph import catalog
from floorgraph.functions import geometry as g
from floorgraph.operators import cluster as cl
from floorgraph.operators import forest as fo
from floorgraph.operators import grid
from floorgraph.operators import outlines as ol
from floorgraph.operators import raster as rs
from floorgraph.operators import runs as rn
from floorgraph.operators import spatial as sp
from floorgraph.sources import shared

RING = "ring array<struct<x: double, y: double>>"
BOX = ["x0", "y0", "x1", "y1"]


def gap(a, b):
    return math.hypot(max(0, a[0] - b[2], b[0] - a[2]), max(0, a[1] - b[3], b[1] - a[3]))


def test_an_outlier_has_few_cells(spark):
    rng = random.Random(1)
    rows = [(k, x := rng.uniform(0, 30_000), y := rng.uniform(0, 30_000), x + 0.5, y + 0.5) for k in range(20_000)]
    rows.append((99_999, 0.0, 0.0, 30_000.0, 30_000.0))
    boxes = spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double")
    began = time.time()
    cells = grid.placed(boxes, [F.col(c) for c in BOX], 1.0).groupBy("k").count().agg(F.max("count"), F.sum("count")).first()
    assert cells[0] <= 4 and cells[1] <= 4 * len(rows)
    pairs = sp.box_pairs(boxes, "k", BOX, 1.0)
    assert pairs.where("k_b = 99999").count() == 20_000
    assert time.time() - began < 60


def test_repeated_boxes_meet_once(spark, monkeypatch):
    rng = random.Random(9)
    shapes = [(x, y, x + rng.randrange(4), y + rng.randrange(4)) for x, y in ((float(rng.randrange(20)), float(rng.randrange(20))) for _ in range(15))]
    rows = [(k, rng.choice("ab"), *shapes[rng.randrange(15)]) for k in range(150)] + [(3, "c", *shapes[0]), (None, "a", *shapes[1]), (500, None, float("nan"), 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "k int, colour string, x0 double, y0 double, x1 double, y1 double")
    met, meeting = [], grid.meeting
    monkeypatch.setattr(grid, "meeting", lambda left, right, *a, **k: met.append(left.count()) or meeting(left, right, *a, **k))
    out = sp.box_pairs(boxes, "k", BOX, 2.0)
    gap = lambda a, b: math.hypot(max(0.0, a[2] - b[4], b[2] - a[4]), max(0.0, a[3] - b[5], b[3] - a[5]))
    whole = [r for r in rows if r[0] is not None and r[2] == r[2]]
    want = sorted((*a, *b, gap(a, b)) for a in whole for b in whole if a[0] < b[0] and gap(a, b) <= 2.0)
    assert out.columns == [*boxes.columns, *[f"{c}_b" for c in boxes.columns], "gap"]
    assert sorted(map(tuple, out.collect())) == want
    assert met == [len(set(shapes))]


def test_box_pairs_of_every_size(spark):
    rng = random.Random(2)
    rows = []
    for k in range(150):
        x, y, w = rng.uniform(-50, 50), rng.uniform(-50, 50), 2 ** rng.uniform(-8, 7)
        rows.append((k, x, y, x + w, y + w * rng.uniform(0, 1)))
    rows += [(900, 1.0, 1.0, 1.0, 1.0), (901, 1.0, 1.0, 1.0, 1.0), (902, None, 0.0, 1.0, 1.0), (903, float("nan"), 0.0, 1.0, 1.0), (904, 0.0, 0.0, float("inf"), 1.0)]
    boxes = spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double")
    out = [(r.k, r.k_b) for r in sp.box_pairs(boxes, "k", BOX, 3.0).collect()]
    sound = [r for r in rows if r[0] < 902]
    assert sorted(out) == sorted((a[0], b[0]) for a in sound for b in sound if a[0] < b[0] and gap(a[1:], b[1:]) <= 3.0)
    assert sp.box_pairs(boxes.limit(0), "k", BOX, 3.0).count() == 0


def test_crowded_pairs_of_every_size(spark):
    """All pairs once, also of repeated boxes and of very different sizes, on both sides of zero and far from it."""
    rng = random.Random(3)
    for reach, far in ((3.0, 0.0), (0.0, 0.0), (20.0, 1e7)):
        rows = []
        for k in range(150):
            x, y, w = far + rng.uniform(-50, 50), rng.uniform(-50, 50), 2 ** rng.uniform(-8, 7)
            rows.append((k, rng.choice("ab"), x, y, x + w, y + w * rng.uniform(0, 1)))
        rows += [(200 + k, "c", *rows[k % 7][2:]) for k in range(30)] + [(300 + k, None, far + k % 5 * 20.0, 4.0 * (k // 5), far + k % 5 * 20.0 + 6, 4.0 * (k // 5) + 4) for k in range(40)]
        odd = [(None, "a", 1.0, 1.0, 1.0, 1.0), (902, "a", None, 0.0, 1.0, 1.0), (903, "a", float("nan"), 0.0, 1.0, 1.0), (904, "a", 0.0, 0.0, float("inf"), 1.0)]
        boxes = spark.createDataFrame(rows + odd, "k long, colour string, x0 double, y0 double, x1 double, y1 double")
        out = sp.crowded_pairs(boxes, "k", BOX, reach)
        assert out.columns == [*boxes.columns, *[f"{c}_b" for c in boxes.columns], "gap"]
        got, ways = sorted((r.k, r.k_b) for r in out.collect()), {r[0]: r for r in rows}
        assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and gap(a[2:], b[2:]) <= reach)
        assert all((*r[:6],) == ways[r.k] and (*r[6:12],) == ways[r.k_b] and abs(r.gap - gap(r[2:6], r[8:12])) < 1e-9 for r in out.collect())
    assert sp.crowded_pairs(boxes.limit(0), "k", BOX, 3.0).count() == 0


def test_pairs_of_repeated_boxes_are_not_exchanged(spark, tmp_path):
    """The pairs of 2,000 parts at ten places were exchanged before they were listed."""
    rows = [(k, f"Brand#{k % 3}", k % 5 + 1, 900.0 + k % 2) for k in range(2_000)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    out = catalog.queries()["pair_adjacency"](spark, str(tmp_path))
    each = 2_000 * 1_999 // 2
    near = sum(abs(a - b) <= 1 for a in range(5) for b in range(5))
    assert out.count() == (near * 400 * 400 - 2_000) // 2 < each
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == plan.count("Join") > 0 and plan.count("Exchange") <= 4


def test_fast_rounding_is_that_of_spark(spark):
    rng = random.Random(4)
    values = [0.0, 0.00005, 0.00015, 1.00005, 2.5, 14.14215, 20.0, 999999.99995, 1e6, 1e300, -1.00005, -3.2, float("nan"), float("inf"), None]
    values += [rng.random() * 10 ** rng.randrange(-5, 9) for _ in range(3_000)] + [rng.randrange(10**8) / 1e5 for _ in range(3_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~F.round("v", 4).eqNullSafe(g.rounded(F.col("v"), 4))).collect() == []


def test_rings_are_found_without_a_nested_loop(spark):
    rng = random.Random(3)
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    shapes = [(k, rng.uniform(0, 90), rng.uniform(0, 90), 2 ** rng.uniform(-2, 6)) for k in range(60)]
    rings = spark.createDataFrame([(k, square(x, y, s)) for k, x, y, s in shapes], f"r int, {RING}")
    points = [(k, rng.uniform(0, 120), rng.uniform(0, 120)) for k in range(200)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    out = sp.points_in_rings(spark.createDataFrame(points, "p int, x double, y double"), rings, "p", "x", "y", "r", "ring")
    want = {(p, k) for p, x, y in points[:200] for k, a, b, s in shapes if a < x < a + s and b < y < b + s}
    assert {(r.p, r.r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def segment_distance(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    n = d[0] ** 2 + d[1] ** 2
    t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0
    return math.dist(p, (a[0] + t * d[0], a[1] + t * d[1]))


def ring_distance(one, two):
    def inside(p, ring):
        return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    turn = lambda a, b, c: (c[1] - a[1]) * (b[0] - a[0]) > (b[1] - a[1]) * (c[0] - a[0])
    if any(inside(p, two) for p in one) or any(inside(p, one) for p in two):
        return 0.0
    best = math.inf
    for a, b in zip(one, one[1:] + one[:1], strict=True):
        for c, d in zip(two, two[1:] + two[:1], strict=True):
            if turn(a, c, d) != turn(b, c, d) and turn(a, b, c) != turn(a, b, d):
                return 0.0
            best = min(best, segment_distance(a, c, d), segment_distance(b, c, d), segment_distance(c, a, b), segment_distance(d, a, b))
    return best


def random_rings(rng, n):
    out = []
    for k in range(n):
        x, y, s = rng.uniform(0, 60), rng.uniform(0, 60), 2 ** rng.uniform(-1, 4)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(3, 8)))
        out.append((k, [(x + s * rng.uniform(0.4, 1) * math.cos(t), y + s * rng.uniform(0.4, 1) * math.sin(t)) for t in turns]))
    return out


def test_outline_distances_by_brute_force(spark):
    rings = random_rings(random.Random(4), 50) + [(90, [(0.0, 0.0), (70.0, 0.0), (70.0, 70.0), (0.0, 70.0)]), (91, [(200.0, 0.0), (200.5, 0.0), (200.0, 0.5)])]
    a = spark.createDataFrame([*rings, (95, None), (96, [])], f"a int, {RING}")
    out = {(r.a, r.b): round(r.distance, 9) for r in ol.outline_distances(a, a.withColumnRenamed("a", "b"), "a", "b", 5.0).where("a < b").collect()}
    want = {(i, j): round(d, 9) for i, p in rings for j, q in rings if i < j and (d := ring_distance(p, q)) <= 5.0}
    assert out == want and any(d == 0 for d in want.values()) and any(d > 0 for d in want.values())
    assert all((k, 90) in out for k in range(50) if max(max(p) for p in rings[k][1]) < 60)  # those inside touch nothing


def test_bridges_rank_their_neighbours(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    polygons = spark.createDataFrame([(1, "red", square(0.0, 0.0, 4.0)), (2, "red", square(14.0, 0.0, 4.0)), (3, "blue", square(24.0, 0.0, 4.0)), (4, "blue", square(300.0, 0.0, 4.0))], f"p int, colour string, {RING}")
    bridges = spark.createDataFrame([(7, square(5.0, 1.0, 8.0)), (8, square(500.0, 0.0, 1.0))], f"b int, {RING}")
    near = ol.near_bridges(polygons, bridges, "p", "b", 20.0, 2)
    assert [(r.bridge, r.polygon, r.distance, r["rank"]) for r in near.orderBy("rank").collect()] == [(7, 1, 1.0, 1), (7, 2, 1.0, 2)]
    pairs = ol.bridge_pairs(ol.near_bridges(polygons, bridges, "p", "b", 20.0, 6), polygons.select(F.col("p").alias("polygon"), "colour"), 20.0)
    assert {(r.first, r.second): (r.distance, r.confidence) for r in pairs.collect()} == {(1, 2): (1.0, 0.95), (1, 3): (11.0, 0.55), (2, 3): (11.0, 0.55)}


def kruskal(edges, nodes, target):
    parent, out = {n: n for n in nodes}, []

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    left = len(nodes)
    for s, a, b in sorted(edges):
        if left > target and root(a) != root(b):
            parent[root(a)] = root(b)
            out.append((a, b, s))
            left -= 1
    return sorted(out)


@pytest.mark.parametrize("target", [1, 4])
def test_forest_equals_taking_edges_one_by_one(spark, target):
    rng = random.Random(5)
    graphs = {g: [(float(rng.randrange(6)), *sorted(rng.sample(range(40), 2))) for _ in range(m)] for g, m in (("a", 120), ("b", 30), ("c", 1))}
    graphs["chain"] = [(float(i), i, i + 1) for i in range(39)]
    rows = [(g, a, b, s) for g, e in graphs.items() for s, a, b in e] + [("a", 3, 3, 0.0), ("a", None, 3, 0.0), ("a", 1, 2, None)]
    edges = spark.createDataFrame(rows, "graph string, `from` int, `to` int, score double")
    sizes = spark.createDataFrame([(g, 40) for g in [*graphs, "alone"]], "graph string, nodes int")
    out = {}
    for r in fo.spanning_forest(edges, sizes, target).collect():
        out.setdefault(r.graph, []).append((r["from"], r["to"], r.score))
    assert {g: sorted(e) for g, e in out.items()} == {g: want for g, e in graphs.items() if (want := kruskal(set(e), range(40), target))}
    assert fo.spanning_forest(edges.limit(0), sizes, target).count() == 0


@pytest.mark.parametrize("target", [1, 3])
def test_links_between_outlines(spark, target):
    rng = random.Random(6)
    rows = [(g, f"o{o}", 100 * o + k, rng.gauss(20 * (o % 4), 3), rng.gauss(30 * (o // 4), 3)) for g in (1, 2) for o in range(9) for k in range(12)]
    rows += [(1, "far", 990, 5000.0, 9.0), (1, "o1", 991, None, 1.0), (2, "void", 992, float("nan"), 1.0), (2, "o1", 993, rows[120][3], rows[120][4])]
    points = spark.createDataFrame(rows, "g int, o string, k int, x double, y double")
    out = {}
    for r in fo.span_edges(points, "o", "k", "x", "y", graph="g", target=target).collect():
        out.setdefault(r.graph, []).append((r.a, r.b, (r.distance, r.a, r.b, r.point_a, r.point_b)))
    want = {}
    for g in (1, 2):
        sound = [r for r in rows if r[0] == g and all(v is not None and math.isfinite(v) for v in r[3:])]
        names = sorted({r[1] for r in sound})
        edges = [(min((round(math.dist(p[3:], q[3:]), 9), a, b, p[2], q[2]) for p in sound if p[1] == a for q in sound if q[1] == b), a, b) for a in names for b in names if a < b]
        want[g] = kruskal(edges, names, target)
    assert {g: sorted(e) for g, e in out.items()} == want
    assert fo.span_edges(points.limit(0), "o", "k", "x", "y").count() == 0


def test_suppression_equals_the_sequential_form(spark):
    rng = random.Random(7)
    rows = [(i, k, rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([10.0, 14.0, 30.0]), rng.choice([10.0, 22.0]), float(rng.randrange(5))) for i in range(3) for k in range(120)]
    rows += [(0, 500 + k, 5.0, 5.0, 10.0, 10.0, 1.0) for k in range(20)] + [(0, 600, 5.0, 5.0, 0.0, 9.0, 0.0), (0, 601, None, 5.0, 9.0, 9.0, 0.0), (1, 602, 5.0, 5.0, 9.0, 9.0, None)]
    boxes = spark.createDataFrame(rows, "image int, id int, x double, y double, w double, h double, score double")

    def overlap(a, b):
        w, h = (min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (2, 3))
        both = max(w, 0) * max(h, 0)
        return both / ((a[4] * a[5] + b[4] * b[5] - both) or 1)

    want = set()
    for image in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == image and r[2] is not None), key=lambda r: (r[6] is None, -(r[6] or 0), r[1])):
            if all(overlap(r, k) < 0.35 for k in kept):
                kept.append(r)
        want |= {(image, r[1]) for r in kept}
    assert {(r.image, r.id) for r in cl.suppress_overlaps(boxes, "image").collect()} == want | {(0, 601)}
    assert cl.suppress_overlaps(boxes.limit(0), "image").count() == 0


def plain_masks(pixels, r, w, h):
    near = lambda x, y: [(a, b) for a in range(x - r, x + r + 1) for b in range(y - r, y + r + 1) if 0 <= a < w and 0 <= b < h]
    every = [(x, y) for x in range(w) for y in range(h)]
    return {p for p in every if any(q in pixels for q in near(*p))}, {p for p in every if all(q in pixels for q in near(*p))}


@pytest.mark.parametrize("size", [1, 3, 6])
def test_runs_equal_pixels(spark, size):
    rng = random.Random(8)
    w, h, r = 23, 17, (size | 1) // 2
    blobs = {(image, x + i, y + j) for image in "mn" for x, y, s in [(rng.randrange(w), rng.randrange(h), rng.randrange(1, 9)) for _ in range(9)] for i in range(s) for j in range(s) if x + i < w and y + j < h}
    blobs |= {("m", rng.randrange(w), rng.randrange(h)) for _ in range(30)} | {("o", 0, 0)} | {("all", x, y) for x in range(w) for y in range(h)}
    df = spark.createDataFrame([*blobs, ("m", None, 1), ("all", 3, 3)], "image string, x int, y int")
    inside = {i: {(x, y) for k, x, y in blobs if k == i} for i in ("m", "n", "o", "all")}
    got = lambda out: {(p.image, p.x, p.y) for p in out.collect()}
    wide = {(i, *p) for i, mask in inside.items() for p in plain_masks(mask, r, w, h)[0]}
    narrow = {(i, *p) for i, mask in inside.items() for p in plain_masks(mask, r, w, h)[1]}
    if r:
        assert got(rs.dilate(df, size, w, h)) == wide and got(rs.erode(df, size, w, h)) == narrow
        opened = {(i, *p) for i in inside for p in plain_masks({q[1:] for q in narrow if q[0] == i}, r, w, h)[0]}
        closed = {(i, *p) for i in inside for p in plain_masks({q[1:] for q in wide if q[0] == i}, r, w, h)[1]}
        assert got(rs.opened(df, size, w, h)) == opened and got(rs.closed(df, size, w, h)) == closed


def test_parts_and_contact_of_runs(spark):
    rng = random.Random(9)
    masks = [{("i", rng.randrange(40), rng.randrange(25)) for _ in range(260)} | {("j", k, k % 2) for k in range(30)} for _ in range(2)]
    frames = [spark.createDataFrame(sorted(m), "image string, x int, y int") for m in masks]
    left, parts = set(masks[0]), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            i, x, y = p = todo.pop()
            part.add(p)
            near = {(i, x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        y, x = min((y, x) for _, x, y in part)
        parts.append((p[0], f"{p[0]}|{y:06d}|{x:06d}", len(part), min(q[1] for q in part), min(q[2] for q in part), max(q[1] for q in part), max(q[2] for q in part)))
    assert sorted(map(tuple, rs.mask_components(frames[0]).collect())) == sorted(parts)
    assert rs.mask_components(frames[0], 5).count() == sum(p[2] >= 5 for p in parts)
    near = lambda a, b, i: sum(any((i, x + u, y + v) in b for u in range(-3, 4) for v in range(-3, 4)) for k, x, y in a if k == i)
    want = {(i, near(masks[0], masks[1], i) + near(masks[1], masks[0], i), len({p for p in masks[0] & masks[1] if p[0] == i})) for i in "ij"}
    assert {tuple(r) for r in rs.contact_area(*frames, 3, 40, 25).collect()} == want
    few = rn.to_runs(spark.range(2000).selectExpr("'b' as image", "cast(id % 100 as int) as x", "cast(id / 100 as int) as y"))
    assert few.count() == 20 and rn.dilated(few, 8, 200, 200).count() == 28


def test_outlines_are_dealt_to_tasks_of_few(spark, monkeypatch):
    monkeypatch.setattr(ol, "_OUTLINES", 10)
    rows = [(k, [(6.0 * k, 0.0), (6.0 * k + 5, 0.0), (6.0 * k, 5.0)]) for k in range(90)]
    a = spark.createDataFrame(rows, f"k int, {RING}")
    out = ol.outline_distances(a, a.withColumnRenamed("k", "l"), "k", "l", 1.0)
    assert "RepartitionByExpression [k#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "], 9" in plan
    assert {(r.a, r.b) for r in out.collect()} == {(k, m) for k in range(90) for m in (k - 1, k, k + 1) if 0 <= m < 90}


def test_runs_take_one_exchange_each(spark):
    pixels = spark.createDataFrame([(1, x, y) for x in (0, 1, 1, 2, 4, 4) for y in (0, 2)] + [(2, 7, 7), (2, None, 7)], "image int, x int, y int")
    assert sorted(map(tuple, rn.to_runs(pixels).collect())) == [(1, 0, 0, 2), (1, 0, 4, 4), (1, 2, 0, 2), (1, 2, 4, 4), (2, 7, 7, 7)]
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(rn.to_runs(pixels)) == 1
    assert exchanges(rn.dilated(shared.cut(rn.to_runs(pixels)), 1, 9, 9)) == 1


def test_runs_that_touch_none_take_no_part_in_rounds(spark, monkeypatch):
    asked, components = [], rn.components
    monkeypatch.setattr(rn, "components", lambda nodes, edges: asked.append(nodes.distinct().count()) or components(nodes, edges))
    runs = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 4), (1, 5, 0, 9), (2, 0, 0, 2)], "image int, y int, x0 int, x1 int")
    out = sorted((r.image, r.y, r.component) for r in rn.linked(runs).collect())
    assert out == [(1, 0, "1|000000|000000"), (1, 1, "1|000000|000000"), (1, 5, "1|000005|000000"), (2, 0, "2|000000|000000")]
    assert asked == [2]


def test_closest_pairs_are_taken_in_the_order_of_their_groups(spark, monkeypatch):
    plans, cut = [], sp.cut
    monkeypatch.setattr(sp, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    points = spark.range(60).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 1.0).alias("x"), (F.col("id") % 5 * 1.0).alias("y"))
    near = spark.createDataFrame([(0, 1), (0, 2), (0, 9)], "by_a long, by_b long")
    got = sorted((r.by_a, r.by_b, r.a, r.b) for r in sp.closest_pairs(points, "g", "id", "x", "y", near).collect())
    assert got == [(0, 1, 0, 1), (0, 2, 3, 2)]
    met = [p for p in plans if "_cx" in p]
    assert met and all("SortMergeJoin [by_a" in p for p in met)
    # one sort of each side, one of what the tasks found, and none of the pairs
    assert [p.count("Sort [") for p in met] == [3] * len(met)


def test_least_links_need_no_sort_of_all_pairs(spark, monkeypatch):
    plans, cut = [], fo.cut
    monkeypatch.setattr(fo, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    points = spark.range(60).select(F.concat(F.lit("o"), F.col("id") % 3).alias("o"), F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"), (F.col("id") % 5 * 1.0).alias("y"))
    got = sorted((r.a, r.b, r.point_a, r.point_b) for r in fo.span_edges(points, "o", "k", "x", "y").collect())
    assert got == [("o0", "o1", 0, 1), ("o0", "o2", 3, 2)]
    met = [p for p in plans if "SortMergeJoin [grapha" in p]
    assert any("HashAggregate(keys=[grapha" in p and "SortAggregate(key=[grapha" not in p for p in met)


def test_shapes_of_many_rows_are_not_sent_to_all_tasks(spark):
    box = lambda end: [F.col(f"{c}{end}") for c in ("x0", "y0", "x1", "y1")]
    x = F.col("id") * 10.0
    rows = lambda end: spark.range(150_000).select(F.col("id").alias(f"id{end}"), x.alias(f"x0{end}"), (x * 0).alias(f"y0{end}"), (x + 1).alias(f"x1{end}"), (x * 0 + 1).alias(f"y1{end}"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "16m")
    try:
        met = grid.meeting(rows("a"), rows("b"), box("a"), box("b"), 1.0)
        near = met.where("x0a <= x1b + 1 and x0b <= x1a + 1")
        assert (near.count(), near.where("ida <> idb").count()) == (150_000, 0)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
