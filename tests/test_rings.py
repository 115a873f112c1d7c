"""Edits of rings and of rings with holes, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from floorgraph.functions import rings as rg
from floorgraph.functions import tables

POINTS = "array<struct<x: double, y: double>>"
SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
COMB = [(0.0, 0.0), (9.0, 0.0), (9.0, 6.0), (6.0, 6.0), (6.0, 2.0), (3.0, 2.0), (3.0, 6.0), (0.0, 6.0)]
CASES = [
    ("middle", SQUARE, (-1.0, 1.0), (0.5, 1.0), {4.0, 12.0}), ("diagonal", SQUARE, (0.0, 0.0), (4.0, 4.0), {8.0}), ("through one vertex", SQUARE, (0.0, 0.0), (4.0, 2.0), {4.0, 12.0}),
    ("near a vertex", SQUARE, (0.00001, 0.00001), (4.0, 4.0), {8.0}), ("past it", SQUARE, (-1.0, 5.0), (9.0, 5.0), None), ("along an edge", SQUARE, (0.0, 0.0), (4.0, 0.0), None), ("touches a vertex", SQUARE, (-1.0, 1.0), (1.0, -1.0), None),
    ("a small part", SQUARE, (0.0, 0.5), (8.0, 0.0), {14.5, 1.5}), ("too small a part", SQUARE, (0.0, 0.2), (8.0, 0.2), None), ("four hits", COMB, (0.0, 4.0), (1.0, 4.0), None), ("two hits", COMB, (0.0, 1.0), (1.0, 1.0), {9.0, 33.0}),
    ("no line", SQUARE, (1.0, 1.0), (1.0, 1.0), None), ("two points", SQUARE[:2], (1.0, -1.0), (1.0, 1.0), None),
]


def test_split_by_a_line(spark):
    df = spark.createDataFrame([(n, r, p, q) for n, r, p, q, _ in CASES] + [("null", None, (0.0, 0.0), (1.0, 1.0))], f"n string, r {POINTS}, p struct<x: double, y: double>, q struct<x: double, y: double>")
    parts = df.select("n", "r", rg.split_by_line(F.col("r"), F.col("p"), F.col("q")).alias("s")).select("n", "s.a", "s.b").collect()
    out = {r.n: r for r in parts}
    for name, *_, want in CASES:
        a, b = out[name].a, out[name].b
        assert (None if a is None else {round(area(a), 3), round(area(b), 3)}) == want, name
        assert (a is None) == (b is None)
    assert out["null"].a is None
    assert {len(out["diagonal"].a), len(out["diagonal"].b)} == {3} and {len(out["middle"].a), len(out["middle"].b)} == {4}
    holes = df.where("n = 'middle'").select(rg.split_by_line(F.col("r"), F.col("p"), F.col("q"), F.array("r")).alias("s"))
    assert holes.first().s is None


def area(ring):
    return abs(sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_holes(spark):
    small, far, thin = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], [(3.0, 3.0), (5.0, 3.0), (5.0, 5.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 1.5)]
    df = spark.createDataFrame([(SQUARE, small, far, thin)], f"r {POINTS}, small {POINTS}, far {POINTS}, thin {POINTS}")
    none = F.array().cast(f"array<{POINTS}>")
    point = lambda x, y: rg.point(F.lit(x), F.lit(y))
    df = df.select("*", rg.polygon(F.col("r"), none).alias("whole"))
    whole, held = F.col("whole"), F.col("held")
    df = df.select("*", rg.cut_hole(whole, F.col("small")).alias("held"))
    tests = {
        "cut": held, "outside": rg.cut_hole(whole, F.col("far")), "thin": rg.cut_hole(whole, F.col("thin")), "flat": rg.polygon(F.slice("r", 1, 2), none), "unknown": rg.polygon(F.lit(None).cast(POINTS), none),
        "boundary": rg.move_polygon_vertex(held, F.lit(2), point(4.0, 4.0), F.lit(0)), "leaves": rg.move_polygon_vertex(held, F.lit(2), point(4.1, 4.0), F.lit(0)),
        "uncovered": rg.move_polygon_vertex(held, F.lit(2), point(1.5, 1.5)), "outer": rg.move_polygon_vertex(held, F.lit(2), point(6.0, 6.0)), "no vertex": rg.move_polygon_vertex(held, F.lit(4), point(1.0, 1.0), F.lit(0)),
        "no hole": rg.move_polygon_vertex(held, F.lit(0), point(1.0, 1.0), F.lit(1)), "merged vertex": rg.move_polygon_vertex(held, F.lit(2), point(3.0, 1.0), F.lit(0)),
    }
    row = df.select(*[c.alias(n) for n, c in tests.items()]).first()
    assert {n for n in tests if row[n] is not None} == {"cut", "boundary", "outer", "merged vertex"}
    assert [tuple(p) for p in row["boundary"].holes[0]][2] == (4.0, 4.0) and len(row["merged vertex"].holes[0]) == 3


@pytest.mark.parametrize("backward", [False, True])
def test_a_path_is_replaced_in_either_direction(spark, backward):
    new = [(4.5, 1.0), (5.0, 2.0), (4.5, 3.0)]  # beside the right edge, bottom to top
    df = spark.createDataFrame([(SQUARE, new)], f"r {POINTS}, n {POINTS}")
    start, end = (F.lit(2), F.lit(1)) if backward else (F.lit(1), F.lit(2))
    rings = [tuple(map(tuple, r)) for r in df.select(*[rg.replace_path(F.col("r"), start, end, F.col("n"), backward, o).alias(o) for o in ("auto", "reverse", "keep")]).first()]
    along = (*new, (0.0, 4.0), (0.0, 0.0))
    assert rings[0] == rings[1] == along and rings[2] == (*new[::-1], (0.0, 4.0), (0.0, 0.0))
    with pytest.raises(ValueError):
        rg.replace_path(F.col("r"), start, end, F.col("n"), order="any")


def test_gates_by_a_table_function(spark):
    tables.register(spark)
    rows = [(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (2, 0, 0.0, 0.0), (2, 1, 3.0, 0.0), (2, 2, 3.0, 0.0), (2, 3, None, 5.0), (2, 4, 3.0, 4.0), (3, 0, 1.0, 1.0), (4, 0, 1.0, 1.0), (4, 1, 1.0, 1.0), (5, 0, 0.0, 0.0), (5, 1, 0.0, 1.5)]
    spark.createDataFrame(rows, "path long, ord int, x double, y double").createOrReplaceTempView("gate_points")
    out = {}
    for r in spark.sql("select * from gates_along(table(gate_points) partition by path order by (ord), 1.0D, 2.0D)").collect():
        out.setdefault(r.path, []).append((r.gate, r.along, round(r.x, 9), round(r.y, 9), r.angle))
    assert [g[1] for g in sorted(out[1])] == [0.5, 1.5, 2.5, 3.5, 6.5, 7.5, 8.5, 9.5]  # as on a straight path
    assert sorted(out[2]) == [(0, 0.5, 0.5, 0.0, 0.0), (1, 1.5, 1.5, 0.0, 0.0), (2, 5.5, 3.0, 2.5, 90.0), (3, 6.5, 3.0, 3.5, 90.0)]
    assert out[5] == [(0, 0.75, 0.0, 0.75, 90.0)] and out.keys() == {1, 2, 5}


def test_edits_of_holes_work_a_step_out_once(spark):
    none = F.array().cast(f"array<{POINTS}>")
    df = spark.createDataFrame([(SQUARE, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])], f"r {POINTS}, hole {POINTS}")
    held = rg.cut_hole(rg.polygon(F.col("r"), none), F.col("hole"))
    plan = df.select(rg.move_polygon_vertex(held, F.lit(2), rg.point(F.lit(3.5), F.lit(3.5)), F.lit(0)).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") < 20  # hundreds where steps are written out again


def test_edits_are_dealt_to_the_cores(spark, sf_dir):
    from floorgraph import catalog

    assert catalog.queries()["hole_edits"](spark, sf_dir).rdd.getNumPartitions() == 4
