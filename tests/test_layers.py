"""Layers brought into one system, and edges kept within bands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorgraph.operators import bands, graph, layers

PAIRS = "graph string, ord int, a string, b string, matrix array<double>"


def affine(u, v, x, y):
    return [float(n) for n in (u, -v, x, v, u, y, 0, 0, 1)]


def test_roots_ties_and_pairs_that_lead_nowhere(spark):
    m, n, singular = affine(1, 2, 3, 4), affine(2, 0, 5, 6), [0.0] * 9
    rows = [
        ("s", 2, "B1", "B2", m), ("s", 1, "B1", "B3", n), ("s", 3, "B2", "B4", m), ("s", 4, "B3", "B4", n),  # B4 by B3, which comes first
        ("s", 5, "X", "Y", m), ("s", 6, "B4", None, m), ("s", 7, "B4", "B5", None),  # not reached; no pairs
        ("t", 1, "F1", "F2", m), ("u", 1, "F1", "F2", m), ("v", 1, "B0", "B1", singular), ("v", 2, "B0", "B1", singular),
    ]
    wanted = spark.createDataFrame([("t", "F2"), ("u", "F9"), ("none", "B1")], "graph string, layer string")
    got = {(r.graph, r.layer): r for r in layers.align_layers(spark.createDataFrame(rows, PAIRS), wanted).collect()}
    assert {k: r.root for k, r in got.items()} == {("s", "B1"): "B1", ("s", "B2"): "B1", ("s", "B3"): "B1", ("s", "B4"): "B1", ("t", "F1"): "F2", ("t", "F2"): "F2", ("u", "F1"): "F1", ("u", "F2"): "F1", ("v", "B1"): "B1"}
    square = lambda v: np.array(v).reshape(3, 3)
    assert np.allclose(square(got["s", "B4"].matrix), square(n) @ square(n)) and got["s", "B4"].depth == 2
    assert np.allclose(square(got["t", "F1"].matrix), np.linalg.inv(square(m)))
    assert layers.align_layers(spark.createDataFrame([], PAIRS)).count() == 0


def test_inverse_of_any_matrix(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=9).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, m array<double>").select("i", layers.product(F.col("m"), layers.inverse(F.col("m"))).alias("one"))
    assert np.allclose([r.one for r in df.collect()], [np.eye(3).ravel()] * 20)


def test_bands_and_what_is_taken_instead(spark):
    values = [("g", i, v) for i, v in enumerate((0.0, 1.0, 2.0, 50.0, 51.0, 100.0))] + [("h", i, v) for i, v in enumerate((0.0, 90.0, 1.0, 91.0))] + [("one", 0, 7.0), ("n", 0, None), ("n", 1, float("nan")), ("g", 0, 0.0)]
    nodes = spark.createDataFrame(values, "graph string, node int, value double")
    edges = spark.createDataFrame([("g", 0, 1, 5.0), ("g", 1, 2, 4.0), ("g", 2, 3, 0.0), ("g", 3, 4, 9.0), ("h", 0, 1, 1.0), ("h", 1, 2, 2.0), ("h", 2, 3, 3.0), ("n", 0, 1, 1.0), ("g", 0, 77, 0.0)], "graph string, from int, to int, score double")
    by = {(r.graph, r.node): r.band for r in bands.value_bands(nodes, 3).collect()}
    assert [by["g", i] for i in range(6)] == [1, 1, 1, 2, 2, 3] and by["one", 0] == 1 and by["n", 0] is by["n", 1] is None
    got = sorted((r.graph, r["from"], r.to, r.band, r.selection) for r in bands.banded_edges(nodes, edges, 3).collect())
    # nodes without a value are not told apart by bands: their edge stays if that makes the groups, here two nodes are at most two groups
    assert [e for e in got if e[0] == "g"] == [("g", 0, 1, 1, "bands"), ("g", 1, 2, 1, "bands"), ("g", 3, 4, 2, "bands")]
    assert [e for e in got if e[0] == "h"] == [("h", 0, 1, None, "strongest")]
    assert bands.banded_edges(nodes.limit(0), edges.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="one group"):
        bands.banded_edges(nodes, edges, 0)


def test_many_rows_in_small_files_do_not_pass_through_the_driver(spark):
    # 150,000 nodes are files of one MB, and hash tables of 40 MB, more than are allowed here
    node = lambda c, name: F.struct(F.lit("g").alias("graph"), c.alias("node")).alias(name)
    rows = spark.range(150_000)
    edges = rows.where("id % 3 < 2").select(node(F.col("id"), "from"), node(F.col("id") + 1, "to"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "32m")
    try:
        found = graph.components(rows.select(node(F.col("id"), "node")), edges)
        wrong = found.where("component.node <> node.node - node.node % 3")
        assert (found.count(), wrong.count()) == (150_000, 0)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
