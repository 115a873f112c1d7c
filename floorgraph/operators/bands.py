"""Edges kept within bands of one coordinate, or the strongest ones where the bands do not give the groups asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorgraph.operators import forest
from floorgraph.operators import graph as gr
from floorgraph.sources.shared import cut, unsent

_C = F.col


def value_bands(nodes: DataFrame, k: int, rounds: int = 100) -> DataFrame:
    """(graph, node, value, band): bands 1, 2, ... by ascending centres of a k-means of each graph's values.

    Centres start evenly spaced between a graph's least and greatest value, at
    most as many as it has nodes; each round moves them to the means of what is
    nearest (of equals the lower), an empty one stays, until none moves.  The
    values of a graph are only summed, never gathered, so that one may hold most
    rows.  Nodes without a finite value have no band.
    """
    finite = F.coalesce(F.abs("value") < float("inf"), F.lit(False))  # NaN is above infinity
    rows = cut(nodes.select("graph", "node", F.when(finite, _C("value").cast("double")).alias("value")))
    ends = rows.where("value is not null").groupBy("graph").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.least(F.count("*"), F.lit(k)).alias("n"))
    spaced = F.transform(F.sequence(F.lit(1), _C("n").cast("int")), lambda i: _C("low") + (_C("high") - _C("low")) * (i - 0.5) / _C("n"))
    centres = cut(ends.select("graph", spaced.alias("centres"), F.lit(True).alias("moved")))
    graphs = centres.count()
    nearest = F.array_min(F.transform("centres", lambda c, i: F.struct(F.abs(_C("value") - c).alias("d"), i.alias("i"))))["i"]
    for _ in range(rounds):
        open_ = centres.where("moved")
        if open_.isEmpty():
            break
        means = rows.where("value is not null").join(unsent(open_, graphs), "graph").groupBy("graph", nearest.alias("i")).agg(F.avg("value").alias("mean"))
        listed = means.groupBy("graph").agg(F.map_from_entries(F.collect_list(F.struct("i", "mean"))).alias("means"))  # k of a graph
        new = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at(_C("means"), i), c))
        far = F.exists(F.zip_with("centres", "new", lambda a, b: F.abs(a - b) > 1e-9), lambda m: m)
        stepped = centres.join(unsent(listed, graphs), "graph", "left").withColumn("new", F.when(_C("means").isNull(), _C("centres")).otherwise(new))
        centres = cut(stepped.select("graph", _C("new").alias("centres"), far.alias("moved")))
    # centres of one dimension keep their order, so that an index is a rank
    return rows.join(unsent(centres.drop("moved"), graphs), "graph", "left").select("graph", "node", "value", F.when(_C("value").isNotNull(), nearest + 1).alias("band"))


def banded_edges(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(graph, from, to, score, band, selection): the edges that leave each graph in ``k`` groups.

    ``nodes``: graph, node, value; ``edges``: graph, from, to, score.  Edges
    within a band stay if they make exactly k groups (or as many as there are
    nodes); in other graphs the strongest ones (least score) are taken until k
    groups are left, without a band.
    """
    if k < 1:
        raise ValueError("at least one group")
    banded = cut(value_bands(nodes.select("graph", "node", "value").dropDuplicates(["graph", "node"]), k))
    n = banded.count()
    at = lambda end: unsent(banded.select("graph", _C("node").alias(end), _C("band").alias(f"_{end}")), n)
    links = edges.select("graph", "from", "to", "score")
    inside = cut(links.join(at("from"), ["graph", "from"]).join(at("to"), ["graph", "to"]).where(_C("_from").eqNullSafe(_C("_to"))))
    own = lambda c: F.struct("graph", _C(c).alias("node"))
    parts = gr.components(banded.select(own("node").alias("node")), inside.select(own("from").alias("from"), own("to").alias("to")))
    groups = parts.select(_C("node.graph").alias("graph"), "component").groupBy("graph").agg(F.countDistinct("component").alias("groups"), F.count("*").alias("nodes"))
    groups = cut(groups)
    graphs = groups.count()
    fits = _C("groups") == F.least("nodes", F.lit(k))
    by_band = inside.join(unsent(groups.where(fits).select("graph"), graphs), "graph", "left_semi").select("graph", "from", "to", "score", _C("_from").alias("band"), F.lit("bands").alias("selection"))
    others = groups.where(~fits).select("graph", "nodes")
    taken = forest.spanning_forest(links.join(unsent(others.select("graph"), graphs), "graph", "left_semi"), others, k)
    return by_band.unionByName(taken.select("graph", "from", "to", "score", F.lit(None).cast("int").alias("band"), F.lit("strongest").alias("selection")))
