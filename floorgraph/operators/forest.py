"""Minimum spanning forests in rounds, over given edges and over outlines.

In a round every component takes its cheapest edge to another one (Boruvka);
components that took edges to each other become one by pointer jumping.  The
edges have a strict order, so the forest is the one that taking edges one by
one, cheapest first, would give, in a logarithmic number of rounds over all
graphs at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.functions import geometry as g
from floorgraph.sources.shared import cut, unsent

_C = F.col


def _roots(offers: DataFrame, n: int) -> DataFrame:
    """(graph, c, root) from ``n`` rows (graph, c, to): what each component ends at, the smaller of two that took each other."""
    back = offers.select(_C("graph").alias("_g"), _C("c").alias("_c"), _C("to").alias("_to"))
    same = (_C("graph") == _C("_g")) & (_C("root") == _C("_c"))
    first = offers.withColumnRenamed("to", "root").join(unsent(back, n), same)
    roots = cut(first.select("graph", "c", F.when((_C("_to") == _C("c")) & (_C("c") < _C("root")), _C("c")).otherwise(_C("root")).alias("root")))
    while True:
        up = roots.select(_C("graph").alias("_g"), _C("c").alias("_c"), _C("root").alias("_to"))
        stepped = cut(roots.join(unsent(up, n), same).select("graph", "c", _C("_to").alias("root"), (_C("_to") != _C("root")).alias("_moved")))
        roots = stepped.select("graph", "c", "root")
        if not stepped.where("_moved").limit(1).count():
            return roots


def _forest(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges taken, as (graph, edge), and (graph, c, root) of the components met, from (graph, a, b, edge) with a strict order of ``edge``."""
    taken, labels = [], None
    while True:
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        open_ = cut(open_.where("a <> b").groupBy("graph", low, high).agg(F.min("edge").alias("edge")))
        if not open_.limit(1).count():
            break
        sides = open_.select("graph", _C("a").alias("c"), "edge", _C("b").alias("to")).unionAll(open_.select("graph", _C("b").alias("c"), "edge", _C("a").alias("to")))
        best = cut(sides.groupBy("graph", "c").agg(F.min(F.struct("edge", "to")).alias("m")).select("graph", "c", "m.edge", "m.to"))
        taken.append(best.select("graph", "edge").distinct())
        n = best.count()
        roots = _roots(best.select("graph", "c", "to"), n)
        for end in ("a", "b"):
            up = roots.select(_C("graph").alias("_g"), _C("c").alias("_c"), "root")
            open_ = open_.join(unsent(up, n), (_C("graph") == _C("_g")) & (_C(end) == _C("_c"))).select("graph", *[(_C("root") if c == end else _C(c)).alias(c) for c in ("a", "b")], "edge")
        if labels is None:
            labels = roots
        else:
            up = roots.select(_C("graph").alias("_g"), _C("c").alias("_c"), _C("root").alias("_root"))
            labels = cut(labels.join(unsent(up, n), (_C("graph") == _C("_g")) & (_C("root") == _C("_c")), "left").select("graph", "c", F.coalesce("_root", "root").alias("root")))
    if labels is None:
        return open_.select("graph", "edge"), open_.select("graph", _C("a").alias("c"), _C("a").alias("root"))
    return cut(reduce(DataFrame.unionAll, taken).distinct()), labels


def _until(forest: DataFrame, sizes: DataFrame, target: int) -> DataFrame:
    """The forest's (graph, edge) without its costliest edges, so that ``target`` components of the graph's ``nodes`` are left, or as few more as can be."""
    if target < 1:
        raise ValueError("target must be at least one")
    if target == 1:
        return forest
    have = sizes.join(forest.groupBy(_C("graph").alias("_g")).agg(F.count("*").alias("_edges")), _C("graph") == _C("_g"), "left")
    spare = have.select(_C("graph").alias("_g"), (target - (_C("nodes") - F.coalesce("_edges", F.lit(0)))).alias("_spare"))
    last = F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("edge")))
    gone = forest.withColumn("_n", last).where(_C("_n") <= target - 1).join(spare, (_C("graph") == _C("_g")) & (_C("_n") <= _C("_spare")))
    return forest.join(gone.select(_C("graph").alias("_g"), _C("edge").alias("_e")), (_C("graph") == _C("_g")) & (_C("edge") == _C("_e")), "left_anti")


def spanning_forest(edges: DataFrame, n_nodes: DataFrame | None = None, target: int = 1) -> DataFrame:
    """(graph, from, to, score): the cheapest edges that join all that can be joined, or leave ``target`` components.

    ``edges``: graph, from, to, score; of equal scores the smaller ends win.
    ``n_nodes``: graph, nodes; needed for a target above one, as nodes without
    edges are components too.  Edges with a null, and loops, take no part;
    repeated edges are one.
    """
    rows = edges.select("graph", "from", "to", "score").where(" and ".join(f"`{c}` is not null" for c in ("graph", "from", "to", "score")))
    forest, _ = _forest(rows.select("graph", _C("from").alias("a"), _C("to").alias("b"), F.struct("score", "from", "to").alias("edge")))
    if target > 1:
        forest = _until(forest, n_nodes, target)
    return forest.select("graph", "edge.from", "edge.to", "edge.score")


def span_edges(points: DataFrame, outline: str, key: str, x: str, y: str, graph: str | None = None, target: int = 1) -> DataFrame:
    """(graph, a, b, point_a, point_b, distance): the shortest vertex-to-vertex links that join all outlines of a graph.

    ``points``: vertices (key, x, y) of outlines; without ``graph`` all are one.
    Links are found in bands of distance: vertices of different components that
    are within a reach meet in grid cells, the forest over the outlines' closest
    pairs is taken, and what is not joined yet goes on with four times the reach.
    Distances are compared to nine places, then the outlines and keys.  The
    costliest links are left out until ``target`` components are left.  Points
    with nulls or without finite coordinates take no part.
    """
    sound = lambda c: F.coalesce(F.abs(_C(c)) < float("inf"), F.lit(False))  # noqa: E731  NaN is above infinity
    rows = points.select(
        (_C(graph) if graph else F.lit(0)).alias("graph"), _C(outline).alias("o"), _C(key).alias("k"),
        F.when(sound(x), _C(x).cast("double")).alias("x"), F.when(sound(y), _C(y).cast("double")).alias("y"),
    ).dropna()
    rows = cut(rows.groupBy("graph", "o", "x", "y").agg(F.min("k").alias("k")))
    labels = cut(rows.select("graph", "o", _C("o").alias("c")).distinct())
    sizes = cut(labels.groupBy("graph").agg(F.count("*").alias("nodes")))
    wide, high, n, graphs = rows.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*"), F.countDistinct("graph")).first()
    found, left = [], labels.count() - graphs
    reach = max(((wide or 0) * (high or 0) / max(n, 1)) ** 0.5, ((wide or 0) + (high or 0)) / max(n, 1), 1e-9)
    side = lambda df, end: df.select("_cx", "_cy", *[_C(c).alias(f"{c}{end}") for c in ("graph", "o", "c", "k", "x", "y")])
    d = F.round(g.distance((_C("xa"), _C("ya")), (_C("xb"), _C("yb"))), 9)
    while left:
        cell = lambda c: F.floor(_C(c) / reach)  # noqa: B023, E731
        own = rows.join(labels.withColumnsRenamed({"graph": "_g", "o": "_o"}), (_C("graph") == _C("_g")) & (_C("o") == _C("_o"))).drop("_g", "_o")
        around = own
        for c in "xy":
            around = around.withColumn(f"_c{c}", F.explode(F.sequence(cell(c) - 1, cell(c) + 1)))
        # cells around which there is one component only have no partners
        mixed = around.groupBy(_C("graph").alias("_g"), _C("_cx").alias("_mx"), _C("_cy").alias("_my")).agg(F.min("c").alias("_l"), F.max("c").alias("_h")).where("_l <> _h").drop("_l", "_h")
        in_mixed = lambda df: df.join(mixed, (_C("graph") == _C("_g")) & (_C("_cx") == _C("_mx")) & (_C("_cy") == _C("_my")), "left_semi")  # noqa: B023, E731
        a, b = side(in_mixed(own.withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))), "a"), side(in_mixed(around), "b")
        # Spark would take nine rows for one and send them to all tasks
        met = a.join(b.withColumnsRenamed({"_cx": "_bx", "_cy": "_by"}).hint("merge"), (_C("grapha") == _C("graphb")) & (_C("_cx") == _C("_bx")) & (_C("_cy") == _C("_by")) & (_C("oa") < _C("ob")) & (_C("ca") != _C("cb")))
        pairs = met.withColumn("d", d).where(_C("d") < reach - 1e-9)  # what is no nearer may not be the nearest
        # the least distance of two outlines is a number, which needs no sort of all pairs; the keys are chosen from the few pairs that have it
        ends = ["grapha", "oa", "ob", "ca", "cb"]
        least = cut(pairs.groupBy(*ends).agg(F.min("d").alias("_d")))
        least = least.withColumnsRenamed({c: f"_{c}" for c in ends})
        links = pairs.join(least, reduce(Column.__and__, [_C(c) == _C(f"_{c}") for c in ends]) & (_C("d") == _C("_d")))
        links = links.groupBy(_C("grapha").alias("graph"), "oa", "ob", _C("ca").alias("a"), _C("cb").alias("b")).agg(F.min(F.struct("d", "ka", "kb")).alias("m"))
        edge = F.struct(_C("m.d").alias("d"), "oa", "ob", _C("m.ka").alias("ka"), _C("m.kb").alias("kb"))
        taken, roots = _forest(links.select("graph", "a", "b", edge.alias("edge")))
        found.append(taken)
        left -= taken.count()
        up = roots.select(_C("graph").alias("_g"), _C("c").alias("_c"), "root")
        labels = cut(labels.join(up, (_C("graph") == _C("_g")) & (_C("c") == _C("_c")), "left").select("graph", "o", F.coalesce("root", "c").alias("c")))
        reach *= 4
    if not found:
        empty = rows.where("false")
        return empty.select("graph", _C("o").alias("a"), _C("o").alias("b"), _C("k").alias("point_a"), _C("k").alias("point_b"), _C("x").alias("distance"))
    forest = _until(cut(reduce(DataFrame.unionAll, found)), sizes, target)
    return forest.select("graph", *[_C(f"edge.{c}").alias(n) for c, n in (("oa", "a"), ("ob", "b"), ("ka", "point_a"), ("kb", "point_b"), ("d", "distance"))])
