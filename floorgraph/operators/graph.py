"""Navigation graphs as node and edge tables: weights, shortest paths, components, propagation.

Every operator takes a ``graph`` column along (a station, a preference), so
many graphs are answered in one pass; nothing is looped over on the driver but
the rounds of an iteration, each written to the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.operators import held
from floorgraph.sources.shared import cut, dealt, new_folder, stored, unsent

PREFERENCES = ("none", "elevator")
_C = F.col


def zone_of(zone_type: Column) -> Column:
    """Lower-cased zone; missing and free zones are public."""
    zone = F.lower(F.trim(F.coalesce(zone_type, F.lit("public"))))
    return F.when(zone.isin("", "free"), "public").otherwise(zone)


def zone_signature(node_type: Column, zone_type: Column, zone_id: Column, zone_label: Column) -> Column:
    """Routing zone of a node; gates stand for the zone that they open."""
    zone, gate = zone_of(zone_type), node_type == "gate"
    key = F.when(gate & (zone == "paid") & (F.coalesce(zone_label, F.lit("")) != ""), zone_label).when(gate & (zone == "public"), F.lit("")).otherwise(F.coalesce(zone_id, F.lit("")))
    return F.struct(zone.alias("zone"), key.alias("key"))


def transport_mode(edge_type: Column, connector_type: Column) -> Column:
    kind, connector = F.lower(F.coalesce(edge_type, F.lit(""))), F.lower(F.coalesce(connector_type, F.lit("")))
    return (
        F.when((kind == "elevator") | (connector == "elevator"), "elevator")
        .when(connector.isin("escalator", "stair"), connector)
        .when(kind.isin("escalator", "stair"), kind)
    )


def preference_multiplier(mode: Column, preference: Column) -> Column:
    """Elevators cost eightfold unless they are preferred, when they are cheap and stairs and escalators dear."""
    wants = preference == "elevator"
    return (
        F.when(mode.isNull(), 1.0)
        .when(mode == "elevator", F.when(wants, 0.15).otherwise(8.0))
        .when(wants & (mode == "escalator"), 3.0)
        .when(wants & (mode == "stair"), 10.0)
        .otherwise(1.0)
    )


def _point_distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def route_edges(
    nodes: DataFrame,
    edges: DataFrame,
    preferences: DataFrame,
    same_layer: bool = True,
    same_polygon: bool = True,
    radius: float | None = None,
    zone_change_penalty: float = 100.0,
    paid_penalty: float = 1000.0,
) -> DataFrame:
    """Directed, weighted edges for each preference.

    ``nodes``: node_id, type, layer, polygon_id, position array<double>,
    zone_type, zone_id, zone_label.  ``edges``: edge_id, from, to, type,
    connector_type, cost, bidirectional.  ``preferences``: preference.
    Edges with unknown ends go, and those between paid and public zones unless
    they cross a gate.  A cost of zero is a missing one: the distance counts.
    Nodes of one layer, zone and polygon get walking edges, unless both are gates.
    """
    sig = nodes.select(
        "node_id", "type", "layer", "polygon_id", "position", zone_of(_C("zone_type")).alias("zone"),
        zone_signature(_C("type"), _C("zone_type"), _C("zone_id"), _C("zone_label")).alias("sig"),
    )
    end = lambda s: sig.select(*[_C(c).alias(f"{s}_{c}") for c in sig.columns])
    known = edges.join(end("a"), _C("from") == _C("a_node_id")).join(end("b"), _C("to") == _C("b_node_id"))
    crossing = ((_C("a_zone") == "paid") & (_C("b_zone") == "public")) | ((_C("a_zone") == "public") & (_C("b_zone") == "paid"))
    known = known.where(~crossing | (F.lower(F.coalesce("type", F.lit(""))) == "gate_crossing"))
    mode = transport_mode(_C("type"), _C("connector_type"))
    penalty = F.when(mode.isNotNull() | (_C("a_sig") == _C("b_sig")), 0.0).when(crossing, paid_penalty).otherwise(zone_change_penalty)
    base = F.coalesce(F.nullif(_C("cost"), F.lit(0.0)), _point_distance("a_position", "b_position"))
    columns = ["edge_id", "from", "to", "mode", "base_cost", "zone_penalty", "synthetic", "bidirectional"]
    explicit = known.select("edge_id", "from", "to", mode.alias("mode"), base.alias("base_cost"), penalty.alias("zone_penalty"), F.lit(False).alias("synthetic"), F.coalesce("bidirectional", F.lit(True)).alias("bidirectional"))
    both = explicit
    if same_layer:
        a, b = end("a").where("a_layer is not null and a_position is not null"), end("b").where("b_position is not null")
        region = (_C("a_layer") == _C("b_layer")) & (_C("a_sig") == _C("b_sig")) & (_C("a_node_id") < _C("b_node_id"))
        if same_polygon:
            region = region & _C("a_polygon_id").eqNullSafe(_C("b_polygon_id"))
        walk = a.join(b, region).where(~((_C("a_type") == "gate") & (_C("b_type") == "gate")))
        walk = walk.withColumn("base_cost", _point_distance("a_position", "b_position"))
        if radius is not None:
            walk = walk.where(_C("base_cost") <= radius)
        walk = walk.select(
            F.concat(F.lit("walk_"), "a_node_id", F.lit("_to_"), "b_node_id").alias("edge_id"), _C("a_node_id").alias("from"), _C("b_node_id").alias("to"),
            F.lit(None).cast("string").alias("mode"), "base_cost", F.lit(0.0).alias("zone_penalty"), F.lit(True).alias("synthetic"), F.lit(True).alias("bidirectional"),
        )
        both = explicit.unionByName(walk)
    back = both.where("bidirectional").select(F.concat(F.coalesce("edge_id", F.lit("edge")), F.lit("_reverse")).alias("edge_id"), _C("to").alias("from"), _C("from").alias("to"), *columns[3:])
    multiplier = F.when(_C("synthetic"), 1.0).otherwise(preference_multiplier(_C("mode"), _C("preference")))
    weighted = both.select(*columns).unionByName(back).join(F.broadcast(preferences))  # two preferences
    return weighted.select("preference", *columns[:-1], multiplier.alias("multiplier"), (_C("base_cost") * multiplier + _C("zone_penalty")).alias("route_cost"))


_REACHED = ["graph", "source", "node"]
#: Links of a graph, and nodes of a tree, that a task holds; a Python worker took 337 MB for graphs of 2.2 million links.
HELD = 4_000_000
#: Sources that a task solves a graph for; its links are sent once for each so many.
_SOURCES = 16


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int | None = None, delta: float | None = None) -> DataFrame:
    """(graph, source, node, cost, hops, previous) of every reachable node.

    ``edges``: graph, from, to, cost (not negative; null costs and ends lead
    nowhere); ``sources``: graph, node.  Of equal costs the fewest hops and then
    the smallest previous node stay.

    A round relaxes the edges of the front, which are the rows that got cheaper
    or shorter in the round before, and appends what improved to a log in the
    shared folder; nothing else is written, and what is settled is only looked
    up by the keys of the offers.  With ``delta`` only rows below a bound are
    relaxed, until none of them improves; then the bound moves above the cheapest
    row left, to the next multiple of ``delta`` and after each time of twice as
    much: fewer rows are improved again and again, at the price of more rounds,
    but of no more bounds than the dearest route has bits.
    """
    spark, node = sources.sparkSession, sources.schema["node"].dataType
    log = new_folder(spark, "shortest")
    links = edges.where("cost is not null").groupBy(_C("graph").alias("_graph"), _C("from").alias("_from"), _C("to").alias("_to")).agg(F.min("cost").alias("_cost"))
    links = stored(links.where("_to is not null"), f"{log}-links")
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast(node).alias("previous"))
    front = stored(sources.distinct().select("graph", _C("node").alias("source"), "node", start.alias("best"), F.lit(True).alias("moved")), f"{log}/round=0")
    known = lambda: spark.read.schema(front.schema).parquet(log).drop("round")
    least = lambda rows, name: rows.groupBy(*_REACHED).agg(F.min("best").alias(name))
    bound = delta
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        near = front.where("moved")
        if bound is not None:
            near = near.where(_C("best.cost") < bound)
        if near.isEmpty():
            if bound is None:
                break
            # what was relaxed is below the bound, so that what is not is the rest
            rest = least(known(), "best").where(_C("best.cost") >= bound)
            cheapest = rest.agg(F.min("best.cost")).first()[0]
            if cheapest is None:
                break
            delta *= 2
            bound = max(math.floor(cheapest / delta) * delta + delta, math.nextafter(cheapest, math.inf))
            near = rest.where(_C("best.cost") < bound)
        rounds += 1
        reached = F.struct(F.round(_C("best.cost") + _C("_cost"), 9).alias("cost"), (_C("best.hops") + 1).alias("hops"), _C("node").alias("previous"))
        met = near.join(links, (_C("graph") == _C("_graph")) & (_C("node") == _C("_from")))
        offers = stored(least(met.select("graph", "source", _C("_to").alias("node"), reached.alias("best")), "offer"), f"{log}-offers/round={rounds}")
        # a short list of offers goes to the tasks that read the log, by Spark's own rule, and only their keys' rows come back
        before = least(known().join(offers.select(*_REACHED), _REACHED, "left_semi"), "best")
        way = lambda c: F.struct(f"{c}.cost", f"{c}.hops")
        better = offers.join(before, _REACHED, "left").where(_C("best").isNull() | (_C("offer") < _C("best")))
        front = stored(better.select(*_REACHED, _C("offer").alias("best"), (_C("best").isNull() | (way("offer") < way("best"))).alias("moved")), f"{log}/round={rounds}")
    return least(known(), "best").select(*_REACHED, "best.cost", "best.hops", "best.previous")


def cheapest(edges: DataFrame, sources: DataFrame, delta: float | None = None) -> DataFrame:
    """The same as :func:`shortest_paths`, which only graphs of more links than a task holds go through.

    Of the others a task takes the links of a graph and up to about ``_SOURCES`` of its sources, and
    solves them one by one, so that nothing but the links is exchanged, once.  Graphs with costs
    below zero, NaN or infinite go through the rounds, too, as such costs have no place in that order.
    """
    kind = {c: sources.schema[c].dataType.simpleString() for c in ("graph", "node")}
    links = cut(edges.where("graph is not null and cost is not null and `from` is not null and `to` is not null").select("graph", "from", "to", _C("cost").cast("double").alias("cost")))
    starts = cut(sources.select("graph", "node").distinct())
    odd = (_C("cost") < 0) | (_C("cost") >= math.inf)  # NaN is above all
    sizes = cut(links.groupBy("graph").agg(F.count("*").alias("n"), F.max(odd).alias("odd")))
    large = sizes.where((_C("n") > HELD) | _C("odd")).select("graph")
    many = large.count()
    small, few = links, starts
    if many:
        small, few = (x.join(unsent(large, many), "graph", "left_anti") for x in (links, starts))
    parts = few.groupBy("graph").agg(F.ceil(F.count("*") / F.lit(_SOURCES)).alias("_parts"))
    spread = small.join(unsent(parts), "graph").select("graph", F.explode(F.sequence(F.lit(0).cast("bigint"), _C("_parts") - 1)).alias("_part"), _C("from").cast(kind["node"]).alias("_a"), _C("to").cast(kind["node"]).alias("_b"), _C("cost").alias("_cost"))
    part = F.pmod(F.xxhash64("node"), "_parts")
    asked = few.join(unsent(parts.withColumnRenamed("graph", "_graph")), _C("graph").eqNullSafe(_C("_graph"))).select("graph", part.alias("_part"), _C("node").alias("_a"), F.lit(None).cast(kind["node"]).alias("_b"), F.lit(None).cast("double").alias("_cost"))
    rows = dealt(spread.unionByName(asked), "graph", "_part")
    columns = {"graph": kind["graph"], "source": kind["node"], "node": kind["node"], "cost": "double", "hops": "int", "previous": kind["node"]}
    found = rows.groupBy("graph", "_part").applyInArrow(held.solver(list(columns)), ", ".join(f"{c} {t}" for c, t in columns.items()))
    if many:
        rest = [x.join(unsent(large, many), "graph", "left_semi") for x in (links, starts)]
        found = found.unionByName(shortest_paths(*rest, delta=delta))
    return cut(found)


def paths(shortest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(graph, source, goal, cost, hops, nodes) of each wanted pair that there is a way for, once.

    A task follows the previous nodes of a source's tree, of up to ``HELD`` nodes; larger ones are
    followed by :func:`_doubled`.
    """
    asked = cut(wanted.select("graph", "source", "goal").where("graph is not null and source is not null and goal is not null").distinct())
    by = ["graph", "source"]
    roots = cut(asked.select(*by).distinct())
    tree = cut(shortest.select(*_REACHED, "cost", "hops", "previous").join(unsent(roots), by, "left_semi"))
    large = cut(tree.groupBy(*by).agg(F.count("*").alias("n")).where(_C("n") > HELD).select(*by))
    many = large.count()
    small, few = tree, asked
    if many:
        small, few = (x.join(unsent(large, many), by, "left_anti") for x in (tree, asked))
    kind = {c: tree.schema[c].dataType.simpleString() for c in tree.columns}
    goals = few.select(*by, _C("goal").cast(kind["node"]).alias("node"), *[F.lit(None).cast(kind[c]).alias(c) for c in ("cost", "hops", "previous")])
    columns = {"graph": kind["graph"], "source": kind["source"], "goal": kind["node"], "cost": kind["cost"], "hops": "int", "nodes": f"array<{kind['node']}>"}
    found = dealt(small.unionByName(goals), *by).groupBy(*by).applyInArrow(held.walker(list(columns)), ", ".join(f"{c} {t}" for c, t in columns.items()))
    if many:
        found = found.unionByName(_doubled(*[x.join(unsent(large, many), by, "left_semi") for x in (tree, asked)]))
    return found


def _doubled(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """The ways by doubling: from the previous nodes follow those two steps back, from these
    the ones four back, and so on.  A goal's way is then filled from its coarse
    steps to its fine ones, in as many rounds as the longest way has bits.
    """
    spark = asked.sparkSession
    folder = new_folder(spark, "paths")
    ends = asked.join(tree.withColumnRenamed("node", "goal"), ["graph", "source", "goal"])
    way = ["graph", "source", "goal", "cost", "hops"]
    steps = stored(ends.select(*way, _C("goal").alias("node"), F.lit(0).alias("back")), f"{folder}/steps/level=0")
    longest = steps.agg(F.max("hops")).first()[0] or 0
    jumps = [tree.where("previous is not null").select(*_REACHED, _C("previous").alias("ahead"))]
    while 2 ** len(jumps) <= longest:
        on = jumps[-1].select("graph", "source", _C("node").alias("ahead"), _C("ahead").alias("_further"))
        doubled = jumps[-1].join(on, ["graph", "source", "ahead"]).select(*_REACHED, _C("_further").alias("ahead"))
        jumps.append(stored(doubled, f"{folder}/jumps{len(jumps)}"))
    found = lambda: spark.read.schema(steps.schema).parquet(f"{folder}/steps").drop("level")
    for k in reversed(range(len(jumps))):
        between = found().where(_C("back") + 2**k <= _C("hops")).join(jumps[k], _REACHED)
        stored(between.select(*way, _C("ahead").alias("node"), (_C("back") + 2**k).alias("back")), f"{folder}/steps/level={k + 1}")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct((-_C("back")).alias("at"), "node"))), lambda s: s["node"])
    return found().groupBy(*way).agg(in_order.alias("nodes"))


def via_waypoint(costs: DataFrame, waypoints: DataFrame) -> DataFrame:
    """(graph, source, goal, waypoint, cost): the best of the waypoints for each pair that reaches one; of equals the smallest."""
    first = costs.join(waypoints, costs["node"] == waypoints["waypoint"]).select("graph", "source", "waypoint", _C("cost").alias("_first"))
    second = costs.select(_C("graph").alias("_g"), _C("source").alias("_w"), _C("node").alias("goal"), _C("cost").alias("_second"))
    both = first.join(second, (_C("graph") == _C("_g")) & (_C("waypoint") == _C("_w"))).where(_C("source") != _C("goal"))
    best = both.groupBy("graph", "source", "goal").agg(F.min(F.struct(F.round(_C("_first") + _C("_second"), 6).alias("cost"), "waypoint")).alias("b"))
    return best.select("graph", "source", "goal", "b.waypoint", "b.cost")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; nodes without edges are their own component.

    In a round a node takes the least label next to it, the node that it is labelled with takes the
    least that any of its own has met, and labels are followed one step: a chain needs rounds with
    the logarithm of its length, in whatever order its nodes are.
    """
    both = cut(edges.select(_C("from").alias("a"), _C("to").alias("b")).unionAll(edges.select(_C("to").alias("a"), _C("from").alias("b"))).distinct())
    labels = cut(nodes.where("node is not null").select("node", _C("node").alias("component")).distinct())
    n = labels.count()
    while True:
        near = both.join(unsent(labels, n), _C("b") == _C("node")).groupBy("a").agg(F.min("component").alias("_near"))
        met = cut(near.join(unsent(labels, n), _C("a") == _C("node")).where(_C("_near") < _C("component")).select("a", "component", "_near"))
        offered = met.count()
        if not offered:  # all ends of edges have one label, so that each label has itself
            return labels
        offers = met.select("a", "_near").unionAll(met.select(_C("component").alias("a"), "_near")).groupBy("a").agg(F.min("_near").alias("_offer"))
        low = labels.join(unsent(offers, 2 * offered), _C("node") == _C("a"), "left").select("node", "component", F.least("component", F.coalesce("_offer", "component")).alias("_low"))
        far = labels.select(_C("node").alias("_n"), _C("component").alias("_far"))
        labels = cut(low.join(unsent(far, n), _C("_low") == _C("_n")).select("node", _C("_far").alias("component")))


def propagate(nodes: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """Scale and offset of every node, composed along a tree from the root: T[child] = T[parent] after M.

    ``links``: parent, child, scale, offset, one row for each child; breadth-first, a round a level.
    """
    level = nodes.where(_C("node") == F.lit(root)).select("node", F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.lit(0).alias("depth"))
    links = cut(links.select("parent", "child", _C("scale").alias("_s"), _C("offset").alias("_o")))
    done = level = cut(level)
    while True:
        level = cut(
            level.join(links, _C("node") == _C("parent")).join(done.select(_C("node").alias("_done")), _C("child") == _C("_done"), "left_anti")
            .select(_C("child").alias("node"), (_C("scale") * _C("_s")).alias("scale"), (_C("scale") * _C("_o") + _C("offset")).alias("offset"), (_C("depth") + 1).alias("depth"))
        )
        if level.limit(1).count() == 0:
            return done
        done = done.unionByName(level)


def chain_edges(rows: DataFrame, by: str, order: list[str], node: str, prefix: str) -> DataFrame:
    """Edges between consecutive nodes of each group."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = rows.select(by, *[c for c in order if c != node], _C(node).alias("to")).withColumn("from", F.lag("to").over(w.orderBy(*["to" if c == node else c for c in order])))
    return rows.where("from is not null").select(F.concat_ws("_", F.lit(prefix), "from", "to").alias("edge_id"), "from", "to")


def clique_edges(rows: DataFrame, by: list[str], node: str, prefix: str) -> DataFrame:
    """Edges between all pairs of a group's nodes, each once; groups are the stops of one elevator."""
    a, b = rows.select(*by, _C(node).alias("from")), rows.select(*by, _C(node).alias("to"))
    return a.join(b, by).where(_C("from") < _C("to")).select(F.concat_ws("_", F.lit(prefix), "from", "to").alias("edge_id"), "from", "to")
