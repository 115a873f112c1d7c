"""Navigation graphs from records of connections, assets, platforms and elevators, of any number of stations in one plan.

Every kind of node and edge is a projection of its records; zones are joined by
place, and keys are dense numbers in the order of the ids, given by range
partition and offsets, so no station is one task's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.operators import spatial as sp
from floorgraph.sources.shared import cut, dealt

_C = F.col
# What the records' types are called.
OUTWARD, OUTSIDE = ("exit_stair", "exit_escalator"), "OUTSIDE"
ASSETS = ("subway", "moving_walkway", "ticket_gate", "exit", "toilet")
GATE_OFFSET, FACING_OFFSET, GATE_COST = 1.0, 0.4, 10.0
NODE = ["graph", "node_id", "type", "layer", "polygon_id", "position", "source_id", "detail", "exit_number", "zone_type", "zone_id"]
EDGE = ["graph", "edge_id", "from", "to", "type", "connector_type", "cost", "bidirectional"]


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str = "number", ranged: bool = False) -> DataFrame:
    """``rows`` with dense numbers from 1 within each group, in the given order.

    A range exchange puts them in order, unless they are ``ranged`` by group and
    order already; a partition's rows are counted by group and what lies before
    is added, so a group may span any number of partitions.  Rows equal in the
    order get neighbouring numbers.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = (rows if ranged else rows.repartitionByRange(group, *order)).sortWithinPartitions(group, *order)
    placed = cut(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", at))
    parts = placed.groupBy(_C("_part").alias("_p"), _C(group).alias("_g")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition and group: written, as the size of files tells Spark that the rows need no exchange to meet them
    parts = cut(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    joined = placed.join(parts, (_C("_part") == _C("_p")) & _C(group).eqNullSafe(_C("_g")))
    return joined.select(*rows.columns, (_C("_before") + _C("_at") - _C("_first") + 1).alias(name))


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (F.coalesce(p, F.lit(0.0)) - F.coalesce(q, F.lit(0.0))) * (F.coalesce(p, F.lit(0.0)) - F.coalesce(q, F.lit(0.0)))), F.lit(0.0), lambda s, d: s + d))


def _part(position: Column, k: int) -> Column:
    """A coordinate, null where there is none: Spark may look at records that a condition beside it leaves out."""
    return F.get(position, F.lit(k))


def _moved(position: Column, dx: Column, dy: Column) -> Column:
    return F.array(_part(position, 0) + dx, _part(position, 1) + dy, F.coalesce(F.get(position, F.lit(2)), F.lit(0.0)))


def faced(position: Column, angle: Column, target: Column, by: float) -> Column:
    """A position moved by so much along an angle in degrees, else towards a target, else along x."""
    dx, dy = (_part(target, k) - _part(position, k) for k in (0, 1))
    length = F.sqrt(dx * dx + dy * dy)
    along = lambda f, d, none: F.coalesce(f(F.radians(angle)), F.when(length > 1e-9, d / length), F.lit(none)) * by
    return _moved(position, along(F.cos, dx, 1.0), along(F.sin, dy, 0.0))


def _node(node_id: Column, type_: Column, position: Column, source: Column, layer: str = "layer", polygon: str = "polygon_id", **extra: Column) -> list[Column]:
    values = {"graph": _C("graph"), "node_id": node_id, "type": type_, "layer": _C(layer), "polygon_id": _C(polygon), "position": position, "source_id": source} | extra
    return [values.get(c, F.lit(None).cast("string")).alias(c) for c in NODE]


def _edge(edge_id: Column, from_: Column, to: Column, type_: Column, cost: Column, connector: Column | None = None, both: Column | None = None) -> list[Column]:
    values = (_C("graph"), edge_id, from_, to, type_, F.lit(None).cast("string") if connector is None else connector, cost, F.lit(True) if both is None else both)
    return [v.alias(c) for v, c in zip(values, EDGE, strict=True)]


def _named(*parts: Column | str) -> Column:
    return F.concat_ws("_", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def connection_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of connections: two connectors and a vertical edge, or of a way out the one end that is inside."""
    rows = rows.where("connection_id is not null and from_position is not null and to_position is not null")
    connector = F.coalesce("asset_type", "type", F.lit("connector"))
    outward = F.coalesce(_C("type").isin(*OUTWARD), F.lit(False))
    height = lambda end: F.coalesce(F.get(_C(f"{end}_position"), F.lit(2)), F.lit(0.0))
    known, inside = (lambda end: _C(f"{end}_polygon").isNotNull()), (lambda end: ~_C(f"{end}_layer").eqNullSafe(F.lit(OUTSIDE)))
    keep_from = F.when(known("from") != known("to"), known("from")).when(inside("from") != inside("to"), inside("from")).otherwise(height("from") <= height("to"))
    ends = []
    for end, stays in (("from", keep_from), ("to", ~keep_from)):
        type_ = F.when(outward, "exit").otherwise("connector")
        kept = rows.where(~outward | stays)
        ends.append(kept.select(*_node(_named(_C("connection_id"), end), type_, _C(f"{end}_position"), _C("connection_id"), f"{end}_layer", f"{end}_polygon", detail=connector, exit_number=_C("exit_number"))))
    inner = rows.where(~outward)
    ids = [_named(_C("connection_id"), end) for end in ("from", "to")]
    edges = inner.select(*_edge(_named(_C("connection_id"), "edge"), *ids, F.lit("vertical"), _apart(_C("from_position"), _C("to_position")), connector, F.coalesce("bidirectional", F.lit(True))))
    return ends[0].unionAll(ends[1]), edges


def asset_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of assets: a gate has a public front and a paid back and the crossing between them, others one node; a toilet's lies before it."""
    rows = rows.withColumn("_id", F.coalesce("asset_id", "label")).where(_C("type").isin(*ASSETS) & _C("location").isNotNull() & _C("_id").isNotNull())
    gates = rows.where("type = 'ticket_gate'")
    angle = F.radians(F.coalesce("rotation_z", F.lit(0.0)))
    sides = [_moved(_C("location"), sign * GATE_OFFSET * F.cos(angle), sign * GATE_OFFSET * F.sin(angle)) for sign in (1, -1)]
    gates = gates.select("*", sides[0].alias("_s0"), sides[1].alias("_s1"))
    nearer = lambda p: _apart(_C(p), _C("_s0")) <= _apart(_C(p), _C("_s1"))
    first = F.when(_C("paid_side").isNotNull(), ~nearer("paid_side")).when(_C("public_side").isNotNull(), nearer("public_side")).otherwise(F.lit(True))
    nodes = []
    for side, zone, at in (("front", "public", F.when(first, _C("_s0")).otherwise(_C("_s1"))), ("back", "paid", F.when(first, _C("_s1")).otherwise(_C("_s0")))):
        nodes.append(gates.select(*_node(_named(_C("_id"), side, "node"), F.lit("gate"), at, _C("_id"), detail=F.lit(side), zone_type=F.lit(zone), zone_id=_named(_C("_id"), side))))
    crossing = F.coalesce(F.nullif(_C("cost"), F.lit(0.0)), F.lit(GATE_COST))
    edges = gates.select(*_edge(_named(_C("_id"), "gate_crossing"), _named(_C("_id"), "front", "node"), _named(_C("_id"), "back", "node"), F.lit("gate_crossing"), crossing))
    plain, toilet = rows.where("type <> 'ticket_gate'"), _C("type") == "toilet"
    type_ = F.when(_C("type") == "exit", "exit").when(toilet, "poi").otherwise("asset")
    at = F.when(toilet, faced(_C("location"), _C("rotation_z"), _C("facing"), FACING_OFFSET)).otherwise(_C("location"))
    nodes.append(plain.select(*_node(_named(_C("_id"), "node"), type_, at, _C("_id"), detail=_C("type"))))
    return reduce(DataFrame.unionAll, nodes), edges


def platform_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of platforms' doors, and walks from each to the next of its platform."""
    rows = rows.where("node_id is not null and position is not null")
    w = Window.partitionBy("graph", "platform_id").orderBy("ord", "node_id")
    chain = rows.withColumn("_id", F.lag("node_id").over(w)).withColumn("_at", F.lag("position").over(w)).where("_id is not null")
    edges = chain.select(*_edge(F.concat(_C("_id"), F.lit("_to_"), _C("node_id")), _C("_id"), _C("node_id"), F.lit("platform_walk"), _apart(_C("_at"), _C("position"))))
    return rows.select(*_node(_C("node_id"), F.lit("platform_position"), _C("position"), _C("platform_id"), detail=_C("car_door"))), edges


def elevator_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of elevators' stops, a step before each, and edges between all stops of an elevator that does not lead out."""
    rows = rows.where("elevator_point_id is not null and position is not null")
    rows = rows.withColumn("_at", faced(_C("position"), _C("facing_angle"), _C("facing"), FACING_OFFSET)).withColumn("_id", _named(_C("elevator_point_id"), "node"))
    out = F.coalesce("exit", F.lit(False))
    nodes = rows.select(*_node(_C("_id"), F.when(out, "exit_elevator").otherwise("elevator"), _C("_at"), _C("elevator_id"), exit_number=F.when(out, _C("exit_number"))))
    stops = rows.where(~out & _C("elevator_id").isNotNull())
    stops = dealt(stops, "graph", "elevator_id").select("graph", "elevator_id", "_id", "_at", F.row_number().over(Window.partitionBy("graph", "elevator_id").orderBy("ord", "_id")).alias("_n"))
    other = stops.select(*[_C(c).alias(f"{c}_2") for c in stops.columns])
    pairs = stops.join(other, (_C("graph") == _C("graph_2")) & (_C("elevator_id") == _C("elevator_id_2")) & (_C("_n") < _C("_n_2")))  # an elevator's stops
    edge_id = F.concat(_named(_C("elevator_id"), _C("_n")), F.lit("_to_"), _C("_n_2"))
    return nodes, pairs.select(*_edge(edge_id, _C("_id"), _C("_id_2"), F.lit("elevator"), _apart(_C("_at"), _C("_at_2"))))


_PLACE = ["graph", "node_id", "layer", "_x", "_y"]


def _beside(nodes: DataFrame, zones: DataFrame) -> DataFrame:
    """``nodes``, and beside them a row of its place and first zone ``_z`` for each that lacks a zone and lies in one."""
    at = nodes.withColumn("_x", _part(_C("position"), 0)).withColumn("_y", _part(_C("position"), 1))
    rings = zones.select(_C("graph").alias("_g"), F.struct("ord", "zone_id", "zone_type").alias("_z"), _C("layer").alias("_l"), _C("ring").alias("_r"))
    hits = sp.points_in_rings(at.where("zone_type is null").select(*_PLACE), rings, "node_id", "_x", "_y", "_z", "_r", keep=["_g", "_l"])
    hits = hits.where((_C("graph") == _C("_g")) & F.coalesce(_C("_l") == _C("layer"), F.lit(True)))
    best = hits.groupBy(*_PLACE).agg(F.min("_z").alias("_z"))
    return at.withColumn("_node", F.lit(True)).unionByName(best.withColumn("_node", F.lit(False)), allowMissingColumns=True)


def _with_zone(rows: DataFrame, columns: Sequence[str], default: str) -> DataFrame:
    """The nodes among the rows of :func:`_beside`, each with the zone of its place."""
    found = {"zone_type": F.coalesce("zone_type", "_z.zone_type", F.lit(default)), "zone_id": F.coalesce("zone_id", "_z.zone_id")}
    rows = rows.withColumn("_z", F.min("_z").over(Window.partitionBy(*_PLACE))).where("_node")
    return rows.select(*[found[c].alias(c) if c in found else _C(c) for c in columns])


def zoned(nodes: DataFrame, zones: DataFrame, default: str = "public") -> DataFrame:
    """``nodes`` with the zone that they lack: the first (by ``ord``) of their graph and layer around them, else ``default``.

    ``zones``: graph, zone_id, zone_type, layer, ord, ring; one without a layer is in all, a node without one in any.
    """
    return _with_zone(_beside(nodes, zones), nodes.columns, default)


def build_nodes(connections: DataFrame, assets: DataFrame, platforms: DataFrame, elevators: DataFrame, zones: DataFrame) -> DataFrame:
    """The nodes of :func:`build_graph`."""
    parts = (connection_parts(connections), asset_parts(assets), platform_parts(platforms), elevator_parts(elevators))
    nodes = reduce(DataFrame.unionAll, [n for n, _ in parts])
    # one range exchange, by which nodes meet their zones and get their keys
    ranged = _beside(nodes, zones).repartitionByRange("graph", "node_id")
    keyed = numbered(_with_zone(ranged, nodes.columns, "public"), "graph", ["node_id"], "node_key", ranged=True)
    return keyed.withColumn("node_key_str", F.format_string("N%04d", "node_key"))


def build_edges(connections: DataFrame, assets: DataFrame, platforms: DataFrame, elevators: DataFrame) -> DataFrame:
    """The edges of :func:`build_graph`, which need no node."""
    parts = (connection_parts(connections), asset_parts(assets), platform_parts(platforms), elevator_parts(elevators))
    return reduce(DataFrame.unionAll, [e for _, e in parts])


def build_graph(connections: DataFrame, assets: DataFrame, platforms: DataFrame, elevators: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, with dense keys by id within each graph, and edges; all records have a ``graph``, the station.

    Connections: connection_id, type, asset_type, exit_number, bidirectional and
    for both ends from\\_/to\\_ layer, polygon and position.  Assets: asset_id,
    label, type, layer, polygon_id, location, rotation_z, facing, public_side,
    paid_side, cost.  Platforms, a row a door: platform_id, layer, polygon_id,
    ord, node_id, position, car_door.  Elevators, a row a stop: elevator_id,
    elevator_point_id, ord, layer, polygon_id, position, facing_angle, facing,
    exit, exit_number.  Zones: see :func:`zoned`.  Positions and sides are
    array<double> of two or three numbers.  Records without an id or a position
    make nothing.
    """
    return build_nodes(connections, assets, platforms, elevators, zones), build_edges(connections, assets, platforms, elevators)
