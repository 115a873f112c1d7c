"""Scene records from polygons, walls, zones and connections: points in scene coordinates, planes, segments, assets.

Every builder is a projection over tables of points (polygon_id, part, ord, x, y), so a scene of any number of stations is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.functions import geometry as g

_C = F.col
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def scene_points(
    points: DataFrame,
    perspective: list[float] | None = None,
    scale: float = 0.01,
    invert_x: bool = False,
    invert_y: bool = False,
    corrections: DataFrame | None = None,
    layers: DataFrame | None = None,
    shifts: DataFrame | None = None,
) -> DataFrame:
    """``points`` (polygon_id, layer, x, y and others) with x and y in the scene.

    In this order: perspective, scale and inversion, the polygon's axis
    correction (polygon_id, ox, oy, ux, uy, vx, vy: origin and axis points, in
    the scene), the layer's transform (layer, m array<double>), the polygon's
    shift (polygon_id, dx, dy).  Missing ones change nothing.
    """
    x, y = g.perspective((_C("x").cast("double"), _C("y").cast("double")), [F.lit(v) for v in perspective or IDENTITY])
    out = points.withColumn("_sx", x * (-scale if invert_x else scale)).withColumn("_sy", y * (-scale if invert_y else scale))
    if corrections is not None:
        fixed = orthogonal(corrections).withColumnRenamed("polygon_id", "_pid")
        out = out.join(fixed, _C("polygon_id") == _C("_pid"), "left")
        px, py = _C("_sx") - _C("ox"), _C("_sy") - _C("oy")
        a, b = (px * _C("i00") + py * _C("i01")), (px * _C("i10") + py * _C("i11"))
        known = _C("i00").isNotNull()
        moved = (F.when(known, _C("ox") + a * _C("tux") + b * _C("tvx")).otherwise(_C("_sx")), F.when(known, _C("oy") + a * _C("tuy") + b * _C("tvy")).otherwise(_C("_sy")))
        out = out.withColumn("_fx", moved[0]).withColumn("_sy", moved[1]).withColumn("_sx", _C("_fx")).drop(*[c for c in fixed.columns], "_fx")
    if layers is not None:
        out = out.join(layers.select(_C("layer").alias("_lid"), _C("m").alias("_m")), _C("layer") == _C("_lid"), "left")
        mx, my = g.perspective((_C("_sx"), _C("_sy")), [_C("_m")[i] for i in range(9)])
        out = out.withColumn("_fx", F.coalesce(mx, "_sx")).withColumn("_sy", F.coalesce(my, "_sy")).withColumn("_sx", _C("_fx")).drop("_lid", "_m", "_fx")
    if shifts is not None:
        out = out.join(shifts.select(_C("polygon_id").alias("_pid"), _C("dx").alias("_dx"), _C("dy").alias("_dy")), _C("polygon_id") == _C("_pid"), "left")
        out = out.withColumn("_sx", _C("_sx") + F.coalesce("_dx", F.lit(0.0))).withColumn("_sy", _C("_sy") + F.coalesce("_dy", F.lit(0.0))).drop("_pid", "_dx", "_dy")
    return out.withColumn("x", _C("_sx")).withColumn("y", _C("_sy")).drop("_sx", "_sy")


def orthogonal(corrections: DataFrame) -> DataFrame:
    """Inverse of the drawn basis and the right-angled one that replaces it, of the same lengths; degenerate ones are left out."""
    ux, uy, vx, vy = _C("ux") - _C("ox"), _C("uy") - _C("oy"), _C("vx") - _C("ox"), _C("vy") - _C("oy")
    det, lu, lv = ux * vy - vx * uy, F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    side = F.when(det >= 0, 1.0).otherwise(-1.0)
    return corrections.where((F.abs(det) > 1e-9) & (lu > 1e-9) & (lv > 1e-9)).select(
        "polygon_id", "ox", "oy", (vy / det).alias("i00"), (-vx / det).alias("i01"), (-uy / det).alias("i10"), (ux / det).alias("i11"),
        ux.alias("tux"), uy.alias("tuy"), (-uy / lu * lv * side).alias("tvx"), (ux / lu * lv * side).alias("tvy"),
    )


def _ring(points: DataFrame, by: list[str]) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("x", "y").alias("p")))), lambda s: s["p"])
    return points.groupBy(*by).agg(listed.alias("ring"))


def polygon_heights(polygons: DataFrame, floor_height: float = 5.0, default_z: float = 0.0) -> Column:
    """Height of polygons (layer, layer_z, z_offset, z_value; all nullable): the layer's, plus an offset, which beats the polygon's own height."""
    base = g.layer_z(_C("layer"), _C("layer_z"), floor_height, default_z)
    return F.coalesce(base + _C("z_offset"), _C("z_value"), base)


def planes(polygons: DataFrame, points: DataFrame, floor_height: float = 5.0, default_z: float = 0.0) -> DataFrame:
    """(name, polygon_id, layer, vertices, holes, color) of every polygon with a ring of three points or more.

    ``polygons``: polygon_id, layer, layer_z, z_offset, z_value, r, g, b;
    ``points``: polygon_id, part (0 the outer ring, then the holes), ord, x, y
    in the scene.  Outer rings run counter-clockwise, holes clockwise.
    """
    rings = _ring(points, ["polygon_id", "part"]).where(F.size("ring") >= 3)
    turned = rings.select("polygon_id", "part", F.when(_C("part") == 0, g.wound(_C("ring"))).otherwise(g.wound(_C("ring"), clockwise=True)).alias("ring"))
    lifted = lambda ring, z: F.transform(ring, lambda p: F.array(p["x"], p["y"], z))
    parts = turned.groupBy("polygon_id").agg(F.max(F.when(_C("part") == 0, _C("ring"))).alias("_outer"), F.transform(F.array_sort(F.collect_list(F.when(_C("part") > 0, F.struct("part", "ring")))), lambda s: s["ring"]).alias("_holes"))
    z = polygon_heights(polygons, floor_height, default_z)
    out = polygons.withColumn("_z", z).join(parts, "polygon_id").where("_outer is not null")
    colour = F.array(*[F.round(F.coalesce(_C(c), F.lit(200)) / 255.0, 4) for c in "rgb"], F.lit(1.0))
    return out.select(F.concat(F.lit("plane_"), "polygon_id").alias("name"), "polygon_id", "layer", lifted(_C("_outer"), _C("_z")).alias("vertices"), F.transform("_holes", lambda h: lifted(h, _C("_z"))).alias("holes"), colour.alias("color"))


def _spliced(a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray | None:
    """One ring of two; ``table`` holds the distances of a's vertices (rows) to b's."""
    if min(table.shape) < 2:
        return None
    ends = [np.argsort(table.min(axis=1 - side), kind="stable")[:2] for side in (0, 1)]
    paths = []
    for side, (own, other) in enumerate(((a, b), (b, a))):
        place, target = ends[side], other[ends[1 - side]]
        along = target[1] - target[0]
        share = np.clip((own - target[0]) @ along / max(float(along @ along), np.finfo(float).tiny), 0, 1)
        gaps = np.hypot(*(own - target[0] - share[:, None] * along).T)
        steps = (place[0] + np.arange(len(own) + 1)) % len(own)  # once around from the first end to itself
        turn = (place[1] - place[0]) % len(own)
        ways = steps[: turn + 1], steps[turn:]
        # a way faces the other ring by its eight nearest vertices, as a long way round may have one near end
        facing = [np.sort(gaps[w])[:8].mean() for w in ways]
        paths.append(own[ways[int(facing[0] <= facing[1])]])
    one, two = paths
    cross = lambda p, q: p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]
    swept = [cross(path[:-1], path[1:]).sum() for path in paths]
    straight = swept[0] + cross(one[-1], two[0]) + swept[1] + cross(two[-1], one[0])
    turned = swept[0] + cross(one[-1], two[-1]) - swept[1] + cross(two[0], one[0])
    ring = np.concatenate([one, two[::-1] if abs(turned) > abs(straight) else two])
    if max(abs(straight), abs(turned)) <= 2:  # twice the area
        return None
    ring = ring[~np.isclose(ring, np.roll(ring, 1, axis=0)).all(axis=1)]
    return ring if len(ring) >= 3 else None


def _gathered(rings: list[np.ndarray]) -> np.ndarray | None:
    """The rings spliced into the first, the nearest to what has come about next."""
    made, rest = rings[0], rings[1:]
    while rest and made is not None:
        others = np.concatenate(rest)
        table = np.hypot(*(made[:, None] - others[None]).transpose(2, 0, 1))
        begins = np.cumsum([0, *map(len, rest)])
        k = int(np.minimum.reduceat(table.min(axis=0), begins[:-1]).argmin())
        made = _spliced(made, rest.pop(k), table[:, begins[k] : begins[k + 1]])
    return made if len(rings) > 1 else None


def auto_merge(polygons: DataFrame, by: str) -> DataFrame:
    """(by, ring): the polygons (by, ord, ring) of each group spliced into one.

    The first polygon takes in the one with the nearest vertex, then the next
    nearest to what has come about.  Of each of the two the vertices nearest and
    second nearest to the other are the ends of the path that faces it; of the
    two ways between them the one nearer to the segment of the other's ends is
    dropped, and the ways that stay are joined in the direction of the larger
    area.  Groups of one polygon, and those whose result has fewer than three
    points or an area of one or less, are left out, null and empty rings too.
    Each join needs the one before, so a group, a drawing's choice of polygons,
    is one row of an Arrow batch; groups are dealt over the session's partitions.
    """
    rings = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("_rings")
            # all rings of the batch as one array of points, cut by the offsets of the nested lists
            points = groups.flatten().flatten().flatten()
            xy = np.column_stack([points.to_numpy(zero_copy_only=False)[k::2] for k in (0, 1)]) if len(points) else np.zeros((0, 2))
            ends = np.cumsum(groups.flatten().value_lengths().to_numpy())
            parts = np.split(xy, ends[:-1]) if len(ends) else []
            out, at = [], 0
            for n in groups.value_lengths().to_pylist():
                out.append(_gathered(parts[at : at + n]))
                at += n
            made = [k for k, ring in enumerate(out) if ring is not None]
            found = pa.array([[{"x": x, "y": y} for x, y in out[k].tolist()] for k in made], rings)
            yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(made, pa.int64())), found], names=[by, "ring"])

    kind = polygons.schema[by].dataType.simpleString()
    # groups are few bytes and much work: without a number of its own the exchange would be made one task
    sound = polygons.where(F.size("ring") > 0).select(by, "ord", "ring")
    spread = sound.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    inside = F.sort_array(F.collect_list(F.struct(_C("ord").isNull().alias("last"), "ord", "ring")))
    plain = F.transform(inside, lambda p: F.transform(p["ring"], lambda v: F.array(v["x"].cast("double"), v["y"].cast("double"))))
    return spread.groupBy(by).agg(plain.alias("_rings")).mapInArrow(run, f"`{by}` {kind}, ring array<struct<x: double, y: double>>")


def wall_segments(walls: DataFrame) -> DataFrame:
    """(wall_id, segment, x0, y0, x1, y1, length, angle_deg) of consecutive wall points (wall_id, ord, x, y); points that repeat make none."""
    w = Window.partitionBy("wall_id").orderBy("ord")
    s = walls.select("wall_id", "ord", _C("x").alias("x0"), _C("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")
    s = s.withColumn("length", g.distance((_C("x0"), _C("y0")), (_C("x1"), _C("y1")))).where("length > 1e-9")
    return s.select("wall_id", F.row_number().over(w).alias("segment"), "x0", "y0", "x1", "y1", "length", g.facing_degrees((_C("x0"), _C("y0")), (_C("x1"), _C("y1"))).alias("angle_deg"))


def connection_assets(connections: DataFrame, width: float = 1.0) -> DataFrame:
    """(connection_id, type, lower, upper, center, rotation_deg, rise) of connections between two heights.

    ``connections``: connection_id, type, x0, y0, z0, x1, y1, z1 (centres of
    both ends).  Each end gets a line of ``width`` across the way; the lower
    end comes first.
    """
    point = lambda x, y, z: F.array(x, y, z)
    a, b = (_C("x0"), _C("y0")), (_C("x1"), _C("y1"))
    swap = _C("z0") > _C("z1")
    lines = []
    for here, there, z in ((a, b, _C("z0")), (b, a, _C("z1"))):
        p, q = g.perpendicular_line(here, there, width)
        lines.append(F.array(point(*p, z), point(*q, z)))
    center = point(*[(_C(f"{c}0") + _C(f"{c}1")) / 2 for c in "xyz"])
    turn = F.when(swap, g.facing_degrees(b, a)).otherwise(g.facing_degrees(a, b))
    return connections.select("connection_id", "type", F.when(swap, lines[1]).otherwise(lines[0]).alias("lower"), F.when(swap, lines[0]).otherwise(lines[1]).alias("upper"), center.alias("center"), turn.alias("rotation_deg"), F.abs(_C("z1") - _C("z0")).alias("rise"))


def attach_assets(connections: DataFrame, assets: DataFrame) -> DataFrame:
    """Connections with the last asset (connection_id, ord, asset_id) of their id."""
    last = assets.groupBy("connection_id").agg(F.max_by("asset_id", "ord").alias("asset_id"))
    return connections.join(last, "connection_id", "left")


def bands(values: DataFrame, by: str, value: str, k: int, rounds: int = 50) -> DataFrame:
    """Rows with the ``band`` (0 to k - 1, ascending) of a one-dimensional k-means that starts from equal shares of the sorted values; a group is one drawing's."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        centres = np.array([part.mean() for part in np.array_split(np.sort(x), min(k, len(x)))])
        for _ in range(rounds):
            label = np.abs(x[:, None] - centres[None, :]).argmin(axis=1)
            moved = np.array([x[label == i].mean() if (label == i).any() else c for i, c in enumerate(centres)])
            if np.allclose(moved, centres):
                break
            centres = moved
        out = pdf.copy()
        out["band"] = np.argsort(np.argsort(centres))[label].astype("int32")
        return out

    return values.groupBy(by).applyInPandas(run, ", ".join(f"`{c}` {t}" for c, t in values.dtypes) + ", band int")


def effective_layer(polygons: DataFrame, annotated: DataFrame) -> DataFrame:
    """Polygons (polygon_id, semantic_layer) with the annotated layer, else the semantic one."""
    return polygons.join(annotated.select("polygon_id", _C("layer").alias("_a")), "polygon_id", "left").withColumn("layer", F.coalesce("_a", "semantic_layer")).drop("_a")
