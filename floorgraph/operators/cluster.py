"""Clustering and matching: assignment to centres, k-means, principal angles, suppression of overlaps, homographies."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.operators import grid
from floorgraph.sources.shared import cut

_C = F.col


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def assign(points: DataFrame, centres: DataFrame, point_id: str, vector: str) -> DataFrame:
    """(point, label, distance, rank): nearest of the centres (label, centre), of equals the least label.

    ``rank`` renumbers the labels by their number of points.  The k centres go
    to every task.
    """
    near = points.select(point_id, vector).join(F.broadcast(centres)).groupBy(point_id).agg(F.min(F.struct(F.round(squared_distance(vector, "centre"), 9).alias("d"), "label")).alias("b"))
    near = near.select(point_id, _C("b.label").alias("label"), F.sqrt("b.d").alias("distance"))
    sizes = near.groupBy("label").agg(F.count("*").alias("n"))
    ranks = sizes.select(_C("label").alias("_l"), F.row_number().over(Window.orderBy(F.desc("n"), "label")).alias("rank"))  # k rows
    return near.join(F.broadcast(ranks), _C("label") == _C("_l")).drop("_l")


def kmeans(points: DataFrame, point_id: str, vector: str, k: int, seed: int = 42, rounds: int = 30) -> DataFrame:
    """(point, label, distance) of a k-means fit, each point on its nearest final centre."""
    return kmeans_fit(points, point_id, vector, k, seed, rounds)[1]


def kmeans_fit(points: DataFrame, point_id: str, vector: str, k: int, seed: int = 42, rounds: int = 30) -> tuple[list[tuple[int, list[float]]], DataFrame]:
    """The (label, centre) pairs of a k-means fit, and what :func:`kmeans` returns."""
    rows = points.select(point_id, _C(vector).alias("_v"), array_to_vector(vector).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, tol=1e-4).fit(rows)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    table = points.sparkSession.createDataFrame(centres, "label int, centre array<double>")
    return centres, assign(rows.select(point_id, "_v"), table, point_id, "_v").select(point_id, "label", "distance")


def principal_angle(rows: DataFrame, by: str, x: Column, y: Column) -> DataFrame:
    """Direction of largest spread of each group, in degrees."""
    s = rows.groupBy(by).agg(F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"))
    return s.select(by, F.degrees(F.atan2(2 * _C("xy"), _C("xx") - _C("yy")) / 2).alias("angle"))


def suppress_overlaps(boxes: DataFrame, by: str, threshold: float = 0.35) -> DataFrame:
    """Boxes (id, x, y, w, h, score) that overlap no better-scored kept one of their image by the threshold or more.

    What going through the boxes by score, then id, would keep, in rounds over
    all images at once: boxes that overlap meet in grid cells, and in each round
    those that none of their undecided neighbours beats stay and remove theirs.
    Equal boxes of an image are its best one from the start.  Ids are unique
    within an image; nulls and NaN score lowest; boxes without finite
    coordinates or an area overlap nothing.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above zero")
    columns = [by, "id", "x", "y", "w", "h", "score"]
    boxes = boxes.select(*columns)
    score = F.when(~F.isnan(_C("score").cast("double")), -_C("score"))
    order = F.struct(score.isNull().alias("none"), score.alias("score"), "id")
    has_area = grid.finite(*[_C(c) for c in "xywh"]) & F.coalesce((_C("w") > 0) & (_C("h") > 0), F.lit(False)) & _C(by).isNotNull()
    one = lambda c: _C(c).cast("double").alias(f"_{c}")
    best = cut(boxes.where(has_area).groupBy(_C(by).alias("_by"), *[one(c) for c in "xywh"]).agg(F.min(order).alias("o")))
    far = best.select(*[_C(c).alias(f"{c}2") for c in best.columns])
    box = lambda end: [_C(f"_x{end}"), _C(f"_y{end}"), _C(f"_x{end}") + _C(f"_w{end}"), _C(f"_y{end}") + _C(f"_h{end}")]
    met = grid.meeting(best, far, box(""), box("2"), same=[("_by", "_by2")]).where(_C("o") < _C("o2"))
    span = lambda low, high: F.greatest(F.lit(0.0), F.least(box("")[high], box("2")[high]) - F.greatest(box("")[low], box("2")[low]))
    both = span(0, 2) * span(1, 3)
    over = both / (_C("_w") * _C("_h") + _C("_w2") * _C("_h2") - both) >= threshold
    beaten = cut(met.where(over).select(_C("_by").alias("b"), _C("o.id").alias("winner"), _C("o2.id").alias("loser")))
    gone = []
    while beaten.limit(1).count():
        pair = lambda df, c: df.select(_C("b").alias("_b"), _C(c).alias("_i")).distinct()
        at = lambda c: (_C("b") == _C("_b")) & (_C(c) == _C("_i"))
        lost = cut(pair(beaten.join(pair(beaten, "loser"), at("winner"), "left_anti"), "loser"))
        gone.append(lost)
        beaten = cut(beaten.join(lost, at("loser"), "left_anti").join(lost, at("winner"), "left_anti"))
    kept = best.select("_by", _C("o.id").alias("_id"))
    if gone:
        lost = reduce(DataFrame.unionAll, gone)
        kept = kept.join(lost, (_C("_by") == _C("_b")) & (_C("_id") == _C("_i")), "left_anti")
    return boxes.join(kept, (_C(by) == _C("_by")) & (_C("id") == _C("_id")), "left_semi").unionAll(boxes.where(~has_area))


def homographies(pairs: DataFrame, by: str) -> DataFrame:
    """3x3 matrix, row by row, of each group's first four point pairs (ord, x, y, u, v); null where they are degenerate.

    The groups' systems are solved a batch at a time.
    """

    @F.pandas_udf("array<double>")
    def solve(corners: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(corners), index=corners.index, dtype=object)
        whole = [i for i, c in enumerate(corners) if len(c) == 4]
        if whole:
            p = np.array([[[q["x"], q["y"], q["u"], q["v"]] for q in corners.iloc[i]] for i in whole], float)
            x, y, u, v = (p[:, :, k] for k in range(4))
            one, zero = np.ones_like(x), np.zeros_like(x)
            rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], 2), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], 2)], axis=1)
            sound = np.linalg.matrix_rank(rows) == 8
            if sound.any():
                found = np.linalg.solve(rows[sound], np.concatenate([u, v], axis=1)[sound][:, :, None])[:, :, 0]
                for i, m in zip(np.array(whole)[sound], found, strict=True):
                    out.iloc[i] = [*m.tolist(), 1.0]
        return out

    point = F.struct("ord", *[_C(c).cast("double").alias(c) for c in ("x", "y", "u", "v")])
    four = F.slice(F.array_sort(F.collect_list(point)), 1, 4)  # a group's corners
    return pairs.groupBy(by).agg(four.alias("_c")).select(by, solve("_c").alias("matrix"))
