"""Table functions to be called from SQL text."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class _GatesAlong:
    """Gates of a width along a path, from both its ends up to a passage in the middle; one in the middle where none fits.

    Rows are the path's points in order, with columns ``path``, ``x`` and ``y``.
    Yields (path, gate, along, x, y, angle): the gate's place along the path, its
    point and the direction there in degrees.  Points with nulls are left out,
    a path without a length has no gates.
    """

    def __init__(self):
        self.path, self.points, self.rule = None, [], None

    def eval(self, row: Row, width: float, passage: float) -> None:
        self.path, self.rule = row["path"], (float(width), float(passage))
        if row["x"] is not None and row["y"] is not None:
            self.points.append((float(row["x"]), float(row["y"])))

    def terminate(self) -> Iterator[tuple]:
        begins = [0.0]
        for a, b in zip(self.points, self.points[1:], strict=False):
            begins.append(begins[-1] + math.dist(a, b))
        total = begins[-1]
        if not total > 0:
            return
        width, passage = self.rule
        each = max(0, math.floor((total - passage) / 2 / width))
        front = [width / 2 + k * width for k in range(each)]
        places = [*front, *(total - at for at in reversed(front))] or [total / 2]
        for gate, at in enumerate(places):
            k = min(max(bisect.bisect_left(begins, at) - 1, 0), len(begins) - 2)
            while begins[k + 1] == begins[k]:  # two points in one place
                k += 1 if k + 2 < len(begins) else -1
            (x0, y0), (x1, y1) = self.points[k : k + 2]
            t = (at - begins[k]) / (begins[k + 1] - begins[k])
            yield self.path, gate, at, x0 + t * (x1 - x0), y0 + t * (y1 - y0), math.degrees(math.atan2(y1 - y0, x1 - x0))


def register(spark: SparkSession) -> None:
    """Make ``gates_along(TABLE(points) PARTITION BY path ORDER BY (...), width, passage)`` known to the session's SQL; a partition is one path."""
    gates = udtf(_GatesAlong, returnType="path long, gate int, along double, x double, y double, angle double")
    spark.udtf.register("gates_along", gates)
