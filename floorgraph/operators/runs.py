"""Masks as runs of pixels: (image, y, x0, x1), both ends inclusive, apart from each other within a row.

Dilation and erosion widen and narrow the runs in x and then count, along each
row, how many of the rows around cover a place; unions and intersections are
the same sweep with other counts; components link runs of neighbouring rows.
What is exchanged goes by the number of runs, never of pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.operators.graph import components
from floorgraph.sources.shared import cut

_C = F.col


def to_runs(pixels: DataFrame) -> DataFrame:
    """Runs of a pixel table (image, x, y); repeated pixels count once, those with nulls not at all.

    Pixels are exchanged and sorted once, by row; a run lies between a pixel without a left and one without a right neighbour.
    """
    rows = pixels.select("image", "x", "y").dropna()
    row = Window.partitionBy("image", "y").orderBy("x")
    first = F.coalesce(_C("x") - F.lag("x").over(row) > 1, F.lit(True))
    last = F.coalesce(F.lead("x").over(row) - _C("x") > 1, F.lit(True))
    ends = rows.select("image", "y", "x", first.alias("_first"), last.alias("_last")).where("_first or _last")
    return ends.withColumn("x1", F.when(_C("_last"), _C("x")).otherwise(F.lead("x").over(row))).where("_first").select("image", "y", _C("x").alias("x0"), "x1")


def to_pixels(runs: DataFrame) -> DataFrame:
    return runs.select("image", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def swept(intervals: DataFrame, need: Column) -> DataFrame:
    """Runs of the places that ``need`` or more of the intervals (image, y, x0, x1) of a row cover; ``need`` may depend on the row.

    Intervals are exchanged once, and their ends sorted once where they are.
    """
    ends = F.array(F.struct(_C("x0").alias("x"), F.lit(1).alias("d")), F.struct((_C("x1") + 1).alias("x"), F.lit(-1).alias("d")))
    steps = intervals.select("image", "y", "x0", "x1").repartition("image", "y").select("image", "y", F.inline(ends))
    row = Window.partitionBy("image", "y").orderBy("x")
    held = steps.withColumn("_in", F.sum("d").over(row.rangeBetween(Window.unboundedPreceding, 0)) >= need)  # ends at one place count together
    turns = held.withColumn("_was", F.lag("_in", 1, False).over(row)).where(_C("_in") != _C("_was"))
    return turns.withColumn("x1", F.lead("x").over(row) - 1).where("_in").select("image", "y", _C("x").alias("x0"), "x1")


def united(*masks: DataFrame) -> DataFrame:
    columns = ["image", "y", "x0", "x1"]
    out = masks[0].select(*columns)
    for m in masks[1:]:
        out = out.unionAll(m.select(*columns))
    return swept(out, F.lit(1))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    columns = ["image", "y", "x0", "x1"]
    return swept(a.select(*columns).unionAll(b.select(*columns)), F.lit(2))


def _rows_around(runs: DataFrame, r: int, height: int) -> DataFrame:
    near = F.sequence(F.greatest(_C("y") - r, F.lit(0)), F.least(_C("y") + r, F.lit(height - 1)))
    return runs.select("image", F.explode(near).alias("y"), "x0", "x1")


def dilated(runs: DataFrame, r: int, width: int, height: int) -> DataFrame:
    """Places within ``r`` of the mask in x and in y, inside the image."""
    inside = runs.where(_C("y").between(-r, height - 1 + r))
    wide = inside.select("image", "y", F.greatest(_C("x0") - r, F.lit(0)).alias("x0"), F.least(_C("x1") + r, F.lit(width - 1)).alias("x1")).where("x0 <= x1")
    return swept(_rows_around(wide, r, height), F.lit(1))


def eroded(runs: DataFrame, r: int, width: int, height: int) -> DataFrame:
    """Places all of whose surroundings within ``r`` lie in the mask; beyond the border counts as inside."""
    low = F.when(_C("x0") <= 0, 0).otherwise(_C("x0") + r)
    high = F.when(_C("x1") >= width - 1, width - 1).otherwise(_C("x1") - r)
    inside = runs.where(_C("y").between(0, height - 1))
    narrow = inside.select("image", "y", low.alias("x0"), high.alias("x1")).where("x0 <= x1")
    rows = F.least(_C("y") + r, F.lit(height - 1)) - F.greatest(_C("y") - r, F.lit(0)) + 1
    return swept(_rows_around(narrow, r, height), rows)


def area(runs: DataFrame) -> Column:
    return F.coalesce(F.sum(_C("x1") - _C("x0") + 1), F.lit(0)).cast("bigint")


def linked(runs: DataFrame) -> DataFrame:
    """(image, y, x0, x1, component) of the 8-connected parts, named by their first pixel: ``image|row|column``.

    Of the other row's runs only the last that begins before a run can touch it,
    so a run makes one edge to either side at most.
    """
    node = F.format_string("%s|%06d|%06d", _C("image").cast("string"), "y", "x0")
    named = runs.select("image", "y", "x0", "x1", node.alias("node"))
    sides = F.array(F.struct(_C("y").alias("seam"), F.lit(0).alias("side")), F.struct((_C("y") - 1).alias("seam"), F.lit(1).alias("side")))
    seams = named.select("image", "x0", "x1", "node", F.inline(sides))
    w = Window.partitionBy("image", "seam").orderBy("x0", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda side: F.last(F.when(_C("side") == side, F.struct("x1", "node")), ignorenulls=True).over(w)
    other = seams.select("node", "x0", F.when(_C("side") == 0, last(1)).otherwise(last(0)).alias("o"))
    edges = cut(other.where(_C("o.x1") + 1 >= _C("x0")).select(_C("o.node").alias("from"), _C("node").alias("to")))
    touched = edges.select(F.explode(F.array("from", "to")).alias("node"))
    parts = components(touched, edges).select(_C("node").alias("_node"), "component")
    # a run that touches none is a part by itself and takes no part in the rounds
    return named.join(parts, _C("node") == _C("_node"), "left").select("image", "y", "x0", "x1", F.coalesce("component", "node").alias("component"))
