"""Grouped choices and folds: representatives, first-seen records, merges, dominant values, axis fits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, by: Sequence[str], ordinal: Column, keep: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    """Per key the first record's attributes, the number of records, and values in first-seen order.

    Ordered distinct values come from the least ordinal of each value, so no
    group is ever collected beyond its distinct values.
    """
    rows = rows.withColumn("_at", ordinal)
    out = rows.groupBy(*by).agg(F.min_by(F.struct(*keep), "_at").alias("_first"), F.count("*").alias("n_records"))
    for name in distinct:
        values = rows.where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.min("_at").alias("_when"))
        listed = values.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_when", F.col(name).alias("_v"))))["_v"].alias(f"{name}_seen"))
        out = out.join(listed, list(by), "left")
    return out.select(*by, "_first.*", "n_records", *[f"{n}_seen" for n in distinct])


def dominant(rows: DataFrame, by: str, value: str, weight: Column, ordinal: Column) -> DataFrame:
    """Value of the largest summed weight in each group; of equals the first seen."""
    sums = rows.groupBy(by, value).agg(F.sum(weight).alias("_w"), F.min(ordinal).alias("_o"))
    return sums.groupBy(by).agg(F.max_by(value, F.struct("_w", (-F.col("_o")).alias("o"))).alias(value))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight; the plain mean where the weights sum to nothing."""
    return F.when(F.sum(weight) > 0, F.sum(value * weight) / F.sum(weight)).otherwise(F.avg(value))


def histogram_mode(rows: DataFrame, by: str, value: str, width: float) -> DataFrame:
    """Most frequent bin of ``width`` in each group (of equals the least), its size and the mean of its members."""
    bins = rows.groupBy(by, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    top = bins.groupBy(by).agg(F.max_by(F.struct("bin", "n", "mean"), F.struct("n", (-F.col("bin")).alias("b"))).alias("_top"))
    return top.select(by, "_top.*")


def axis_fit(rows: DataFrame, by: str, src: str, dst: str, least_span: float = 0.25) -> DataFrame:
    """Scale and offset of one axis by least squares.

    Without points the identity, with one or too small a span a translation; a
    negative scale is taken absolutely and its offset from the means.
    """
    stats = rows.groupBy(by).agg(
        F.count(F.when(F.col(src).isNotNull() & F.col(dst).isNotNull(), 1)).alias("n"),
        (F.max(src) - F.min(src)).alias("span"), F.avg(src).alias("ms"), F.avg(dst).alias("md"),
        F.regr_slope(dst, src).alias("slope"), F.regr_intercept(dst, src).alias("icept"),
    )
    fits = (F.col("n") >= 2) & (F.col("span") >= least_span)
    scale = F.when(fits, F.abs("slope")).otherwise(F.lit(1.0))
    offset = F.when(~fits, F.coalesce(F.col("md") - F.col("ms"), F.lit(0.0))).when(F.col("slope") < 0, F.col("md") - F.abs("slope") * F.col("ms")).otherwise(F.col("icept"))
    method = F.when(F.col("n") == 0, "identity").when(fits, "scale_translate").otherwise("translation")
    return stats.select(by, "n", method.alias("method"), scale.alias("scale"), offset.alias("offset"))


def running_fold(rows: DataFrame, by: str, order: Sequence[str], delta: str) -> DataFrame:
    """Sum of the deltas up to and with each row, and up to before it."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset_before", F.coalesce(before, F.lit(0.0))).withColumn("offset_after", F.col("offset_before") + F.col(delta))


def local_shifts(corrections: DataFrame, by: str) -> DataFrame:
    """(by, polygon_id, dx, dy): shifts of polygons after an ordered list of corrections.

    ``corrections``: by, ord, reference, rx, ry, moving, mx, my, polygons
    (array): the moving polygon's point is to meet the reference's.  Each takes
    both points with the shifts so far and adds the difference to the listed
    polygons, so the order matters: a kernel for each drawing.  Corrections with
    a missing point or without polygons do nothing.
    """
    kind = corrections.schema["reference"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shifts: dict = {}
        whole = pdf.dropna(subset=["rx", "ry", "mx", "my"]).sort_values("ord")
        for r in whole.itertuples():
            (ax, ay), (bx, by_) = shifts.get(r.reference, (0.0, 0.0)), shifts.get(r.moving, (0.0, 0.0))
            dx, dy = (r.rx + ax) - (r.mx + bx), (r.ry + ay) - (r.my + by_)
            for polygon in r.polygons if r.polygons is not None else ():
                x, y = shifts.get(polygon, (0.0, 0.0))
                shifts[polygon] = (x + dx, y + dy)
        rows = [(pdf[by].iloc[0], p, *d) for p, d in shifts.items()]
        return pd.DataFrame(rows, columns=[by, "polygon_id", "dx", "dy"])

    columns = corrections.select(by, "ord", "reference", *[F.col(c).cast("double").alias(c) for c in ("rx", "ry")], "moving", *[F.col(c).cast("double").alias(c) for c in ("mx", "my")], "polygons")
    return columns.groupBy(by).applyInPandas(run, f"{by} {corrections.schema[by].dataType.simpleString()}, polygon_id {kind}, dx double, dy double")


def centre(rows: DataFrame, cols: Sequence[str], margin: float = 50.0, fallback: float = 1000.0) -> DataFrame:
    """Shift so that the least value of each column is ``margin``; canvas of span and two margins, ``fallback`` where small.

    The extent is one row.
    """
    extent = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = rows.join(F.broadcast(extent))
    for c in cols:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + 2 * margin
        out = out.withColumn(f"{c}_centred", F.col(c) - F.col(f"_lo_{c}") + margin).withColumn(f"{c}_canvas", F.when(span < 100, F.lit(fallback)).otherwise(span))
    return out.drop(*[f"_{n}_{c}" for c in cols for n in ("lo", "hi")])
