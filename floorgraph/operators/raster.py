"""Masks as pixel tables (image, x, y): morphology, components, contact, rays, colours.

Morphology, components and contact work on runs of pixels
(:mod:`floorgraph.operators.runs`), so what is exchanged goes by the outline of
a mask rather than its area; pixels are what goes in and comes out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorgraph.operators import runs as rn
from floorgraph.sources.shared import cut

_C = F.col


def _radius(size: int) -> int:
    return (size | 1) // 2


def dilate(mask: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Pixels within a square kernel of odd ``size`` of the mask, inside the image; sizes below 2 leave it as it is."""
    return rn.to_pixels(rn.dilated(rn.to_runs(mask), _radius(size), width, height)) if _radius(size) else mask.distinct()


def erode(mask: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Pixels all of whose kernel lies in the mask; beyond the border counts as inside."""
    return rn.to_pixels(rn.eroded(rn.to_runs(mask), _radius(size), width, height)) if _radius(size) else mask.distinct()


def opened(mask: DataFrame, size: int, width: int, height: int) -> DataFrame:
    r = _radius(size)
    return rn.to_pixels(rn.dilated(rn.eroded(rn.to_runs(mask), r, width, height), r, width, height)) if r else mask.distinct()


def closed(mask: DataFrame, size: int, width: int, height: int) -> DataFrame:
    r = _radius(size)
    return rn.to_pixels(rn.eroded(rn.dilated(rn.to_runs(mask), r, width, height), r, width, height)) if r else mask.distinct()


def mask_components(mask: DataFrame, least_area: int = 1) -> DataFrame:
    """(image, component, area, x0, y0, x1, y1) of 8-connected parts; a component is named by its first pixel."""
    named = rn.linked(rn.to_runs(mask))
    out = named.groupBy("image", "component").agg(rn.area(named).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))
    return out.where(_C("area") >= least_area)


def contact_area(a: DataFrame, b: DataFrame, reach: int, width: int, height: int) -> DataFrame:
    """(image, contact, common) of the images with any: pixels of either mask within the reach of the other, and pixels of both."""
    one, two = cut(rn.to_runs(a)), cut(rn.to_runs(b))
    wide = lambda runs: rn.dilated(runs, reach, width, height)
    shares = ((one, wide(two), "contact"), (two, wide(one), "contact"), (one, two, "common"))
    found = [rn.common(x, y).select("image", (_C("x1") - _C("x0") + 1).alias("n"), F.lit(kind).alias("kind")) for x, y, kind in shares]
    of = lambda kind: F.coalesce(F.sum(F.when(_C("kind") == kind, _C("n"))), F.lit(0)).cast("bigint").alias(kind)
    return found[0].unionAll(found[1]).unionAll(found[2]).groupBy("image").agg(of("contact"), of("common"))


def first_hits(mask: DataFrame, origins: DataFrame, directions: Sequence[tuple[int, int]], reach: int) -> DataFrame:
    """(image, origin, dx, dy, step): first mask pixel on each ray from the origins (image, origin, x, y)."""
    rays = origins.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in directions])))
    steps = rays.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    at = steps.select("image", "origin", _C("_d.dx").alias("dx"), _C("_d.dy").alias("dy"), "step", (_C("x") + _C("_d.dx") * _C("step")).alias("x"), (_C("y") + _C("_d.dy") * _C("step")).alias("y"))
    return at.join(mask.distinct(), ["image", "x", "y"], "left_semi").groupBy("image", "origin", "dx", "dy").agg(F.min("step").alias("step"))


def in_ranges(pixels: DataFrame, **bounds: tuple[int, int]) -> DataFrame:
    """Pixels whose named channels lie within their inclusive bounds."""
    for name, (low, high) in bounds.items():
        pixels = pixels.where(_C(name).between(low, high))
    return pixels


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit HSV: hue in 0..179, saturation and value in 0..255."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (high - low).cast("double")
    hue = F.when(span == 0, 0.0).when(high == r, 60 * (g - b) / span).when(high == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    hue = F.when(hue < 0, hue + 360).otherwise(hue) / 2
    saturation = F.when(high == 0, 0.0).otherwise(255 * span / high)
    return F.rint(hue).cast("int"), F.rint(saturation).cast("int"), high.cast("int")


def rgba(r: Column, g: Column, b: Column, alpha: float = 1.0) -> Column:
    return F.array(*[F.round(c / 255.0, 4) for c in (r, g, b)], F.lit(alpha))
