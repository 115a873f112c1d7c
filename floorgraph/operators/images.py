"""Kernels on whole images: outlines, template matches, fills, bridges, region picks, markers.

Pixels come as tables (image, x, y and channels); each image is one group of
``applyInPandas`` and so one task's, as large as an image and no larger.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_C = F.col
OUTLINES = "image string, outline int, area double, points array<struct<x: int, y: int>>"
#: The eight neighbours in the order of a clock that starts to the right and runs downwards.
_AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def _grid(pdf: pd.DataFrame, pad: int = 1) -> tuple[np.ndarray, int, int]:
    """Boolean array of the pixels with a border, and the offset of its origin."""
    x0, y0 = int(pdf["x"].min()) - pad, int(pdf["y"].min()) - pad
    mask = np.zeros((int(pdf["y"].max()) - y0 + 1 + pad, int(pdf["x"].max()) - x0 + 1 + pad), bool)
    mask[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = True
    return mask, x0, y0


def labelled(mask: np.ndarray) -> np.ndarray:
    """Label of each pixel's 8-connected part, numbered from 1 in reading order of their first pixels; 0 outside."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        best = labels.copy()
        padded = np.pad(labels, 1)
        for dx, dy in _AROUND:
            near = padded[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]]
            best = np.where(mask & (near > 0) & (near < best), near, best)
        flat = best.ravel()
        hooked = np.where(mask.ravel(), flat[np.maximum(flat - 1, 0)], 0).reshape(mask.shape)
        if (hooked == labels).all():
            break
        labels = hooked
    return np.searchsorted(np.unique(labels[mask]), labels) * mask + mask


def border(part: np.ndarray) -> list[tuple[int, int]]:
    """Outer border of a connected part as a closed walk of pixels, from its first pixel in reading order."""
    y, x = np.unravel_index(np.argmax(part), part.shape)
    start, here, came = (x, y), (x, y), 6
    walk = [start]
    first_step = None
    while True:
        for turn in range(1, 9):
            d = (came + turn) % 8
            nx, ny = here[0] + _AROUND[d][0], here[1] + _AROUND[d][1]
            if 0 <= ny < part.shape[0] and 0 <= nx < part.shape[1] and part[ny, nx]:
                break
        else:
            return walk
        if here == start and first_step == d:
            return walk[:-1]
        first_step = d if first_step is None else first_step
        here, came = (nx, ny), (d + 4) % 8
        walk.append(here)


def ring_size(points: np.ndarray) -> tuple[float, float]:
    """Area and perimeter of a closed ring."""
    after = np.roll(points, -1, axis=0)
    area = abs(float((points[:, 0] * after[:, 1] - after[:, 0] * points[:, 1]).sum())) / 2
    return area, float(np.hypot(*(after - points).T).sum())


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Closed ring without the points that lie within the tolerance of the chords that replace them."""
    n = len(points)
    if n < 4 or tolerance <= 0:
        return points
    far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
    closed = np.vstack([points, points[:1]])
    keep = {0, far}
    spans = [(0, far), (far, n)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        p, q, inner = closed[a], closed[b], closed[a + 1 : b]
        chord = q - p
        length = np.hypot(*chord)
        off = np.abs(chord[0] * (inner[:, 1] - p[1]) - chord[1] * (inner[:, 0] - p[0])) / length if length else np.hypot(*(inner - p).T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[sorted(k for k in keep if k < n)]


def outlines(mask: DataFrame, least_area: float = 2000.0, epsilon_ratio: float = 0.001) -> DataFrame:
    """(image, outline, area, points): simplified outer borders of the parts of more than ``least_area``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, x0, y0 = _grid(pdf)
        labels, rows = labelled(grid), []
        for k in range(1, int(labels.max()) + 1):
            ring = np.array(border(labels == k), float)
            area, perimeter = ring_size(ring)
            if len(ring) > 2 and area > least_area:
                points = simplified(ring, epsilon_ratio * perimeter)
                rows.append((pdf["image"].iloc[0], len(rows), area, [{"x": int(x) + x0, "y": int(y) + y0} for x, y in points]))
        return pd.DataFrame(rows, columns=["image", "outline", "area", "points"])

    return mask.select(_C("image").cast("string").alias("image"), "x", "y").groupBy("image").applyInPandas(run, OUTLINES)


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """Image whose pixels are the means of the areas that they stand for."""
    h, w = (max(1, round(n * scale)) for n in image.shape)
    total = np.pad(image.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def at(v: np.ndarray, axis: int) -> np.ndarray:
        edges = np.linspace(0, v.shape[axis] - 1, (h, w)[axis] + 1)
        low = np.minimum(edges.astype(int), v.shape[axis] - 2)
        part = np.expand_dims(edges - low, 1 - axis)
        return np.take(v, low, axis) * (1 - part) + np.take(v, low + 1, axis) * part

    sums = np.diff(np.diff(at(at(total, 0), 1), axis=0), axis=1)
    return sums / (image.shape[0] / h * image.shape[1] / w)


def correlation(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised correlation of the template with every window that it fits."""
    h, w = template.shape
    centred = template - template.mean()
    shape = [a + b - 1 for a, b in zip(image.shape, template.shape, strict=True)]
    product = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(centred[::-1, ::-1], shape), shape)[h - 1 : image.shape[0], w - 1 : image.shape[1]]

    def windows(v: np.ndarray) -> np.ndarray:
        s = np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    spread = np.maximum(windows(image * image) - windows(image) ** 2 / (h * w), 0)
    scale = np.sqrt(spread * (centred * centred).sum())
    return np.where(scale > 1e-6, product / np.maximum(scale, 1e-6), 0.0)


def template_matches(images: DataFrame, templates: dict[str, np.ndarray], scales: Sequence[float] = (0.8, 0.9, 1.0, 1.1, 1.2), threshold: float = 0.72, flipped: bool = True) -> DataFrame:
    """(image, template, flipped, x, y, w, h, score, scale) of all windows that reach the threshold.

    ``images``: image, x, y, value.  Overlapping matches are left to ``suppress_overlaps``.
    """
    fields = "image string, template string, flipped boolean, x int, y int, w int, h int, score double, scale double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grey = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1))
        grey[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["value"].to_numpy()
        rows = []
        for name, template in templates.items():
            for flip in (False, True) if flipped else (False,):
                for scale in scales:
                    small = resized(template[:, ::-1] if flip else template, scale)
                    h, w = small.shape
                    if min(h, w) < 4 or h > grey.shape[0] or w > grey.shape[1]:
                        continue
                    score = correlation(grey, small)
                    for y, x in zip(*np.nonzero(score >= threshold), strict=True):
                        rows.append((pdf["image"].iloc[0], name, flip, int(x), int(y), w, h, float(score[y, x]), float(scale)))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    return images.select(_C("image").cast("string").alias("image"), "x", "y", "value").groupBy("image").applyInPandas(run, fields)


def structure_angle(value: np.ndarray, whole: np.ndarray) -> float:
    """Direction in radians along which the known pixels change least; 0 for an image without edges.

    The mean of the doubled angles of the edges, weighted by their contrast,
    from central differences of which no pixel is a hole.
    """
    gx, gy = (value[1:-1, 2:] - value[1:-1, :-2]) / 2, (value[2:, 1:-1] - value[:-2, 1:-1]) / 2
    sound = whole[1:-1, 2:] & whole[1:-1, :-2] & whole[2:, 1:-1] & whole[:-2, 1:-1]
    gx, gy = gx[sound], gy[sound]
    # doubled angle of the gradient, turned by a right angle
    cos2, sin2 = float((gy * gy - gx * gx).sum()), float((-2 * gx * gy).sum())
    return 0.5 * math.atan2(sin2, cos2) if cos2 or sin2 else 0.0


def fill_along(pixels: DataFrame, angle_degrees: float | None = None, most: int = 80) -> DataFrame:
    """(image, x, y, value) with the holes filled along a direction.

    ``pixels``: image, x, y, value, hole.  A hole takes the values of the nearest
    pixels either way, weighted by nearness; with one way open its value; with
    none it stays as it was.  Without an angle the image's own is taken, see
    :func:`structure_angle`.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1)
        value, whole = np.zeros(shape), np.zeros(shape, bool)
        value[pdf["y"], pdf["x"]] = pdf["value"]
        whole[pdf["y"], pdf["x"]] = ~pdf["hole"].to_numpy(bool)
        ys, xs = np.nonzero(~whole)
        angle = structure_angle(value, whole) if angle_degrees is None else math.radians(angle_degrees)
        dx, dy = math.cos(angle), math.sin(angle)
        found = []
        for sign in (-1, 1):
            step, colour = np.full(len(xs), np.inf), np.zeros(len(xs))
            open_ = np.ones(len(xs), bool)
            for k in range(1, most + 1):
                px, py = np.rint(xs + dx * sign * k).astype(int), np.rint(ys + dy * sign * k).astype(int)
                open_ &= (px >= 0) & (px < shape[1]) & (py >= 0) & (py < shape[0])
                hit = open_.copy()
                hit[open_] = whole[py[open_], px[open_]]
                step[hit], colour[hit] = k, value[py[hit], px[hit]]
                open_ &= ~hit
                if not open_.any():
                    break
            found.append((step, colour))
        (a, ca), (b, cb) = found
        both, one, two = np.isfinite(a) & np.isfinite(b), np.isfinite(a), np.isfinite(b)
        with np.errstate(invalid="ignore"):
            mixed = np.where(both, (ca * b + cb * a) / (a + b), np.where(one, ca, np.where(two, cb, value[ys, xs])))
        value[ys, xs] = np.floor(np.clip(mixed, 0, 255))
        out = pdf[["image", "x", "y"]].copy()
        out["value"] = value[pdf["y"], pdf["x"]]
        return out

    return pixels.select("image", "x", "y", _C("value").cast("double").alias("value"), "hole").groupBy("image").applyInPandas(run, f"image {pixels.schema['image'].dataType.simpleString()}, x int, y int, value double")


def scan_bridges(target: DataFrame, gaps: DataFrame, reach: int, step: int = 4, touch: int = 1, angles: Sequence[float] | None = None) -> DataFrame:
    """(image, angle, x0, y0, x1, y1, length): lines across a gap from mask to mask, at the best of the scan angles.

    The angles are given, or follow the gap's own direction (0, 90, 15 either
    way, 75 and 105 degrees from it).  Best is the angle of most lines, of equals
    the greatest summed length.  ``target`` and ``gaps``: image, x, y.
    """
    fields = "image string, angle double, x0 double, y0 double, x1 double, y1 double, length double"

    def own_angles(xy: np.ndarray) -> list[float]:
        if len(xy) < 2:
            return [0.0, 90.0]
        axis = np.linalg.eigh(np.cov(xy.T))[1][:, -1]
        base = math.degrees(math.atan2(axis[1], axis[0]))
        return [(base + d) % 180 for d in (0, 90, -15, 15, 75, 105)]

    def run(key: tuple, mask: pd.DataFrame, gap: pd.DataFrame) -> pd.DataFrame:
        columns = [f.split()[0] for f in fields.split(", ")]
        if mask.empty or gap.empty:
            return pd.DataFrame(columns=columns)
        grid, x0, y0 = _grid(mask)
        wide = grid.copy()
        for _ in range(touch):  # touched where the mask comes within a square of this half width
            p = np.pad(wide, 1)
            wide = np.logical_or.reduce([p[1 + j : 1 + j + wide.shape[0], 1 + i : 1 + i + wide.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        xy = gap[["x", "y"]].to_numpy(float)
        best: tuple = ((0, 0.0), None, [])
        for angle in angles or own_angles(xy):
            along = np.array([math.cos(math.radians(angle)), math.sin(math.radians(angle))])
            across = np.array([-along[1], along[0]])
            d, p = xy @ along, xy @ across
            lines = []
            for offset in np.arange(p.min(), p.max() + 0.1, max(1, step)):
                band = d[np.abs(p - offset) <= max(1.0, step / 2)]
                if not len(band):
                    continue
                ends = []
                for start, sign in ((band.min() - 1, -1), (band.max() + 1, 1)):
                    t = start + sign * np.arange(reach)
                    points = across * offset + t[:, None] * along
                    px, py = np.rint(points[:, 0]).astype(int) - x0, np.rint(points[:, 1]).astype(int) - y0
                    inside = (px >= 0) & (py >= 0) & (px < wide.shape[1]) & (py < wide.shape[0])
                    hit = np.flatnonzero(inside)[wide[py[inside], px[inside]]]
                    ends.append(points[hit[0]] if len(hit) else None)
                if ends[0] is not None and ends[1] is not None and (length := float(np.hypot(*(ends[1] - ends[0])))) > 1:
                    lines.append((*ends[0], *ends[1], length))
            score = (len(lines), sum(x[-1] for x in lines))
            if score > best[0]:
                best = (score, float(angle), lines)
        return pd.DataFrame([(key[0], best[1], *map(float, x)) for x in best[2]], columns=columns)

    named = lambda df: df.select(_C("image").cast("string").alias("image"), "x", "y")
    return named(target).groupBy("image").cogroup(named(gaps).groupBy("image")).applyInPandas(run, fields)


def icon_bridges(mask: DataFrame, icons: DataFrame, reach: int = 60, angles: Sequence[int] = tuple(range(0, 180, 15))) -> DataFrame:
    """(image, icon, angle, x0, y0, x1, y1, score): the shortest line through an icon's centre that meets the mask on both sides outside its box.

    ``mask``: image, x, y; ``icons``: image, icon, x, y, w, h.  Of equal scores the first angle.
    """
    ways = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(float(a)).alias("angle"), F.lit(sign).alias("sign")) for k, a in enumerate(angles) for sign in (-1, 1)])
    rays = icons.withColumn("_w", F.explode(ways)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    at = lambda c, size, f: F.rint(_C(c) + _C(size) / 2.0 + f(F.radians("_w.angle")) * _C("_w.sign") * _C("_k")).cast("int")
    rays = rays.withColumn("_px", at("x", "w", F.cos)).withColumn("_py", at("y", "h", F.sin))
    inside = _C("_px").between(_C("x"), _C("x") + _C("w")) & _C("_py").between(_C("y"), _C("y") + _C("h"))
    seen = mask.select(_C("image").alias("_image"), _C("x").alias("_mx"), _C("y").alias("_my")).distinct()
    hits = rays.where(~inside).join(seen, (_C("image") == _C("_image")) & (_C("_px") == _C("_mx")) & (_C("_py") == _C("_my")))
    first = hits.groupBy("image", "icon", "_w").agg(F.min(F.struct("_k", "_px", "_py")).alias("h"))
    side = lambda sign: F.max(F.when(_C("_w.sign") == sign, _C("h")))
    both = first.groupBy("image", "icon", _C("_w.ord").alias("ord"), _C("_w.angle").alias("angle")).agg(side(-1).alias("a"), side(1).alias("b")).where("a is not null and b is not null")
    score = 1.0 / F.greatest(F.lit(1), _C("a._k") + _C("b._k"))
    best = both.groupBy("image", "icon").agg(F.max_by(F.struct("angle", "a", "b", score.alias("score")), F.struct(score, -_C("ord"))).alias("m"))
    return best.select("image", "icon", "m.angle", _C("m.a._px").alias("x0"), _C("m.a._py").alias("y0"), _C("m.b._px").alias("x1"), _C("m.b._py").alias("y1"), "m.score")


def markers(parts: DataFrame, least_area: int = 10, most_ragged: float = 40.0) -> DataFrame:
    """Centres of the outlines that are compact: squared perimeter over area below ``most_ragged``.  ``parts``: image, outline, area, points."""
    after = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    lengths = F.zip_with("points", after, lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))
    perimeter = F.aggregate(lengths, F.lit(0.0), lambda s, v: s + v)
    mean = lambda c: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[c]) / F.size("points")
    return parts.where((_C("area") > least_area) & (perimeter * perimeter / _C("area") < most_ragged)).select("image", "outline", mean("x").alias("x"), mean("y").alias("y"))


def ordered_corners(points: Column) -> Column:
    """Four points as upper left, upper right, lower right, lower left: the left two by y, the right two by y."""
    by = lambda array, a, b: F.array_sort(F.transform(array, lambda p: F.struct(p[a].alias(a), p[b].alias(b))))
    across = by(points, "x", "y")
    left, right = by(F.slice(across, 1, 2), "y", "x"), by(F.slice(across, 3, 2), "y", "x")
    return F.transform(F.array(left[0], right[0], right[1], left[1]), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def fourth_corner(a: Column, b: Column, c: Column) -> Column:
    """The point that completes a parallelogram over a, b and c."""
    return F.struct(*[(a[k] + c[k] - b[k]).alias(k) for k in ("x", "y")])


def lab(rgb: np.ndarray) -> np.ndarray:
    """8-bit CIE LAB of 8-bit RGB rows (D65)."""
    c = rgb / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = linear @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[:, 1] > 0.008856, 116 * np.cbrt(xyz[:, 1]) - 16, 903.3 * xyz[:, 1])
    return np.rint(np.column_stack([light * 255 / 100, 500 * (f[:, 0] - f[:, 1]) + 128, 200 * (f[:, 1] - f[:, 2]) + 128]))


def pick_regions(pixels: DataFrame, seeds: DataFrame, tolerance: float = 18.0) -> DataFrame:
    """(image, x, y) of the pixels near the seeds' median colour whose part touches a seed.

    ``pixels``: image, x, y, r, g, b; ``seeds``: image, x, y.
    """

    def run(key: tuple, p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        marked = p.merge(s[["x", "y"]].drop_duplicates().assign(seed=True), on=["x", "y"], how="left")
        is_seed = marked["seed"].notna().to_numpy() if len(marked) else np.zeros(0, bool)
        if not is_seed.any():
            return pd.DataFrame({"image": [], "x": [], "y": []})
        colours = lab(marked[["r", "g", "b"]].to_numpy(float))
        near = (np.linalg.norm(colours - np.median(colours[is_seed], axis=0), axis=1) <= tolerance) | is_seed
        kept = marked[near]
        grid, x0, y0 = _grid(kept)
        labels = labelled(grid)[kept["y"].to_numpy() - y0, kept["x"].to_numpy() - x0]
        chosen = kept[np.isin(labels, np.unique(labels[is_seed[near]]))]
        return pd.DataFrame({"image": key[0], "x": chosen["x"], "y": chosen["y"]})

    named = lambda df, *cols: df.select(_C("image").cast("string").alias("image"), "x", "y", *cols)
    return named(pixels, "r", "g", "b").groupBy("image").cogroup(named(seeds).groupBy("image")).applyInPandas(run, "image string, x int, y int")
