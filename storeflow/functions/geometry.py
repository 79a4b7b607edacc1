"""Geometry and pose as column expressions.

A box is a struct of x1, y1, x2, y2; a point a struct of x, y; a polygon an array of points (closed implicitly);
keypoints an array of structs of x, y, conf.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)])


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0)) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when disjoint or without area."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(F.lit(0.0))


def nested(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    m = F.least(area(a), area(b))
    return F.when(m > 0, intersection(a, b) / m).otherwise(F.lit(0.0))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once; a plain expression would repeat it at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def points(*xy: tuple[float, float]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


def edges(poly: Column) -> Column:
    """(a, b) for each side."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return let(poly, lambda p: F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)), pair))


def contains_point(poly: Column, x: Column, y: Column) -> Column:
    """Ray casting: a side counts when it spans y half-open and crosses right of x."""
    return inside(edges(poly), x, y)


def inside(sides: Column, x: Column, y: Column) -> Column:
    """contains_point for a polygon whose edges() are at hand as a column."""
    above = lambda p: p["y"] > y
    crossing = lambda e: (above(e["a"]) != above(e["b"])) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.aggregate(sides, F.lit(False), lambda odd, e: F.when(crossing(e), ~odd).otherwise(odd))


def literal_sides(corners: list[tuple[float, float]]) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    return [((float(a[0]), float(a[1])), (float(b[0]), float(b[1]))) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)]


def inside_literal(corners: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """contains_point for a polygon that is known beforehand: a bounding box first, then one plain expression a side."""
    crossed = [((F.lit(p[1]) > y) != (F.lit(q[1]) > y)) & (x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0]) for p, q in literal_sides(corners) if p[1] != q[1]]
    odd = sum((c.cast("int") for c in crossed), F.lit(0)) % 2 == 1
    xs, ys = zip(*corners, strict=True)
    return x.between(float(min(xs)), float(max(xs))) & y.between(float(min(ys)), float(max(ys))) & odd


def polygon_area(poly: Column) -> Column:
    return F.abs(F.aggregate(edges(poly), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2


def _clip(poly: Column, axis: str, limit: Column, keep_low: bool) -> Column:
    """One side of Sutherland-Hodgman: the part of the polygon on one side of an axis-parallel line."""
    inside = (lambda p: p[axis] <= limit) if keep_low else (lambda p: p[axis] >= limit)
    other = "y" if axis == "x" else "x"

    def cross(a: Column, b: Column) -> Column:
        t = (limit - a[axis]) / (b[axis] - a[axis])
        v = a[other] + t * (b[other] - a[other])
        return F.struct(limit.alias("x"), v.alias("y")) if axis == "x" else F.struct(v.alias("x"), limit.alias("y"))

    def side(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(cross(a, b))).when(inside(b), F.array(cross(a, b), b)).otherwise(F.slice(F.array(b), 1, 0))

    return F.flatten(F.transform(edges(poly), side))


def clip_to_box(poly: Column, b: Column) -> Column:
    for axis, limit, low in (("x", b["x1"], False), ("x", b["x2"], True), ("y", b["y1"], False), ("y", b["y2"], True)):
        poly = _clip(poly, axis, limit, low)
    return poly


def overlap_area(poly: Column | list, b: Column) -> Column:
    """Area that a simple polygon and an axis-parallel box share, as one sum over the polygon's sides.

    Under each side, between the box's left and right, lies the integral of the side's height kept between the box's
    lower and upper edge; with signs these add up to the shared area. A polygon given as a list of corners becomes one
    plain expression a side.
    """
    lo, hi = b["y1"], b["y2"]
    keep = lambda v, a, z: F.least(F.greatest(v, a), z)
    grown = lambda y: F.when(y < lo, lo * y).when(y > hi, hi * y + (lo * lo - hi * hi) / 2).otherwise((y * y + lo * lo) / 2)  # noqa: E731  integral of the kept height

    def under(e: Column) -> Column:
        p, q = e["a"], e["b"]
        u, v = keep(p["x"], b["x1"], b["x2"]), keep(q["x"], b["x1"], b["x2"])
        y = lambda x: p["y"] + (x - p["x"]) / (q["x"] - p["x"]) * (q["y"] - p["y"])
        mean = F.when(F.abs(y(v) - y(u)) < 1e-6, keep((y(u) + y(v)) / 2, lo, hi)).otherwise((grown(y(v)) - grown(y(u))) / (y(v) - y(u)))
        return F.when(u != v, (v - u) * mean).otherwise(F.lit(0.0))

    if isinstance(poly, list):
        at = lambda p: {"x": F.lit(p[0]), "y": F.lit(p[1])}
        return F.abs(sum((under({"a": at(p), "b": at(q)}) for p, q in literal_sides(poly) if p[0] != q[0]), F.lit(0.0)))
    return F.abs(F.aggregate(edges(poly), F.lit(0.0), lambda s, e: s + under(e)))


def overlap_ratio(poly: Column | list, b: Column) -> Column:
    """Shared area over the box's area, 1 at most."""
    return F.when(area(b) > 0, F.least(overlap_area(poly, b) / area(b), F.lit(1.0))).otherwise(F.lit(0.0))


def segment_distance(e: Column, x: Column, y: Column) -> Column:
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(x - e["a"]["x"] - t * dx, 2) + F.pow(y - e["a"]["y"] - t * dy, 2))


def distance_to_polygon(poly: Column, x: Column, y: Column) -> Column:
    """0 inside, else the least distance to a side."""
    return F.when(contains_point(poly, x, y), F.lit(0.0)).otherwise(F.array_min(F.transform(edges(poly), lambda e: segment_distance(e, x, y))))


def literal_distance(corners: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """distance_to_polygon for a polygon that is known beforehand, side by side over whole batches."""
    sides = literal_sides(corners)

    @F.pandas_udf("double")
    def distance(px: pd.Series, py: pd.Series) -> pd.Series:
        u, v = px.to_numpy(float), py.to_numpy(float)
        odd, least = np.zeros(len(u), bool), np.full(len(u), np.inf)
        for (ax, ay), (bx, by) in sides:
            dx, dy = bx - ax, by - ay
            if dy:
                odd ^= ((ay > v) != (by > v)) & (u < dx * (v - ay) / dy + ax)
            n = dx * dx + dy * dy
            t = np.minimum(np.maximum(((u - ax) * dx + (v - ay) * dy) / n, 0.0), 1.0) if n else 0.0
            least = np.minimum(least, (u - ax - t * dx) ** 2 + (v - ay - t * dy) ** 2)
        return pd.Series(np.where(odd, 0.0, np.sqrt(least)))

    return distance(x, y)


def apply_homography(h: list[float], x: Column, y: Column, w_least: float = 0.0) -> Column:
    """Point mapped by nine row-major coefficients; null where the scale is not positive enough."""
    a, b, c, d, e, f, g, i, j = (F.lit(float(v)) for v in h)
    w = g * x + i * y + j
    return F.when(w > w_least, F.struct(((a * x + b * y + c) / w).alias("x"), ((d * x + e * y + f) / w).alias("y")))


def band_position(y: Column, start: Column, end: Column) -> Column:
    return F.when(end != start, (y - start) / (end - start))


def foot_pixel(b: Column, ankles: Column, least_conf: float = 0.5, pad: float = 0.05) -> Column:
    """Mean of confident ankles inside the padded box, else the middle of the box's lower side."""
    px, py = (b["x2"] - b["x1"]) * pad, (b["y2"] - b["y1"]) * pad
    good = F.filter(ankles, lambda k: (k["conf"] >= least_conf) & k["x"].between(b["x1"] - px, b["x2"] + px) & k["y"].between(b["y1"] - py, b["y2"] + py))

    def mean(ok: Column, f: str) -> Column:
        return F.aggregate(ok, F.lit(0.0), lambda s, k: s + k[f]) / F.size(ok)

    def pick(ok: Column) -> Column:
        return F.when(F.size(ok) > 0, F.struct(mean(ok, "x").alias("x"), mean(ok, "y").alias("y"))).otherwise(F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), b["y2"].alias("y")))

    return let(good, pick)


def floor_point(b: Column, ankles: Column, h: list[float], w_least: float = 0.0) -> Column:
    """The foot pixel mapped to the floor."""
    return let(foot_pixel(b, ankles), lambda p: apply_homography(h, p["x"], p["y"], w_least))


def floor_direction(b: Column, ankles: Column, h: list[float], step: float, w_least: float = 0.0) -> Column:
    """Unit direction on the floor of what lies `step` below the box's foot, where no ankle shows; null where one does, or beyond the horizon."""

    def aim(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        n = F.sqrt(dx * dx + dy * dy)
        return F.when(n > 1e-9, F.struct((dx / n).alias("x"), (dy / n).alias("y")))

    def from_foot(foot: Column) -> Column:
        shown = ~((foot["x"] == (b["x1"] + b["x2"]) / 2) & (foot["y"] == b["y2"]))
        return let(F.struct(apply_homography(h, foot["x"], foot["y"], w_least).alias("p"), apply_homography(h, foot["x"], foot["y"] + step, w_least).alias("q")), lambda f: F.when(~shown & f["p"].isNotNull() & f["q"].isNotNull(), aim(f["p"], f["q"])))

    return let(foot_pixel(b, ankles), from_foot)


def confident(keypoints: Column, least: float = 0.5) -> Column:
    """Keypoints with enough confidence that are not at the origin."""
    return F.filter(keypoints, lambda k: (k["conf"] >= least) & ~((k["x"] == 0) & (k["y"] == 0)))


def extension(wrist: Column, shoulder: Column, height: Column) -> Column:
    return F.sqrt(F.pow(wrist["x"] - shoulder["x"], 2) + F.pow(wrist["y"] - shoulder["y"], 2)) / height


def pose_gap(a: Column, b: Column, width: Column, least: float = 0.5) -> Column:
    """Median distance of joints confident in both poses, over the smaller width."""
    pairs = F.filter(F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda z: (z["p"]["conf"] >= least) & (z["q"]["conf"] >= least))
    dist = F.array_sort(F.transform(pairs, lambda z: F.sqrt(F.pow(z["p"]["x"] - z["q"]["x"], 2) + F.pow(z["p"]["y"] - z["q"]["y"], 2))))

    def median(v: Column) -> Column:
        n = F.size(v)
        return F.when(n > 0, (F.get(v, ((n - 1) / 2).cast("int")) + F.get(v, (n / 2).cast("int"))) / 2 / width)

    return let(dist, median)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, clipped to 0..1."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, F.least(F.greatest(dot(a, b) / n, F.lit(0.0)), F.lit(1.0)))


def interpolate(distance: Column, refs: list[float]) -> Column:
    """Fractional count from decreasing reference distances (index = count): linear between, extended past the ends."""
    out = None
    last = len(refs) - 2
    for i in range(last + 1):
        v = i + (F.lit(refs[i]) - distance) / (refs[i] - refs[i + 1])
        out = v if out is None and last == 0 else (F.when(distance >= refs[i + 1], v) if out is None else (out.otherwise(v) if i == last else out.when(distance >= refs[i + 1], v)))
    return out


def ray_distance(px: Column, py: Column, ox: Column, oy: Column, dx: Column, dy: Column) -> Column:
    """Distance of a point from a ray with a unit direction."""
    t = F.greatest((px - ox) * dx + (py - oy) * dy, F.lit(0.0))
    return F.sqrt(F.pow(px - ox - t * dx, 2) + F.pow(py - oy - t * dy, 2))
