"""Geometry over array<struct<x, y>> as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(points: Column) -> Column:
    """array<struct<a, b>> of a closed outline."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.arrays_zip(points.alias("a"), turned.alias("b"))


def shoelace(points: Column) -> Column:
    """G1: area of a polygon; 0 below three points."""
    twice = F.aggregate(_edges(points), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.when(F.size(points) >= 3, F.abs(twice) / 2).otherwise(F.lit(0.0))


def inside(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule. The side of an edge is told by products, without a division, so points on it are judged exactly where those are."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        across, along = (x - a["x"]) * (b["y"] - a["y"]), (b["x"] - a["x"]) * (y - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & F.when(b["y"] > a["y"], across < along).otherwise(across > along)

    return F.aggregate(_edges(points), F.lit(False), lambda s, e: F.when(F.coalesce(crosses(e), F.lit(False)), ~s).otherwise(s))


def distance(x: Column, y: Column, points: Column) -> Column:
    """To the nearest edge, 0 inside."""

    def to(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    return F.when(inside(x, y, points), F.lit(0.0)).otherwise(F.array_min(F.transform(_edges(points), to)))


def bbox(points: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def centroid(points: Column) -> Column:
    """Mean of the vertices."""
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / F.size(points)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def overlap_area(a: Column, b: Column) -> Column:
    """Of two boxes struct<x0, y0, x1, y1>."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a: Column) -> Column:
    return F.greatest(a["x1"] - a["x0"], F.lit(0.0)) * F.greatest(a["y1"] - a["y0"], F.lit(0.0))


def cover(a: Column, b: Column) -> Column:
    """Share of box a that box b covers."""
    return F.coalesce(F.try_divide(overlap_area(a, b), box_area(a)), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = overlap_area(a, b)
    return F.coalesce(F.try_divide(both, box_area(a) + box_area(b) - both), F.lit(0.0))


def clip_at(points: Column, axis: str, value: Column, keep_low: bool) -> Column:
    """The part of a polygon on one side of an axis line."""
    side = (lambda p: p[axis] <= value) if keep_low else (lambda p: p[axis] >= value)
    other = "y" if axis == "x" else "x"

    def cut(e: Column) -> Column:
        a, b = e["a"], e["b"]
        t = (value - a[axis]) / (b[axis] - a[axis])
        at = {axis: value, other: a[other] + t * (b[other] - a[other])}
        crossing = F.struct(at["x"].cast("double").alias("x"), at["y"].cast("double").alias("y"))
        own = F.struct(a["x"].cast("double").alias("x"), a["y"].cast("double").alias("y"))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.concat(F.when(side(a), F.array(own)).otherwise(none), F.when(side(a) != side(b), F.array(crossing)).otherwise(none))

    return F.flatten(F.transform(_edges(points), cut))


def points_to_sf(area_pt2: Column, ft_per_in: Column) -> Column:
    """Square points of paper as square feet."""
    return area_pt2 * F.pow(ft_per_in / 72, F.lit(2))


def pixels_to_sf(pixels: Column, ft_per_in: Column, zoom: Column) -> Column:
    return pixels * F.pow(ft_per_in / (zoom * 72), F.lit(2))


def normalised(points: Column, width: Column, height: Column, places: int = 5) -> Column:
    """Points of a page as shares of its size."""
    return F.transform(points, lambda p: F.struct(F.round(p["x"] / width, places).alias("x"), F.round(p["y"] / height, places).alias("y")))


def agreement(a: Column, b: Column) -> Column:
    """M7: the smaller over the larger."""
    return F.try_divide(F.least(a, b), F.greatest(a, b))


def interior_angle(a: Column, b: Column, c: Column) -> Column:
    """at b, in degrees."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ux * vx + uy * vy, F.hypot(ux, uy) * F.hypot(vx, vy))))))
