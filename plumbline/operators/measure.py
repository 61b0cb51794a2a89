"""Measured areas and lengths of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import _edges, inside
from ..functions.rules import has
from .windows import interval_union

# Words of views that cannot be measured.
PERSPECTIVE = ("3D", "PERSPECTIVE", "ISOMETRIC", "AXONOMET")


def edges(pieces: DataFrame, keys: list[str], outline: str = "points") -> DataFrame:
    """(keys, x0, y0, x1, y1) of each edge of each outline."""
    p = F.col(outline)
    turned = F.concat(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, 1))
    return pieces.filter(F.size(p) >= 2).select(*keys, F.explode(F.arrays_zip(p.alias("a"), turned.alias("b"))).alias("e")).select(*keys, F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))


def auto_trim(pieces: DataFrame, page: str, ft_per_pt: float, bucket: float = 6.0) -> DataFrame:
    """(page, kind, lf). Corners are vertical edges with cladding on one side only, each line once; base and
    top are the silhouette's width twice; openings their outlines; rakes what slopes. Edges under one foot do not count.
    pieces: id, points, holes in points of paper."""
    from .spatial import box_join

    least = max(3.0, 1.0 / ft_per_pt)
    e = edges(pieces, [page, "id"]).withColumn("l", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).filter(F.col("l") >= least)
    e = e.withColumn("deg", F.degrees(F.atan2(F.abs(F.col("y1") - F.col("y0")), F.abs(F.col("x1") - F.col("x0")))))
    up = e.filter("deg >= 60").withColumn("eid", F.xxhash64(page, "id", "x0", "y0", "x1", "y1")).withColumn("xc", (F.col("x0") + F.col("x1")) / 2).withColumn("lo", F.least("y0", "y1")).withColumn("hi", F.greatest("y0", "y1"))
    xs, ys = F.transform("points", lambda q: q["x"]), F.transform("points", lambda q: q["y"])
    box = pieces.select(page, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")).alias("o"))
    # a box counts on a side wherever it lies on that side: only heights must meet, so cells run along y alone
    probe = up.select(page, "eid", "xc", "lo", "hi", F.struct(F.lit(0.0).alias("x0"), F.col("lo").alias("y0"), F.lit(0.0).alias("x1"), F.col("hi").alias("y1")).alias("b"))
    flat = box.withColumn("oo", F.struct(F.lit(0.0).alias("x0"), F.col("o.y0").alias("y0"), F.lit(0.0).alias("x1"), F.col("o.y1").alias("y1")))
    meet = F.least("hi", F.col("o.y1")) - F.greatest("lo", F.col("o.y0")) >= 0.3 * (F.col("hi") - F.col("lo"))
    sides = box_join(probe, flat, [page], "b", "oo", 200.0, test=meet).groupBy(page, "eid").agg(F.bool_or(F.col("o.x0") < F.col("xc") - 4).alias("l"), F.bool_or(F.col("o.x1") > F.col("xc") + 4).alias("r"))
    outer = up.join(sides.filter("l and r"), [page, "eid"], "left_anti").withColumn("k", F.bround(F.col("xc") / bucket))
    corner = interval_union(outer, [page, "k"], "lo", "hi").groupBy(page).agg(F.sum("union_length").alias("pt")).withColumn("kind", F.lit("corner"))
    span = pieces.select(page, F.array_min(xs).alias("a"), F.array_max(xs).alias("b"))
    base = interval_union(span, [page], "a", "b").select(page, (2 * F.col("union_length")).alias("pt"), F.lit("base_top").alias("kind"))
    rake = e.filter("deg > 30 and deg < 60").groupBy(page).agg(F.sum("l").alias("pt")).withColumn("kind", F.lit("rake"))
    hole = edges(pieces.select(page, F.explode("holes").alias("h")), [page], "h").groupBy(page).agg(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("pt")).withColumn("kind", F.lit("opening"))
    lf = F.round(F.col("pt") * ft_per_pt, 1)
    rows = corner.unionByName(base).unionByName(rake).unionByName(hole)
    return rows.filter(F.col("pt") * ft_per_pt >= F.when(F.col("kind") == "rake", 4).otherwise(1)).select(page, "kind", lf.alias("lf"))


def occupancy(polygons: DataFrame, keys: list[str], outline: str, size: float) -> DataFrame:
    """The grid cells whose centre a polygon holds. Union, difference and intersection of polygons are set operations
    of cells, exact to the grid."""
    p = F.col(outline)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    along = lambda v: F.sequence(F.floor(F.array_min(v) / size).cast("bigint"), F.floor(F.array_max(v) / size).cast("bigint"))
    rows = polygons.filter(F.size(p) >= 3).withColumn("cy", F.explode(along(ys))).withColumn("cx", F.explode(along(xs)))
    return rows.filter(inside((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, p)).select(*keys, "cx", "cy")


def scan_lines(polygons: DataFrame, keys: list[str], outline: str, size: float) -> DataFrame:
    """(keys, cy, a, b): the cells a to b - 1 of each row of the grid whose centres a polygon holds, by the even-odd rule: a row for each
    polygon, grid row and run, whatever the run's length."""
    p = F.col(outline)
    ys = F.transform(p, lambda q: q["y"])
    rows = F.sequence(F.floor(F.array_min(ys) / size).cast("bigint"), F.floor(F.array_max(ys) / size).cast("bigint"))
    lines = polygons.filter(F.size(p) >= 3).select(*keys, p.alias("__p"), F.explode(rows).alias("cy"))
    y = (F.col("cy") + 0.5) * size
    crossed = F.filter(_edges(F.col("__p")), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    at = F.transform(crossed, lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    # the first cell whose centre lies at or beyond a crossing
    cells = F.array_sort(F.transform(at, lambda x: F.ceil(x / size - 0.5)))
    runs = F.transform(F.sequence(F.lit(0), F.size("__c") - 2, F.lit(2)), lambda i: F.struct(F.get("__c", i).alias("a"), F.get("__c", i + 1).alias("b")))
    cut = lines.select(*keys, "cy", cells.alias("__c")).filter(F.size("__c") >= 2)
    return cut.select(*keys, "cy", F.explode(runs).alias("r")).select(*keys, "cy", "r.a", "r.b").filter("a < b")


def union_area(polygons: DataFrame, keys: list[str], outline: str, size: float) -> DataFrame:
    """Exact to the grid. Runs of a grid row merge as intervals, so work follows outlines and not areas."""
    merged = interval_union(scan_lines(polygons, keys, outline, size), [*keys, "cy"], "a", "b")
    return merged.groupBy(*keys).agg((F.sum("union_length") * F.lit(size * size)).alias("area"))


def contained(pieces: DataFrame, walls: DataFrame, keys: list[str], size: float, least: float = 0.5) -> DataFrame:
    """(keys, piece, wall, share) where at least half of a piece's cells are a wall's. Both have id and points."""
    a = occupancy(pieces.withColumnRenamed("id", "piece"), [*keys, "piece"], "points", size)
    b = occupancy(walls.withColumnRenamed("id", "wall"), [*keys, "wall"], "points", size)
    whole = a.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("n"))
    shared = a.join(b, [*keys, "cx", "cy"]).groupBy(*keys, "piece", "wall").agg(F.count(F.lit(1)).alias("c"))
    return shared.join(whole, [*keys, "piece"]).withColumn("share", F.col("c") / F.col("n")).filter(F.col("share") >= least).select(*keys, "piece", "wall", "share")


def zone_nets(inside_zone: DataFrame, zone: list[str], area: str, cap: float = 0.85) -> DataFrame:
    """Of the shapes in a zone the largest is its wall, the rest openings, at most 85% of it."""
    w = Window.partitionBy(*zone)
    r = inside_zone.withColumn("__r", F.row_number().over(w.orderBy(F.desc(area), "id")))
    g = r.groupBy(*zone).agg(F.max(area).alias("gross"), F.sum(F.when(F.col("__r") > 1, F.col(area)).otherwise(0.0)).alias("__o"))
    o = F.least(F.col("__o"), cap * F.col("gross"))
    return g.select(*zone, "gross", o.alias("openings"), (F.col("gross") - o).alias("net"))


def bands(levels: DataFrame, page: str, y: str) -> DataFrame:
    """The zones between consecutive story lines."""
    w = Window.partitionBy(page).orderBy(y)
    return levels.select(page, F.col(y).alias("top"), F.lead(y).over(w).alias("bottom")).filter("bottom is not null")


def tag_cuts(tags: DataFrame, face: str, tag: str, along: str) -> DataFrame:
    """Midpoints between the mean places of neighbouring tags of a face."""
    mean = tags.groupBy(face, tag).agg(F.avg(along).alias("m"))
    w = Window.partitionBy(face).orderBy("m", tag)
    return mean.select(face, tag, ((F.col("m") + F.lead("m").over(w)) / 2).alias("cut")).filter("cut is not null")


def view_scales(pieces: DataFrame, anchors: DataFrame, pages: DataFrame, page: str, id_col: str) -> DataFrame:
    """Pieces (box, area_sf) with the scale printed under their view: area_sf, view_scale, scale_risk. anchors: (page, x, y, scale, title) of
    printed scales; pages: (page, height, scale).

    A view's anchors lie from 8 points above the piece's foot to 0.35 of the page below it, and sideways within 60 points and 0.6 of
    its width. If they differ (4 places), the piece is a risk and stays; the nearest one otherwise: a perspective's piece
    goes, and one more than 1% off the page's scale is measured anew by the square of their ratio. Pages whose anchors all
    agree with the page and name no perspective stay as they are. A page has a few anchors, so pieces meet those of their page."""
    persp = lambda t: F.coalesce(has(F.upper(t), *PERSPECTIVE), F.lit(False))
    known = anchors.join(pages.select(page, F.col("height").alias("__h"), F.col("scale").alias("__ps")), page)
    off = F.abs(F.col("scale") - F.col("__ps")) > 0.01 * F.col("__ps")
    mixed = known.filter(off | persp("title")).select(page).distinct()
    b, wide = F.col("box"), F.col("box.x1") - F.col("box.x0")
    d = F.col("y") - b["y1"]
    fit = (d >= -8) & (d <= 0.35 * F.col("__h")) & F.col("x").between(b["x0"] - 0.6 * wide - 60, b["x1"] + 0.6 * wide + 60)
    near = pieces.select(page, id_col, "box").join(known.join(mixed, page, "left_semi"), page).filter(fit).withColumn("__d", d)
    best = near.groupBy(page, id_col).agg(F.countDistinct(F.round("scale", 4)).alias("__n"), F.min(F.struct("__d", "scale", "title")).alias("__a"), F.first("__ps").alias("__ps"))
    own = pieces.join(best, [page, id_col], "left")
    risk = F.coalesce(F.col("__n") > 1, F.lit(False))
    own = own.filter(risk | ~persp("__a.title"))
    new = F.when(~risk & (F.abs(F.col("__a.scale") - F.col("__ps")) > 0.01 * F.col("__ps")), F.col("__a.scale"))
    area = F.when(new.isNull(), F.col("area_sf")).otherwise(F.bround(F.col("area_sf") * F.pow(new / F.col("__ps"), F.lit(2)), 1))
    return own.withColumns({"area_sf": area, "view_scale": new, "scale_risk": risk}).drop("__n", "__a", "__ps")


def rescaled(area: Column, old: Column, new: Column) -> Column:
    """After corners snap, the area follows the outline's."""
    return F.coalesce(area * F.try_divide(new, old), area)


def merged_tiles(tiles: DataFrame, keys: list[str], cls: str, p: str) -> DataFrame:
    """Tiles that overlap: mean probability of each class at each cell, and the best class (the least on ties). Sums and
    counts combine before the shuffle."""
    mean = tiles.groupBy(*keys, cls).agg(F.avg(p).alias("p"))
    return mean.groupBy(*keys).agg(F.min_by(F.struct(cls, "p"), F.struct(-F.col("p"), F.col(cls))).alias("b")).select(*keys, "b.*")
