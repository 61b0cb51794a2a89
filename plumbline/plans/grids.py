"""Page grids derived from lineitem: regions, neighbours, masks, floods and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regions, trains
from .registry import register, table

#: Pages of 40 by 40 places, about 1000 rows of lineitem each whatever the table's size; tiles are small, so that pages have several.
SIDE, ROWS, TILE = 40, 250, 16
CELL_SQL = f"SELECT l_orderkey // {ROWS} AS page, (l_partkey * 7 % {SIDE})::INT AS x, ((l_suppkey * 11 + l_linenumber) % {SIDE})::INT AS y, min(l_quantity) > 10 AS v FROM lineitem GROUP BY 1, 2, 3"
_REGION_SQL = f"""
    c AS ({CELL_SQL}), steps AS (SELECT unnest([1, -1, 0, 0]) AS dx, unnest([0, 0, 1, -1]) AS dy),
    reach AS (SELECT page, x, y, v, y AS ry, x AS rx FROM c UNION SELECT n.page, n.x, n.y, n.v, r.ry, r.rx FROM (SELECT page, x + dx AS x, y + dy AS y, v, ry, rx FROM reach, steps) r JOIN c n USING (page, x, y, v)),
    cells AS (SELECT page, x, y, v, min((ry, rx)) AS region FROM reach GROUP BY 1, 2, 3, 4)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_partkey") * 7 % SIDE, (F.col("l_suppkey") * 11 + F.col("l_linenumber")) % SIDE
    page = F.expr(f"l_orderkey div {ROWS}").alias("page")
    return table(spark, sf_dir, "lineitem").groupBy(page, x.cast("int").alias("x"), y.cast("int").alias("y")).agg((F.min("l_quantity") > 10).alias("v"))


def regions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.labelled(cells(spark, sf_dir), ["page"], "v", tile=TILE)


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.expr(f"l_orderkey div {ROWS}").alias("page")).distinct().select("page", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """Regions as two columns each."""
    out = df
    for c in columns:
        out = out.withColumns({f"{c}_y": F.col(f"{c}.y"), f"{c}_x": F.col(f"{c}.x")}).drop(c)
    return out


@register("page_regions", f"WITH RECURSIVE {_REGION_SQL} SELECT page, x, y, region[1] AS region_y, region[2] AS region_x FROM cells")
def page_regions(spark, sf_dir):
    """Components of equal cells, over several tiles."""
    return _named(regions_of(spark, sf_dir).select("page", "x", "y", "region"), "region")


@register("region_neighbours", f"WITH RECURSIVE {_REGION_SQL}, p AS (SELECT a.page, least(a.region, b.region) AS a, greatest(a.region, b.region) AS b FROM cells a JOIN cells b ON a.page = b.page AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) WHERE a.region <> b.region) SELECT page, a[1] AS a_y, a[2] AS a_x, b[1] AS b_y, b[2] AS b_x, count(*) AS length FROM p GROUP BY ALL")
def region_neighbours(spark, sf_dir):
    """K5: regions beside each other, by the sides that they share."""
    return _named(regions.neighbours(regions_of(spark, sf_dir), ["page"]), "a", "b")


@register("region_outlines", f"WITH RECURSIVE {_REGION_SQL}, o AS (SELECT page, region, count(*) AS covered FROM cells a JOIN cells b USING (page, region) WHERE abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2), s AS (SELECT page, region, count(*) AS area FROM cells GROUP BY 1, 2) SELECT page, region[1] AS region_y, region[2] AS region_x, area::DOUBLE AS area, 4 * area - coalesce(covered, 0) AS perimeter FROM s LEFT JOIN o USING (page, region)")
def region_outlines(spark, sf_dir):
    """Rings around regions; together they enclose the region's cells, and have its open sides."""
    rings = regions.outlines(regions_of(spark, sf_dir), ["page"])
    turned = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    pairs = F.arrays_zip(F.col("points").alias("a"), turned.alias("b"))
    area = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)
    around = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, e: s + F.abs(e["a"]["x"] - e["b"]["x"]) + F.abs(e["a"]["y"] - e["b"]["y"]))
    return _named(rings.groupBy("page", "region").agg(F.sum(area).alias("area"), F.sum(around).alias("perimeter")), "region")


@register("closed_masks", f"WITH c AS ({CELL_SQL}), d AS (SELECT unnest(range(-1, 2)) AS dx), e AS (SELECT a.dx, b.dx AS dy FROM d a, d b), w AS (SELECT DISTINCT page, x + dx AS x, y + dy AS y FROM c, e WHERE v) SELECT page, x + dx AS x, y + dy AS y FROM w, e GROUP BY ALL HAVING count(*) = 9")
def closed_masks(spark, sf_dir):
    """Masks closed by squares of three places a side."""
    return regions.closed(cells(spark, sf_dir).filter("v"), ["page"], 1)


@register(
    "mask_holes",
    f"""
    WITH RECURSIVE c AS ({CELL_SQL}), a AS (SELECT page, x::INT AS x, y::INT AS y FROM (SELECT DISTINCT page FROM c), (SELECT unnest(range({SIDE})) AS x), (SELECT unnest(range({SIDE})) AS y)), b AS (SELECT * FROM a ANTI JOIN c USING (page, x, y)),
         steps AS (SELECT unnest([1, -1, 0, 0]) AS dx, unnest([0, 0, 1, -1]) AS dy),
         open AS (SELECT page, x, y FROM b WHERE x = 0 AND y = 0 UNION SELECT b.page, b.x, b.y FROM (SELECT page, x + dx AS x, y + dy AS y FROM open, steps) o JOIN b USING (page, x, y))
    SELECT page, x, y FROM b ANTI JOIN open USING (page, x, y)""",
)
def mask_holes(spark, sf_dir):
    """What a flood from the page's first place does not reach."""
    return regions.holes(cells(spark, sf_dir), sheets(spark, sf_dir), ["page"], tile=TILE).select("page", "x", "y")


@register("marker_watersheds")
def marker_watersheds(spark, sf_dir):
    """K7: watersheds of heights from the quantities of cells, from every 37th part as a marker."""
    rows = table(spark, sf_dir, "lineitem")
    own = cells(spark, sf_dir).drop("v")
    page, x, y = F.expr(f"l_orderkey div {ROWS}").alias("page"), (F.col("l_partkey") * 7 % SIDE).cast("int").alias("x"), ((F.col("l_suppkey") * 11 + F.col("l_linenumber")) % SIDE).cast("int").alias("y")
    wide = regions.dilated(own, ["page"], 1).join(rows.groupBy(page, x, y).agg(F.max("l_quantity").alias("h")), ["page", "x", "y"], "left").select("page", "x", "y", F.coalesce("h", F.lit(25.0)).alias("h"))
    marks = rows.filter("l_partkey % 37 = 0").select(page, x, y, F.col("l_partkey").alias("seed"))
    return regions.flood(wide, marks, ["page"], "h", tile=TILE)


@register("tag_fills")
def tag_fills(spark, sf_dir):
    """Blank areas of the pages, claimed by repeated tags; every sixth place was claimed before."""
    spots = sheets(spark, sf_dir).withColumn("ft_per_cell", F.lit(4.0))
    free = regions.blank(regions.dilated(cells(spark, sf_dir).filter("v"), ["page"], 0), spots, ["page"]).withColumn("taken", (F.col("x") * 5 + F.col("y") * 3) % 17 == 0)
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    seeds = rows.select(F.expr(f"l_orderkey div {ROWS}").alias("page"), F.col("l_orderkey").alias("seed"), (F.col("l_partkey") * 13 % SIDE).cast("double").alias("x"), (F.col("l_suppkey") * 17 % SIDE).cast("double").alias("y"), F.concat(F.lit("T"), (F.col("l_partkey") % 50).cast("string")).alias("tag"))
    return _named(regions.tag_fills(free, seeds, spots, ["page"], tile=TILE), "region")


@register("train_walls")
def train_walls(spark, sf_dir):
    """Six clusters of lines a page of about 250 rows, with their area, outline and name."""
    rows, g = table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 6
    page = F.expr("l_orderkey div 60").alias("page")
    axis = F.when(g % 2 == 0, "v").otherwise("h").alias("axis")
    a0 = g * 40 + F.col("l_linenumber") * 2
    lines = rows.select(page, axis, (g * 70 + F.col("l_orderkey") % 15 * (4 + g)).cast("double").alias("c"), a0.cast("double").alias("a0"), (a0 + 90 + F.col("l_quantity")).cast("double").alias("a1"))
    crossing = rows.filter("l_linenumber = 7").select(page, axis, (g * 70.0).alias("b0"), (g * 70 + F.col("l_quantity") * 4).cast("double").alias("b1"), (g * 40 + F.col("l_partkey") % 100).cast("double").alias("bc"))
    pages = rows.select(page).distinct().select("page", F.lit(700.0).alias("width"), F.lit(600.0).alias("height"))
    found = trains.plausible_trains(trains.train_regions(lines, crossing, pages, ["page"]), F.lit(0.111))
    snaps = F.array(*[F.lit(40.0 * k) for k in range(12)])
    return found.select("page", "axis", F.col("train.c").alias("first"), F.size("lines").alias("n_lines"), "spacing", "med_len", "material", F.round(trains.train_area(F.col("lines")), 6).alias("area_pt2"), F.size(trains.train_outline(F.col("axis"), F.col("lines"), snaps)).alias("corners"))


@register("hatch_areas")
def hatch_areas(spark, sf_dir):
    """Patches of strokes at three angles on pages of about 3200 rows; cells that the smaller parts hold are taken."""
    rows, g = table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 10
    page = F.expr("l_orderkey div 800").alias("page")
    x, y = g % 5 * 170 + F.col("l_partkey") % 20 * 6, F.floor(g / 5) * 280 + 40 + F.col("l_linenumber") * 20
    lean = F.when(g % 3 == 0, 18.0).when(g % 3 == 1, -18.0).otherwise((F.col("l_quantity") - 25).cast("double"))
    strokes = rows.select(page, x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + lean).cast("double").alias("x1"), (y + 18).cast("double").alias("y1"))
    pages = rows.select(page).distinct().select("page", F.lit(900.0).alias("width"), F.lit(600.0).alias("height"), F.lit(0.125).alias("ft_per_pt"))
    taken = rows.filter("l_suppkey % 10 = 3").select(page, (F.col("l_partkey") % 60).cast("int").alias("y")).distinct().select("page", F.explode(F.sequence(F.lit(170), F.lit(220))).alias("x"), "y")
    return _named(trains.hatched(strokes, taken, pages, ["page"], tile=64, grid=300), "region")
