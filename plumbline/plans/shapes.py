"""Boxes, outlines and clusters derived from part, supplier and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import folds as fold
from ..functions import geometry as G
from ..operators import folds, graph, learned, measure, spatial
from .registry import register, table

__all__ = ["learned"]

#: A page holds 80 parts whatever the table's size. Part boxes: a corner from the key, a width from the size, a height from the key again. Integers, so both engines agree.
BOX_SQL = "SELECT p_partkey AS id, p_partkey // 80 AS page, (p_partkey * 37) % 1000 AS x0, (p_partkey * 91) % 1000 AS y0, (p_partkey * 37) % 1000 + p_size + 5 AS x1, (p_partkey * 91) % 1000 + p_partkey % 60 + 5 AS y1, p_partkey % 3 = 0 AS booked FROM part"

#: The same boxes on a page for each brand, which grows with the table.
BRAND_SQL = BOX_SQL.replace("p_partkey // 80 AS page", "p_brand AS page")


def boxes(spark, sf_dir, page="p_partkey div 80"):
    k = F.col("p_partkey")
    x, y = k * 37 % 1000, k * 91 % 1000
    d = lambda c: c.cast("double")
    box = F.struct(d(x).alias("x0"), d(y).alias("y0"), d(x + F.col("p_size") + 5).alias("x1"), d(y + k % 60 + 5).alias("y1"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.expr(page).alias("page"), box.alias("box"), (k % 3 == 0).alias("booked"))


_OVER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


@register("bbox_cover", f"WITH b AS ({BRAND_SQL}) SELECT a.page, a.id, b.id AS other, round(({_OVER}) / ((a.x1 - a.x0) * (a.y1 - a.y0))::DOUBLE, 6) AS cover FROM b a JOIN b b ON a.page = b.page AND a.id <> b.id AND ({_OVER}) > 0")
def bbox_cover(spark, sf_dir):
    """J16."""
    b = boxes(spark, sf_dir, "p_brand")
    other = b.select("page", F.col("id").alias("other"), F.col("box").alias("o"))
    pairs = spatial.box_join(b, other, ["page"], "box", "o", 50.0, test=(F.col("id") != F.col("other")) & (G.overlap_area(F.col("box"), F.col("o")) > 0))
    return pairs.select("page", "id", "other", F.round(G.cover(F.col("box"), F.col("o")), 6).alias("cover"))


@register("booked_anti_join", f"WITH b AS ({BRAND_SQL}) SELECT page, id FROM b a WHERE NOT booked AND NOT EXISTS (SELECT 1 FROM b WHERE b.booked AND a.page = b.page AND ({_OVER}) / ((a.x1 - a.x0) * (a.y1 - a.y0))::DOUBLE > 0.3)")
def booked_anti_join(spark, sf_dir):
    """J23."""
    b = boxes(spark, sf_dir, "p_brand")
    return spatial.suggestions_kept(b.filter(~F.col("booked")), b.filter("booked"), ["page"], "box", 50.0).select("page", "id")


@register("point_in_bbox", f"WITH b AS ({BRAND_SQL}), p AS (SELECT p_partkey AS pt, p_brand AS page, (p_partkey * 53) % 1000 AS x, (p_partkey * 29) % 1000 AS y FROM part) SELECT b.page, pt, id FROM p JOIN b ON p.page = b.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def point_in_bbox(spark, sf_dir):
    """J15."""
    k = F.col("p_partkey")
    points = table(spark, sf_dir, "part").select(k.alias("pt"), F.col("p_brand").alias("page"), (k * 53 % 1000).cast("double").alias("x"), (k * 29 % 1000).cast("double").alias("y"))
    return spatial.points_in_boxes(points, boxes(spark, sf_dir, "p_brand"), ["page"], "x", "y", "box", 50.0).select("page", "pt", "id")


@register("nearest_label", "WITH a AS (SELECT p_partkey AS id, p_brand AS page, (p_partkey * 37) % 1000 AS x, (p_partkey * 91) % 1000 AS y FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS label, p_brand AS page, (p_partkey * 53) % 1000 AS u, (p_partkey * 29) % 1000 AS v FROM part WHERE p_partkey % 2 = 1), d AS (SELECT a.page, id, label, row_number() OVER (PARTITION BY a.page, id ORDER BY (x - u) * (x - u) + (y - v) * (y - v), label) AS r FROM a JOIN b ON a.page = b.page AND (x - u) * (x - u) + (y - v) * (y - v) <= 14400) SELECT a.page, a.id, label FROM a LEFT JOIN (SELECT * FROM d WHERE r = 1) d ON d.page = a.page AND d.id = a.id")
def nearest_label(spark, sf_dir):
    """The nearest within 120."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    d = lambda m: (k * m % 1000).cast("double")
    a = part.filter(k % 2 == 0).select(k.alias("id"), F.col("p_brand").alias("page"), d(37).alias("x"), d(91).alias("y"))
    b = part.filter(k % 2 == 1).select(k.alias("label"), F.col("p_brand").alias("page"), d(53).alias("u"), d(29).alias("v"))
    return spatial.nearest(a, b, ["page"], ("x", "y"), ("u", "v"), 120.0, "id", "label").select("page", "id", "label")


def _corners(k, w, h):
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(pt(k % 100, k % 70), pt(k % 100 + w, k % 70), pt(k % 100 + w, k % 70 + h), pt(k % 100, k % 70 + h))


@register("shoelace_area", "SELECT p_partkey, ((p_size + 1) * (p_partkey % 9 + 1))::DOUBLE AS area, (((p_size + 1) * (p_partkey % 9 + 1)) / 64.0 * 1)::DOUBLE AS sf_at_9, (p_partkey % 100 + (p_size + 1) / 2.0)::DOUBLE AS cx FROM part")
def shoelace_area(spark, sf_dir):
    """G1, G32, A32."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", _corners(k, F.col("p_size") + 1, k % 9 + 1).alias("p"))
    area = G.shoelace(F.col("p"))
    return p.select("p_partkey", area.alias("area"), G.points_to_sf(area, F.lit(9.0)).alias("sf_at_9"), G.centroid(F.col("p"))["x"].alias("cx"))


@register("point_in_polygon", "SELECT p_partkey, p_partkey % 13 + 0.5 > 0 AND p_partkey % 13 + 0.5 < p_size + 1 AND p_partkey % 5 + 0.5 < p_partkey % 9 + 1 AS inside FROM part")
def point_in_polygon(spark, sf_dir):
    """G2."""
    k = F.col("p_partkey")
    p = _corners(k, F.col("p_size") + 1, k % 9 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", G.inside(k % 100 + k % 13 + 0.5, k % 70 + k % 5 + 0.5, p).alias("inside"))


@register("polygon_split", "SELECT p_partkey, ((p_size + 1) * (p_partkey % 9 + 1) / 2.0)::DOUBLE AS low, ((p_size + 1) * (p_partkey % 9 + 1) / 2.0)::DOUBLE AS high FROM part")
def polygon_split(spark, sf_dir):
    """Both halves of a cut at the middle."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", _corners(k, F.col("p_size") + 1, k % 9 + 1).alias("p"), (k % 100 + (F.col("p_size") + 1) / 2).alias("m"))
    return rows.select("p_partkey", *[G.shoelace(G.clip_at(F.col("p"), "x", F.col("m"), low)).alias(n) for n, low in (("low", True), ("high", False))])


@register("union_area", f"WITH b AS ({BOX_SQL}), c AS (SELECT DISTINCT page, unnest(range(x0, x1)) AS x, y0, y1 FROM b), g AS (SELECT DISTINCT page, x, unnest(range(y0, y1)) AS y FROM c) SELECT page, count(*)::DOUBLE AS area FROM g GROUP BY 1")
def union_area(spark, sf_dir):
    """Union by occupied cells of one unit."""
    b = boxes(spark, sf_dir)
    pt = lambda x, y: F.struct(F.col(f"box.{x}").alias("x"), F.col(f"box.{y}").alias("y"))
    return measure.union_area(b.select("page", F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1")).alias("points")), ["page"], "points", 1.0)


@register(
    "auto_trim",
    f"""
    WITH f AS (SELECT page, id, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h, id % 5 = 0 AS gable, y1 + CASE WHEN id % 5 = 0 THEN (x1 - x0) / 2.0 ELSE 0 END AS top FROM ({BOX_SQL})),
         e AS (SELECT page, id, x0 AS xc, y0 AS lo, y1 AS hi FROM f UNION ALL SELECT page, id, x1, y0, y1 FROM f),
         m AS (SELECT e.page, e.id, xc, lo, hi, bool_or(o.x0 < xc - 4) AND bool_or(o.x1 > xc + 4) AS inner_ FROM e JOIN f o ON o.page = e.page AND least(hi, top) - greatest(lo, o.y0) >= 0.3 * (hi - lo) GROUP BY ALL),
         i AS (SELECT page, 'corner' AS kind, CAST(round_even(xc / 6.0, 0) AS INTEGER) AS k, lo AS a, hi AS b FROM m WHERE NOT inner_ UNION ALL SELECT page, 'base_top', 0, x0, x1 FROM f),
         s AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY page, kind, k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM i),
         g AS (SELECT *, sum(n) OVER (PARTITION BY page, kind, k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM s),
         u AS (SELECT page, kind, max(b) - min(a) AS l FROM g GROUP BY page, kind, k, isle),
         t AS (SELECT page, kind, sum(l) * CASE WHEN kind = 'base_top' THEN 2 ELSE 1 END AS pt FROM u GROUP BY 1, 2 UNION ALL SELECT page, 'rake', sum(w * sqrt(2)) FROM f WHERE gable GROUP BY 1 UNION ALL SELECT page, 'opening', sum(w + h) FROM f WHERE id % 2 = 1 GROUP BY 1)
    SELECT page, kind, round(pt * 0.5::DOUBLE, 1) AS lf FROM t WHERE pt * 0.5 >= CASE WHEN kind = 'rake' THEN 4 ELSE 1 END""",
)
def auto_trim(spark, sf_dir):
    """All four kinds; every fifth part has a gable, every part of odd number a hole."""
    b, c = boxes(spark, sf_dir), lambda n: F.col(f"box.{n}")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    wide, high = c("x1") - c("x0"), c("y1") - c("y0")
    roof = F.when(F.col("id") % 5 == 0, F.array(pt(c("x0") + wide / 2, c("y1") + wide / 2))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    points = F.concat(F.array(pt(c("x0"), c("y0")), pt(c("x1"), c("y0")), pt(c("x1"), c("y1"))), roof, F.array(pt(c("x0"), c("y1"))))
    x, y = [c("x0") + wide * k / 4 for k in (1, 3)], [c("y0") + high * k / 4 for k in (1, 3)]
    holes = F.when(F.col("id") % 2 == 1, F.array(F.array(pt(x[0], y[0]), pt(x[1], y[0]), pt(x[1], y[1]), pt(x[0], y[1])))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    return measure.auto_trim(b.select("page", "id", points.alias("points"), holes.alias("holes")), "page", 0.5)


@register("spaced_values", None)
def spaced_values(spark, sf_dir):
    """Folds over the sorted quantities of each order; no SQL: each step depends on the last kept value."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    v = F.col("v")
    return g.select("l_orderkey", F.to_json(fold.spaced(v, 6)).alias("spaced"), F.to_json(fold.merged_runs(F.array_sort(v), 8)).alias("runs"), F.to_json(fold.budgeted(v, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) * 0.4)).alias("openings"))


def _flat(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", "page", "box.*")


@register("greedy_nms")
def greedy_nms(spark, sf_dir):
    """U8: no SQL: each step depends on what was kept."""
    return folds.greedy_nms(_flat(spark, sf_dir), ["page"])


@register("twins_dropped")
def twins_dropped(spark, sf_dir):
    """U9."""
    return folds.twins_dropped(_flat(spark, sf_dir), ["page"], 0.5)


@register("outermost_frames")
def outermost_frames(spark, sf_dir):
    """U7."""
    return folds.outermost(_flat(spark, sf_dir), ["page"])


@register("overlap_shave")
def overlap_shave(spark, sf_dir):
    """Boxes in shares of a page of 1100; every seventh is a filled wall, every eleventh a patch. No SQL: each step depends on
    what was claimed."""
    pt = lambda x, y: F.struct((F.col(f"box.{x}") / 1100).alias("x"), (F.col(f"box.{y}") / 1100).alias("y"))
    k, b = F.col("id"), boxes(spark, sf_dir)
    area = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    material = F.when(k % 7 == 0, "Panel wall (drawn fill)").otherwise("Wall area")
    rows = b.select("page", "id", material.alias("material"), F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1")).alias("points"), area.alias("area_sf"), (k % 11 == 0).alias("patch"), F.lit(1.0).alias("aspect"))
    return folds.shaved(rows, ["page"]).select("page", "id", "material", "area_sf", "patch")


@register("snap_points")
def snap_points(spark, sf_dir):
    """U10."""
    return folds.spread_points(_flat(spark, sf_dir).select("id", "page", F.col("x0").alias("x"), F.col("y0").alias("y")), ["page"])


@register("openings_cap")
def openings_cap(spark, sf_dir):
    """G10, F15."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.xxhash64("l_partkey", "l_suppkey", "l_quantity").alias("id"), "l_quantity", F.lit(400.0).alias("wall"))
    return folds.guarded_openings(rows, ["l_orderkey"], "l_quantity", "wall")


@register(
    "components",
    """
    WITH RECURSIVE l AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
         r AS (SELECT a AS n, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n)
    SELECT CASE WHEN n % 2 = 0 THEN 'part' ELSE 'supplier' END AS kind, n // 2 AS key, min(c) AS component FROM r GROUP BY n""",
)
def components(spark, sf_dir):
    """K1 over every part-supplier edge of lineitem. Parts are even nodes, suppliers odd ones."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey").cast("bigint") * 2).alias("a"), (F.col("l_suppkey").cast("bigint") * 2 + 1).alias("b"))
    return graph.components(e, "a", "b").select(F.when(F.col("node") % 2 == 0, "part").otherwise("supplier").alias("kind"), F.floor(F.col("node") / 2).alias("key"), "component")


@register("line_clusters", "WITH l AS (SELECT p_partkey AS id, p_brand AS page, (p_partkey * 37) % 2000 AS c, (p_partkey * 91) % 500 AS a0, (p_partkey * 91) % 500 + p_size * 4 + 10 AS a1 FROM part) SELECT p.page, p.id AS a, q.id AS b FROM l p JOIN l q ON p.page = q.page AND p.id < q.id AND abs(p.c - q.c) < 45 AND least(p.a1, q.a1) - greatest(p.a0, q.a0) > 0.5 * least(p.a1 - p.a0, q.a1 - q.a0)")
def line_clusters(spark, sf_dir):
    """J21."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("page"), (k * 37 % 2000).alias("c"), (k * 91 % 500).alias("a0"), (k * 91 % 500 + F.col("p_size") * 4 + 10).alias("a1"))
    return graph.line_edges(rows, ["page"])


_SHARES = f"b AS (SELECT id, page, p_partkey // 2 % 2 AS type, p_retailprice AS sf, x0 / 1100.0::DOUBLE AS x0, y0 / 1100.0::DOUBLE AS y0, x1 / 1100.0::DOUBLE AS x1, y1 / 1100.0::DOUBLE AS y1 FROM ({BOX_SQL}) JOIN part ON p_partkey = id)"


@register(
    "weld_rollup",
    f"""
    WITH RECURSIVE {_SHARES}, e AS (SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.page = b.page AND a.type = b.type AND a.id <> b.id AND a.x0 - 0.015 <= b.x1 AND b.x0 <= a.x1 + 0.015 AND a.y0 - 0.015 <= b.y1 AND b.y0 <= a.y1 + 0.015),
         r AS (SELECT id AS n, id AS c FROM b UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n), m AS (SELECT n, min(c) AS c FROM r GROUP BY 1),
         w AS (SELECT c, max(x1) - min(x0) > 0.55 AND max(y1) - min(y0) > 0.55 AS wide FROM m JOIN b ON id = n GROUP BY 1),
         g AS (SELECT b.*, CASE WHEN wide THEN id ELSE c END AS cluster FROM b JOIN m ON id = n JOIN w USING (c))
    SELECT cluster, CAST(sum(CAST(sf AS DECIMAL(18,2))) AS DOUBLE) AS area_sf, CAST(count(*) AS BIGINT) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY 1""",
)
def weld_rollup(spark, sf_dir):
    """G7 over the boxes of all parts, in shares of a page of 1100 points; pieces of one page and type whose boxes lie within 0.015
    are linked."""
    share = F.struct(*[(F.col(f"box.{c}") / 1100).alias(c) for c in ("x0", "y0", "x1", "y1")])
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2 % 2").alias("type"), F.col("p_retailprice").alias("sf"))
    pieces = boxes(spark, sf_dir).select("id", "page", share.alias("box")).join(part, "id")
    other = pieces.select("page", "type", F.col("id").alias("other"), F.col("box").alias("o"))
    e = spatial.box_join(pieces, other, ["page", "type"], "box", "o", 0.1, 0.015, F.col("id") < F.col("other")).select(F.col("id").alias("a"), F.col("other").alias("b"))
    return graph.weld_rollup(pieces.select("id", "sf", "box.*"), e, "sf")


@register("tiled_inference")
def tiled_inference(spark, sf_dir):
    """K6: a stand-in model (mean of a vector) through the hook; no SQL."""
    import pandas as pd

    from ..sources.documents import model_rows

    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", "embedding")
    return model_rows(rows, lambda: "mean", lambda _, pdf: pd.DataFrame({"vec_id": pdf["vec_id"], "p": [float(sum(v)) / max(len(v), 1) for v in pdf["embedding"]]}), "vec_id bigint, p double")
