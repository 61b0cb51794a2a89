"""What sheets say and what pieces are: predicates, marks, levels, votes and verdicts over part, lineitem, orders and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, parse
from ..operators import graph, measure, pages, reconcile, rollup, scales, spatial, windows
from ..sources import documents, tables
from .names import sql_list
from .registry import register, table
from .shapes import BOX_SQL, BRAND_SQL, boxes


def pick(values: list[str], at):
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


@register("counted_pieces", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N' AND l_discount > 0")
def counted_pieces(spark, sf_dir):
    """F2."""
    rows = table(spark, sf_dir, "lineitem").withColumn("suggest_only", F.when(F.col("l_returnflag") == "N", True).when(F.col("l_returnflag") == "A", False))
    return rollup.counted(rows, "l_discount").select("l_orderkey", "l_linenumber")


@register("size_outliers", "SELECT p_partkey, p_size / 50.0 > 0.5 AND p_partkey % 4 NOT IN (0, 1) AND p_partkey % 3 <> 0 AS outlier FROM part")
def size_outliers(spark, sf_dir):
    """F8."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", pages.size_outlier(F.col("p_size") / 50, pick(["v13", "markup", "train", "flood"], k % 4), F.when(k % 3 == 0, True)).alias("outlier"))


_JOBS = ["job-1", "a.b_C", "..", "", "x/y", "job 7", "J" * 64, "J" * 65, "é"]


@register("job_ids", f"SELECT p_partkey, p_partkey % {len(_JOBS)} IN (0, 1, 6) AS ok FROM part")
def job_ids(spark, sf_dir):
    """F23."""
    return table(spark, sf_dir, "part").select("p_partkey", parse.job_id_ok(pick(_JOBS, F.col("p_partkey") % len(_JOBS))).alias("ok"))


# Titles, sheets, and whether and why a page is admitted, worked out by hand.
_ADMIT = [("EAST ELEVATION", "A-201", True, "title"), ("SEE EAST ELEVATION", "A-201", False, "none"), ("INTERIOR ELEVATIONS", "A-401", True, "series"), ("Partial elevation", "", True, "title"), ("ROOF PLAN", "A4.1", True, "series"), ("ROOF PLAN", "A-14", False, "none"), ("DETAILS", "A41", True, "series"), ("DETAILS", "A4", False, "none")]


@register("page_admission", f"SELECT o_orderkey, {[a for *_, a, _ in _ADMIT]}[CAST(o_orderkey % {len(_ADMIT)} AS INTEGER) + 1] AS admit, {sql_list([r for *_, r in _ADMIT])}[CAST(o_orderkey % {len(_ADMIT)} AS INTEGER) + 1] AS reason FROM orders")
def page_admission(spark, sf_dir):
    """F31."""
    at = F.col("o_orderkey") % len(_ADMIT)
    return table(spark, sf_dir, "orders").select("o_orderkey", pages.admission(pick([t for t, *_ in _ADMIT], at), pick([s for _, s, *_ in _ADMIT], at)).alias("v")).select("o_orderkey", "v.admit", "v.reason")


@register("title_block", f"SELECT id FROM ({BOX_SQL}) WHERE x0 >= 820 AND y0 >= 400")
def title_block(spark, sf_dir):
    """F33, on a page of 1000 by 500."""
    b = boxes(spark, sf_dir)
    return b.filter(pages.in_title_block(F.col("box.x0"), F.col("box.y0"), F.lit(1000.0), F.lit(500.0))).select("id")


@register("small_faces", f"WITH b AS (SELECT id, page, id % 2 AS g, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) / 10.0 AS a FROM ({BOX_SQL})) SELECT id FROM b WHERE a >= 100 UNION ALL SELECT id FROM b s WHERE a >= 30 AND a < 100 AND g = 0 AND EXISTS (SELECT 1 FROM b WHERE b.a >= 100 AND b.page = s.page AND b.g = s.g AND s.x0 - 60 <= b.x1 AND b.x0 <= s.x1 + 60 AND s.y0 - 60 <= b.y1 AND b.y0 <= s.y1 + 60)")
def small_faces(spark, sf_dir):
    """On a page of 1000 points, whose gap is 60 points, so that no box is rounded; filled walls are no small faces."""
    area = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0")) / 10
    faces = boxes(spark, sf_dir).select("id", "page", F.when(F.col("id") % 2 == 0, "Vertical panel - 2.0' seams").otherwise("Panel wall (drawn fill)").alias("group"), area.alias("area"), "box")
    return spatial.small_faces_kept(faces, ["page"], "group", "area", "box", size=250.0, gap=60.0).select("id")


_KEYED = "WITH w AS (SELECT p_partkey AS k, p_brand AS page, p_partkey * 37 % 1000 + 12 AS x1, p_partkey * 91 % 1000 + 4 AS mid FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS seq, p_brand AS page, p_partkey * 53 % 1000 AS x0, p_partkey * 29 % 1000 AS y0, 'block ' || p_partkey AS text FROM part WHERE p_partkey % 2 = 1) SELECT page, 'K' || k AS key, arg_min(text, {order}) AS text FROM w JOIN b USING (page) WHERE x0 - x1 >= -4 AND x0 - x1 < 180 AND mid BETWEEN y0 - 8 AND y0 + 18 GROUP BY 1, 2"


def _keyed(spark, sf_dir, by_gap):
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    d = lambda c: c.cast("double")
    words = part.filter(k % 2 == 0).select(F.col("p_brand").alias("page"), F.concat(F.lit("K"), k.cast("string")).alias("key"), d(k * 37 % 1000).alias("x0"), d(k * 91 % 1000).alias("y0"), d(k * 37 % 1000 + 12).alias("x1"), d(k * 91 % 1000 + 8).alias("y1"))
    blocks = part.filter(k % 2 == 1).select(F.col("p_brand").alias("page"), k.alias("seq"), d(k * 53 % 1000).alias("bx0"), d(k * 29 % 1000).alias("by0"), d(k * 53 % 1000 + 40).alias("bx1"), d(k * 29 % 1000 + 10).alias("by1"), F.concat(F.lit("block "), k.cast("string")).alias("text"))
    return spatial.key_left_of(words, blocks, ["page"], by_gap)


@register("legend_pairs", _KEYED.format(order="seq"))
def legend_pairs(spark, sf_dir):
    """The first block in order."""
    return _keyed(spark, sf_dir, False)


@register("loose_pairs", _KEYED.format(order="(x0 - x1, seq)"))
def loose_pairs(spark, sf_dir):
    """The nearest block."""
    return _keyed(spark, sf_dir, True)


@register(
    "dimension_votes",
    """
    WITH w AS (SELECT p_partkey AS id, p_brand AS page, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y, p_size AS f FROM part WHERE p_partkey % 2 = 0),
         s AS (SELECT DISTINCT p_brand AS page, p_partkey * 53 % 1000 AS a0, p_partkey * 53 % 1000 + p_size * 8 AS a1, p_partkey * 29 % 1000 AS c FROM part WHERE p_partkey % 2 = 1)
    SELECT DISTINCT page, id, f / (a1 - a0)::DOUBLE AS ft_per_pt FROM w JOIN s USING (page) WHERE x BETWEEN a0 + 0.02::DOUBLE * (a1 - a0) AND a1 - 0.02::DOUBLE * (a1 - a0) AND abs(y - c) <= 30 AND f / (a1 - a0)::DOUBLE * 72 BETWEEN 0.5 AND 40""",
)
def dimension_votes(spark, sf_dir):
    """J12."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    d = lambda c: c.cast("double")
    words = part.filter(k % 2 == 0).select(k.alias("id"), F.col("p_brand").alias("page"), d(k * 37 % 1000).alias("along"), d(k * 91 % 1000).alias("across"), d(F.col("p_size")).alias("feet"))
    lines = part.filter(k % 2 == 1).select(F.col("p_brand").alias("page"), d(k * 53 % 1000).alias("a0"), d(k * 53 % 1000 + F.col("p_size") * 8).alias("a1"), d(k * 29 % 1000).alias("c"))
    return spatial.line_votes(words, lines, ["page"])


@register("points_in_triangles", f"WITH b AS ({BRAND_SQL}), p AS (SELECT p_partkey AS pt, p_brand AS page, p_partkey * 53 % 1000 + 0.25 AS x, p_partkey * 29 % 1000 + 0.5 AS y FROM part) SELECT b.page, pt, id FROM p JOIN b USING (page) WHERE x > x0 AND x < x1 AND y > y0 AND y < y1 AND (x - x0) * (y1 - y0) + (y - y0) * (x1 - x0) < (x1 - x0) * (y1 - y0)")
def points_in_triangles(spark, sf_dir):
    """The lower left half of each box."""
    k = F.col("p_partkey")
    pt = lambda x, y: F.struct(F.col(f"box.{x}").alias("x"), F.col(f"box.{y}").alias("y"))
    faces = boxes(spark, sf_dir, "p_brand").select("page", "id", "box", F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x0", "y1")).alias("points"))
    points = table(spark, sf_dir, "part").select(k.alias("pt"), F.col("p_brand").alias("page"), (k * 53 % 1000 + 0.25).alias("x"), (k * 29 % 1000 + 0.5).alias("y"))
    return spatial.points_in_polygons(points, faces, ["page"], "x", "y", "points", "box", 50.0).select("page", "pt", "id")


@register("triangle_distance", "SELECT p_partkey, round(CASE WHEN x <= 0 OR y <= 0 THEN sqrt(pow(greatest(-x, x - 8, 0), 2) + pow(greatest(-y, y - 8, 0), 2)) WHEN x + y <= 8 THEN 0 WHEN x - y > 8 THEN sqrt(pow(x - 8, 2) + y * y) WHEN y - x > 8 THEN sqrt(x * x + pow(y - 8, 2)) ELSE (x + y - 8) / sqrt(2) END, 6) AS d FROM (SELECT p_partkey, p_partkey % 23 - 5.5::DOUBLE AS x, p_size % 19 - 4.5::DOUBLE AS y FROM part)")
def triangle_distance(spark, sf_dir):
    """To a triangle with sides of 8 along the axes."""
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    x, y = F.col("p_partkey") % 23 - 5.5, F.col("p_size") % 19 - 4.5
    return table(spark, sf_dir, "part").select("p_partkey", F.round(geometry.distance(x, y, F.array(at(0, 0), at(8, 0), at(0, 8))), 6).alias("d"))


@register("flags_on_pages", "SELECT DISTINCT c_nationkey AS job, c_custkey % 9 AS page, c_mktsegment AS flag, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 9 = c_custkey % 9) THEN 'page' ELSE 'job' END AS on_ FROM customer")
def flags_on_pages(spark, sf_dir):
    """J36, U12."""
    flags = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("job"), (F.col("c_custkey") % 9).alias("page"), F.col("c_mktsegment").alias("flag"))
    held = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("job"), (F.col("s_suppkey") % 9).alias("page")).distinct()
    return reconcile.flags_on_pages(flags, held, "job", "page", "flag").withColumnRenamed("on", "on_")


@register("sentinel_pages", "SELECT * FROM (SELECT l_orderkey, 'TYP_OF' AS sentinel, count(*) AS pages FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT l_orderkey, 'REWORK', count(*) FROM lineitem WHERE l_quantity > 30 GROUP BY 1)")
def sentinel_pages(spark, sf_dir):
    """A36."""
    found = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "TYP_OF"), F.when(F.col("l_quantity") > 30, "REWORK")))
    return reconcile.sentinel_counts(table(spark, sf_dir, "lineitem").withColumn("found", found), "l_orderkey", "found")


@register(
    "job_verdicts",
    """
    WITH c AS (SELECT l_orderkey AS job, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1), l AS (SELECT DISTINCT l_orderkey AS job FROM lineitem WHERE l_quantity > 48), f AS (SELECT DISTINCT o_orderkey AS job FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT job, CASE WHEN ok AND job NOT IN (SELECT job FROM l) AND job NOT IN (SELECT job FROM f) THEN 'verified' ELSE 'unverified' END AS verdict,
           concat_ws('|', CASE WHEN NOT ok THEN 'totals: fail' END, CASE WHEN job IN (SELECT job FROM l) THEN 'left over' END, CASE WHEN job IN (SELECT job FROM f) THEN 'SCALE_UNREAD' END) AS reasons FROM c""",
)
def job_verdicts(spark, sf_dir):
    """Checks, list entries and critical flags."""
    rows = table(spark, sf_dir, "lineitem")
    checks = rows.select(F.col("l_orderkey").alias("job"), F.lit("totals").alias("check"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass").alias("status"))
    lists = rows.filter("l_quantity > 48").select(F.col("l_orderkey").alias("job"), F.lit("left over").alias("reason"))
    flags = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("warn").alias("severity"), F.lit("SCALE_UNREAD").alias("code"))
    return reconcile.verdict(checks, lists, flags, "job").withColumn("reasons", F.array_join("reasons", "|"))


@register("resolved_scales", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE CASE WHEN p_partkey % 5 = 0 THEN 16 ELSE 8 END END::DOUBLE AS value, p_partkey % 3 = 0 AS confirmed, CASE WHEN p_partkey % 3 = 0 THEN 'text' WHEN p_partkey % 5 = 0 THEN 'dims' ELSE 'default' END AS source FROM part")
def resolved_scales(spark, sf_dir):
    """A47, A48."""
    k = F.col("p_partkey")
    way = lambda on, value, sure, source: F.when(on, F.struct(value.cast("double").alias("value"), F.lit(sure).alias("confirmed"), F.lit(source).alias("source")))
    return table(spark, sf_dir, "part").select("p_partkey", pages.resolved_scale(way(k % 3 == 0, F.col("p_size"), True, "text"), way(k % 5 == 0, F.lit(16), False, "dims")).alias("s")).select("p_partkey", "s.*")


@register("story_bands", "SELECT * FROM (SELECT p_brand, y::DOUBLE AS top, lead(y) OVER (PARTITION BY p_brand ORDER BY y)::DOUBLE AS bottom FROM (SELECT DISTINCT p_brand, p_partkey * 91 % 1000 AS y FROM part)) WHERE bottom IS NOT NULL")
def story_bands(spark, sf_dir):
    """G19."""
    levels = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") * 91 % 1000).cast("double").alias("y")).distinct()
    return measure.bands(levels, "p_brand", "y")


@register("tag_cuts", "WITH m AS (SELECT p_brand, p_type, avg(p_size) AS m FROM part GROUP BY 1, 2) SELECT p_brand, p_type, round(cut, 6) AS cut FROM (SELECT p_brand, p_type, (m + lead(m) OVER (PARTITION BY p_brand ORDER BY m, p_type)) / 2 AS cut FROM m) WHERE cut IS NOT NULL")
def tag_cuts(spark, sf_dir):
    """G20."""
    return measure.tag_cuts(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_size").withColumn("cut", F.round("cut", 6))


@register(
    "view_scales",
    f"""
    WITH b AS (SELECT id, id // 80 AS page, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) / 10.0::DOUBLE AS area FROM ({BOX_SQL})),
         a AS (SELECT p_partkey // 80 AS page, p_partkey * 53 % 1000 AS x, p_partkey * 29 % 1000 AS y, CASE WHEN p_partkey % 3 = 0 THEN 4.0 WHEN p_partkey % 3 = 1 THEN 8.0 ELSE 8.04 END::DOUBLE AS s, p_partkey % 11 = 0 AS p FROM part WHERE p_partkey % 13 = 0),
         mixed AS (SELECT DISTINCT page FROM a WHERE abs(s - 8.0) > 0.08 OR p),
         n AS (SELECT b.id, a.y - b.y1 AS d, s, p, CASE WHEN p THEN '3D view' ELSE 'Elevation' END AS title FROM b JOIN a ON a.page = b.page AND a.page IN (FROM mixed) WHERE a.y - b.y1 BETWEEN -8 AND 350 AND a.x BETWEEN b.x0 - 0.6 * (b.x1 - b.x0) - 60 AND b.x1 + 0.6 * (b.x1 - b.x0) + 60),
         g AS (SELECT id, count(DISTINCT round(s, 4)) AS n, arg_min(s, (d, s, title)) AS s, arg_min(p, (d, s, title)) AS p FROM n GROUP BY id)
    SELECT b.id, CASE WHEN n = 1 AND abs(s - 8) > 0.08 THEN round_even(area * pow(s / 8, 2), 1) ELSE area END::DOUBLE AS area_sf, CASE WHEN n = 1 AND abs(s - 8) > 0.08 THEN s END::DOUBLE AS view_scale, coalesce(n > 1, false) AS scale_risk
    FROM b LEFT JOIN g USING (id) WHERE coalesce(n > 1 OR NOT p, true)""",
)
def view_scales(spark, sf_dir):
    """Notes at 4, 8 and 8.04 feet on pages of 8, some under a perspective."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    page = F.expr("p_partkey div 80").alias("page")
    pieces = boxes(spark, sf_dir).select("id", F.expr("id div 80").alias("page"), "box", ((F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0")) / 10).alias("area_sf"))
    scale = F.when(k % 3 == 0, 4.0).when(k % 3 == 1, 8.0).otherwise(8.04)
    anchors = part.filter(k % 13 == 0).select(page, (k * 53 % 1000).cast("double").alias("x"), (k * 29 % 1000).cast("double").alias("y"), scale.alias("scale"), F.when(k % 11 == 0, "3D view").otherwise("Elevation").alias("title"))
    sheets = part.select(page).distinct().select("page", F.lit(1000.0).alias("height"), F.lit(8.0).alias("scale"))
    return measure.view_scales(pieces, anchors, sheets, "page", "id").select("id", "area_sf", "view_scale", "scale_risk")


@register(
    "level_scales",
    """
    WITH m AS (SELECT DISTINCT l_orderkey AS p, (l_linenumber * 60 + (l_linenumber >= 5)::INT * (250 + l_orderkey % 2 * 50))::DOUBLE AS y, CASE WHEN l_quantity > 44 THEN l_quantity - 30 ELSE 100 - l_linenumber * 6 - (l_orderkey % 7 = 0 AND l_linenumber >= 5)::INT * l_linenumber * 2 END::DOUBLE AS f FROM lineitem),
         c AS (SELECT *, sum(n) OVER (PARTITION BY p ORDER BY y, f ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT *, (y - lag(y, 1, y) OVER (PARTITION BY p ORDER BY y, f) > 250)::INT AS n FROM m)),
         s AS (SELECT *, row_number() OVER (PARTITION BY p, e ORDER BY s) AS r FROM (SELECT a.p, a.e, (b.f - a.f) / (b.y - a.y) AS s FROM c a JOIN c b ON a.p = b.p AND a.e = b.e AND b.y - a.y >= 8) WHERE s < 0),
         k AS (SELECT p, e, arg_min(s, (-n, s)) AS s, max(n) AS n FROM (SELECT a.p, a.e, a.r, a.s, count(*) AS n FROM s a JOIN s b ON a.p = b.p AND a.e = b.e AND abs(b.s - a.s) <= 0.06 * abs(a.s) GROUP BY ALL) GROUP BY 1, 2 HAVING max(n) >= 2),
         g AS (SELECT k.p, k.e, median(s.s) AS s FROM k JOIN s ON s.p = k.p AND s.e = k.e AND abs(s.s - k.s) <= 0.06 * abs(k.s) GROUP BY 1, 2),
         w AS (SELECT g.p, abs(median(s)) AS f, max(s) - min(s) AS spread, sum(marks) AS marks, count(*) AS n FROM g JOIN (SELECT p, e, count(*) AS marks FROM c GROUP BY 1, 2) USING (p, e) GROUP BY 1)
    SELECT p AS l_orderkey, round(f, 8) AS ft_per_pt, round(1 - least(1, spread / f), 4) AS quality, marks::BIGINT AS marks FROM w WHERE f * 72 BETWEEN 0.5 AND 40 AND (n = 1 OR 1 - least(1, spread / f) >= 0.94)""",
)
def level_scales(spark, sf_dir):
    """Marks every 60 points, two elevations where the gap is over 250, some misread."""
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    y = n * 60 + F.when(n >= 5, 250 + o % 2 * 50).otherwise(0)
    feet = F.when(F.col("l_quantity") > 44, F.col("l_quantity") - 30).otherwise(100 - n * 6 - F.when((o % 7 == 0) & (n >= 5), n * 2).otherwise(0))
    marks = table(spark, sf_dir, "lineitem").select("l_orderkey", y.cast("double").alias("y"), feet.cast("double").alias("feet"))
    return scales.scale_from_levels(marks, "l_orderkey", "y", "feet").withColumn("ft_per_pt", F.round("ft_per_pt", 8))


@register("marked_areas", "SELECT p_partkey AS seq, CASE WHEN p_partkey % 4 = 0 THEN p_partkey * 3 ELSE round((p_size + 4) * (p_partkey % 30 + 2) / 81.0, 1) END::DOUBLE AS area_sf, p_partkey % 4 = 0 AS sf_exact FROM part WHERE p_partkey % 5 <> 1")
def marked_areas(spark, sf_dir):
    """Outlines at nine feet an inch, every fourth with a printed area, every fifth no polygon."""
    k, w, h = F.col("p_partkey"), (F.col("p_size") + 4) * 8.0 / 9, (F.col("p_partkey") % 30 + 2) * 8.0 / 9
    at = lambda x, y: F.struct(F.lit(x).alias("x") if isinstance(x, float) else x.alias("x"), F.lit(y).alias("y") if isinstance(y, float) else y.alias("y"))
    outline = F.array(at(0.0, 0.0), at(w, 0.0), at(w, h), at(0.0, h))
    printed = F.when(k % 4 == 0, F.concat(F.lit("wall "), F.format_number(k * 3, 0), F.lit(" SF"))).otherwise("")
    rows = table(spark, sf_dir, "part").select(k.alias("seq"), F.when(k % 5 == 1, F.when(k % 2 == 0, 7).otherwise(6)).otherwise(6).alias("kind"), F.when(k % 5 == 1, F.slice(outline, 1, 2)).otherwise(outline).alias("vertices"), printed.alias("content"), F.lit("Wall").alias("subject"))
    return documents.marked_polygons(rows, F.lit(9.0)).select("seq", "area_sf", "sf_exact")


@register("gold_outlines", "SELECT page, min_by(seq, (u, seq)) AS seq FROM (SELECT p_partkey // 80 AS page, p_partkey AS seq, (p_partkey % 3 = 0)::INT AS u, p_size AS w, p_partkey % 4 AS h FROM part) GROUP BY page, w, h")
def gold_outlines(spark, sf_dir):
    """Outlines that begin at any corner are one; every third piece has no name."""
    k = F.col("p_partkey")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, w, h = F.lit(0), F.col("p_size") * 8, (k % 4 + 40)
    corners = F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h))
    turn = (k % 3).cast("int")
    rows = table(spark, sf_dir, "part").select(F.lit("j").alias("job_id"), F.expr("p_partkey div 80").alias("page"), k.alias("seq"), F.lit(6).alias("kind"), F.concat(F.slice(corners, turn + 1, 4 - turn), F.slice(corners, 1, turn)).alias("vertices"), F.lit("").alias("content"), F.when(k % 3 == 0, "").otherwise("Brick").alias("subject"))
    return documents.gold_polygons(rows, F.lit(72.0)).select("page", "seq")


@register("manifest_jobs", "SELECT c_custkey, 'file ' || c_nationkey AS file FROM customer WHERE c_nationkey % 2 = 0")
def manifest_jobs(spark, sf_dir):
    """A prefix of 44 characters names a job; one that comes twice counts once."""
    head = F.lpad(F.col("c_nationkey").cast("string"), 44, "0")
    jobs = table(spark, sf_dir, "customer").select("c_custkey", F.concat(head, F.lit("-"), F.col("c_custkey").cast("string")).alias("job_id"))
    nation = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    manifest = nation.select(head.alias("job_prefix"), F.concat(F.lit("file "), F.col("c_nationkey").cast("string")).alias("file"), F.lit(3).alias("pages"))
    again = manifest.withColumns({"job_prefix": F.concat("job_prefix", F.lit("-more")), "file": F.concat("file", F.lit("z"))})
    return tables.pinned(jobs, manifest.unionByName(again)).select("c_custkey", "file")


@register("loose_lengths", "SELECT p_partkey, (p_size + (p_partkey % 12) / 12.0::DOUBLE)::DOUBLE AS feet, (p_size % 9 + (p_partkey % 7) / 12.0::DOUBLE)::DOUBLE AS height FROM part")
def loose_lengths(spark, sf_dir):
    """M2."""
    k, n = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("run of "), n.cast("string"), F.lit("' - "), (k % 12).cast("string"), F.lit("\" or so"))
    subject = F.concat(F.lit("Wall h = "), (n % 9).cast("string"), F.lit("'-"), (k % 7).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", parse.loose_feet(text).alias("feet"), parse.height_of(subject).alias("height"))


@register(
    "scale_votes",
    """
    WITH v AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS id, min(CASE WHEN l_linenumber <= 5 THEN 1 + (l_partkey % 5) / 250.0 WHEN l_linenumber = 6 THEN 2.5 ELSE 4 + l_partkey % 9 END::DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
         r AS (SELECT a.l_suppkey, a.v AS a, b.id, b.v FROM (SELECT DISTINCT l_suppkey, v FROM v) a JOIN v b ON b.l_suppkey = a.l_suppkey AND abs(b.v - a.v) / a.v <= 0.03),
         s AS (SELECT l_suppkey, a, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT l_suppkey, count(*) AS dims FROM v GROUP BY 1),
         b AS (SELECT l_suppkey, arg_min(a, (-n, a)) AS a, max(n) AS n FROM s JOIN t USING (l_suppkey) GROUP BY 1 HAVING max(dims) >= 3 AND max(n) >= 4 AND max(n) >= 0.35 * max(dims)),
         m AS (SELECT r.l_suppkey, r.v, b.n, row_number() OVER (PARTITION BY r.l_suppkey ORDER BY r.v, r.id) AS k FROM r JOIN b ON b.l_suppkey = r.l_suppkey AND b.a = r.a)
    SELECT l_suppkey, v AS ft_per_pt, n AS support FROM m WHERE k = n // 2 + 1""",
)
def scale_votes(spark, sf_dir):
    """One clear scale a supplier, with votes apart from it; no rival comes near it in number."""
    n = F.col("l_linenumber")
    vote = F.when(n <= 5, 1 + (F.col("l_partkey") % 5) / 250).when(n == 6, 2.5).otherwise(4 + F.col("l_partkey") % 9)
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + n).alias("id"), vote.cast("double").alias("ft_per_pt"))
    rows = windows.dealt(rows, ["l_suppkey"]).groupBy("l_suppkey", "id").agg(F.min("ft_per_pt").alias("ft_per_pt"))
    return scales.consensus(rows, ["l_suppkey"])


@register(
    "pattern_signatures",
    """
    WITH p AS (SELECT p_partkey AS id, p_partkey // 80 AS page, p_partkey * 37 % 1000 AS x0, p_partkey * 91 % 1000 AS y0 FROM part),
         l AS (SELECT l_partkey // 80 AS page, l_partkey * 37 % 1000 + l_quantity * 3 + 0.25 AS x, l_partkey * 91 % 1000 + l_linenumber * 20 - 9.75 AS y, l_orderkey % 3 > 0 AS v, CASE WHEN l_orderkey % 11 = 0 THEN 5 ELSE 12 + l_orderkey % 9 END AS n, l_orderkey % 4 AS lean FROM lineitem),
         s AS (SELECT page, x + CASE WHEN v THEN lean ELSE n END / 2.0 AS mx, y + CASE WHEN v THEN n ELSE lean END / 2.0 AS my, v, n, lean, sqrt(n * n + lean * lean) AS len FROM l),
         m AS (SELECT id, v, round_even(CASE WHEN v THEN mx ELSE my END::DOUBLE, 0)::BIGINT AS c FROM s JOIN p ON p.page = s.page AND mx BETWEEN x0 AND x0 + 200 AND my BETWEEN y0 AND y0 + 160 WHERE len >= 8 AND lean < 0.15 * len),
         g AS (SELECT id, v, c - lag(c) OVER (PARTITION BY id, v ORDER BY c) AS gap FROM (SELECT DISTINCT id, v, c FROM m)),
         w AS (SELECT id, v, list_sort(list(gap)) AS w FROM g WHERE gap > 1 GROUP BY 1, 2),
         a AS (SELECT id, v, count(*) AS n, CASE WHEN len(any_value(w)) >= 3 THEN any_value(w)[len(any_value(w)) // 2 + 1] END AS s FROM m LEFT JOIN w USING (id, v) GROUP BY 1, 2),
         b AS (SELECT id, max(n) FILTER (v) AS vn, max(s) FILTER (v) AS vs, max(n) FILTER (NOT v) AS hn, max(s) FILTER (NOT v) AS hs FROM a GROUP BY 1)
    SELECT id, CASE WHEN vs IS NOT NULL AND (hs IS NULL OR vn >= coalesce(hn, 0)) THEN 'v' || round_even(vs / 6.0::DOUBLE, 0)::INT WHEN hs IS NOT NULL THEN 'h' || round_even(hs / 6.0::DOUBLE, 0)::INT ELSE 'plain' END AS signature FROM p LEFT JOIN b USING (id)""",
)
def pattern_signatures(spark, sf_dir):
    """Pieces of 200 by 160 points, each with the lines of its own and of pieces that lie over it."""
    k, page = F.col("p_partkey"), F.expr("p_partkey div 80").alias("page")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = k * 37 % 1000, k * 91 % 1000
    box = F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 200).cast("double").alias("x1"), (y + 160).cast("double").alias("y1"))
    pieces = table(spark, sf_dir, "part").select(k.alias("id"), page, F.array(at(x, y), at(x + 200, y), at(x + 200, y + 160), at(x, y + 160)).alias("points"), box.alias("box"))
    lk, o = F.col("l_partkey"), F.col("l_orderkey")
    lx, ly = lk * 37 % 1000 + F.col("l_quantity") * 3 + 0.25, lk * 91 % 1000 + F.col("l_linenumber") * 20 - 9.75
    n, lean, v = F.when(o % 11 == 0, 5).otherwise(12 + o % 9), o % 4, o % 3 > 0
    segments = table(spark, sf_dir, "lineitem").select(F.expr("l_partkey div 80").alias("page"), lx.alias("x0"), ly.alias("y0"), (lx + F.when(v, lean).otherwise(n)).alias("x1"), (ly + F.when(v, n).otherwise(lean)).alias("y1"))
    return graph.signatures(pieces, segments, ["page"], "id").select("id", "signature")


_SNAP = """
    WITH v AS (SELECT p_partkey AS id, p_partkey // 80 AS page, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y FROM part), c AS (SELECT DISTINCT p_partkey // 80 AS page, p_partkey * 53 % 1000 AS cx, p_partkey * 29 % 1000 AS cy FROM part WHERE p_partkey % 2 = 0),
         u AS (SELECT DISTINCT p_partkey // 80 AS page, p_partkey * 71 % 1000 AS c FROM part WHERE p_partkey % 6 = 1), h AS (SELECT DISTINCT p_partkey // 80 AS page, p_partkey * 43 % 1000 AS c FROM part WHERE p_partkey % 6 = 5),
         n AS (SELECT v.page, id, arg_min((cx, cy), ((x - cx) * (x - cx) + (y - cy) * (y - cy), cx, cy)) AS t FROM v JOIN c ON c.page = v.page AND (x - cx) * (x - cx) + (y - cy) * (y - cy) < 900 GROUP BY 1, 2),
         a AS (SELECT v.page, id, arg_min(c, (abs(x - c), c)) AS t FROM v JOIN u ON u.page = v.page AND abs(x - c) < 30 GROUP BY 1, 2), b AS (SELECT v.page, id, arg_min(c, (abs(y - c), c)) AS t FROM v JOIN h ON h.page = v.page AND abs(y - c) < 30 GROUP BY 1, 2)
    SELECT v.page, v.id, CASE WHEN n.t IS NOT NULL THEN n.t[1] ELSE coalesce(a.t, x) END::DOUBLE AS x, CASE WHEN n.t IS NOT NULL THEN n.t[2] ELSE coalesce(b.t, y) END::DOUBLE AS y,
           CASE WHEN n.t IS NOT NULL THEN 'corner' WHEN a.t IS NOT NULL OR b.t IS NOT NULL THEN 'line' ELSE 'none' END AS snapped
    FROM v LEFT JOIN n ON n.page = v.page AND n.id = v.id LEFT JOIN a ON a.page = v.page AND a.id = v.id LEFT JOIN b ON b.page = v.page AND b.id = v.id"""


@register("snapped_vertices", _SNAP)
def snapped_vertices(spark, sf_dir):
    """J30."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part").withColumn("page", F.expr("p_partkey div 80"))
    at = lambda m: (k * m % 1000).cast("double")
    corners = part.filter(k % 2 == 0).select("page", at(53).alias("x"), at(29).alias("y")).distinct()
    lines = part.filter(k % 6 == 1).select("page", F.lit("v").alias("axis"), at(71).alias("c")).unionByName(part.filter(k % 6 == 5).select("page", F.lit("h").alias("axis"), at(43).alias("c")))
    return spatial.snapped_vertices(part.select(k.alias("id"), "page", at(37).alias("x"), at(91).alias("y")), corners, lines, ["page"], "id", 30.0)


@register("tagged_regions", f"WITH b AS ({BRAND_SQL}), p AS (SELECT p_partkey AS tag, p_brand AS page, p_partkey * 53 % 1000 AS x, p_partkey * 29 % 1000 AS y FROM part), d AS (SELECT p.page, tag, id, sqrt(pow(greatest(x0 - x, x - x1, 0), 2) + pow(greatest(y0 - y, y - y1, 0), 2)) AS d FROM p JOIN b USING (page)) SELECT page, tag, arg_min(id, (round(d, 6), id)) AS id, round(min(d), 6) AS distance FROM d WHERE d <= 60 GROUP BY 1, 2")
def tagged_regions(spark, sf_dir):
    """Rectangles, so that the distance has a closed form."""
    k = F.col("p_partkey")
    pt = lambda x, y: F.struct(F.col(f"box.{x}").alias("x"), F.col(f"box.{y}").alias("y"))
    faces = boxes(spark, sf_dir, "p_brand").select("page", "id", "box", F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1")).alias("points"))
    tags = table(spark, sf_dir, "part").select(k.alias("tag"), F.col("p_brand").alias("page"), (k * 53 % 1000).cast("double").alias("x"), (k * 29 % 1000).cast("double").alias("y"))
    return spatial.nearest_region(tags, faces, ["page"], 60.0, "tag", "id").withColumn("distance", F.round("distance", 6))
