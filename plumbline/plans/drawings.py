"""Drawing colours, vectors, read texts and what users decide, over part, lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import colours, openings, overrides, reconcile, review, rollup, vectors
from .names import _T, ANSWERS, name_column, sql_text
from .registry import register, table
from .shapes import BOX_SQL, BRAND_SQL, boxes

_CANON = ", ".join(f"({sql_text(a[0])}, {sql_text(a[1])}, {sql_text(a[2])})" for a in ANSWERS)


@register(
    "color_groups",
    f"""
    WITH a(name, g, cls) AS (VALUES {_CANON}), p AS ({_T} SELECT t.p_partkey, p_brand, g, cls, t.p_partkey % 11 = 0 OR t.p_partkey % 13 = 0 AS none,
           '(' || (t.p_partkey % 7) / 6.0::DOUBLE || ', ' || (p_size % 4) / 6.0::DOUBLE || ', 1.0)' AS q FROM t JOIN part USING (p_partkey) JOIN a USING (name)),
         m AS (SELECT p_brand, q, arg_min(g, p_partkey) AS g, arg_min(cls, p_partkey) AS cls FROM p WHERE cls IN ('real', 'code') AND NOT none GROUP BY 1, 2)
    SELECT p_partkey, CASE WHEN p.g = 'Color fill' AND NOT none THEN coalesce(m.g, 'Color: ' || q) ELSE p.g END AS material_group,
           CASE WHEN p.g = 'Color fill' AND NOT none THEN coalesce(m.cls, 'code') ELSE p.cls END AS material_class FROM p LEFT JOIN m USING (p_brand, q)""",
)
def color_groups(spark, sf_dir):
    """Colours within a hundredth of sixths; every eleventh is a reader's, every thirteenth missing."""
    k = F.col("p_partkey")
    colour = F.array((k % 7) / 6 + 0.01, (F.col("p_size") % 4) / 6 - 0.01, F.lit(1.0))
    colour = F.when(k % 11 == 0, F.array(F.lit(0.35), F.lit(0.551), F.lit(0.849))).when(k % 13 == 0, F.array().cast("array<double>")).otherwise(colour)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", name_column().alias("name"), colour.alias("fill"))
    return colours.with_groups(rows, ["p_brand"], F.col("name"), "fill", ["p_partkey"]).select("p_partkey", "material_group", "material_class")


@register(
    "code_names",
    """
    WITH p AS (SELECT p_partkey, p_brand, 'FC-' || (p_size % 30) AS a, 'MP' || (p_partkey % 40) AS b, p_partkey % 9 = 0 AS off FROM part),
         m AS (SELECT p_brand, 'FC-' || (p_size % 30) AS code, min('Plank ' || p_size) AS name FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2 UNION ALL SELECT p_brand, 'MP' || (p_partkey % 40), min('Metal ' || p_size) FROM part WHERE p_partkey % 5 = 0 GROUP BY 1, 2)
    SELECT p_partkey, CASE WHEN off THEN 'wall ' || a || ' over ' || b WHEN x.name IS NOT NULL THEN x.name || ' (' || a || ')' WHEN y.name IS NOT NULL THEN y.name || ' (' || b || ')' ELSE 'wall ' || a || ' over ' || b END AS material,
           CASE WHEN off THEN NULL WHEN x.name IS NOT NULL THEN 'codemap:' || a WHEN y.name IS NOT NULL THEN 'codemap:' || b END AS named_by
    FROM p LEFT JOIN m x ON x.p_brand = p.p_brand AND x.code = a LEFT JOIN m y ON y.p_brand = p.p_brand AND y.code = b""",
)
def code_names(spark, sf_dir):
    """The first code of a text that the brand's map knows; suggestions stay as they are."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    fc, mp = F.concat(F.lit("FC-"), (F.col("p_size") % 30).cast("string")), F.concat(F.lit("MP"), (k % 40).cast("string"))
    rows = part.select("p_partkey", "p_brand", F.concat(F.lit("wall "), fc, F.lit(" over "), mp).alias("material"), F.lit(None).cast("string").alias("named_by"), (k % 9 == 0).alias("suggest_only"))
    size = F.col("p_size").cast("string")
    book = part.filter(k % 3 == 0).select("p_brand", fc.alias("code"), F.concat(F.lit("Plank "), size).alias("name")).unionByName(part.filter(k % 5 == 0).select("p_brand", mp.alias("code"), F.concat(F.lit("Metal "), size).alias("name")))
    return colours.with_codes(rows, book, ["p_brand"], "p_partkey", "material").select("p_partkey", "material", "named_by")


@register("markup_jobs", "SELECT l_orderkey, bool_or((l_linenumber % 3 = 1 AND l_partkey % 5 >= 3) OR (l_linenumber % 3 = 2 AND l_returnflag = 'R')) AS has_markup FROM lineitem GROUP BY 1")
def markup_jobs(spark, sf_dir):
    """F13."""
    corner = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("run "), F.col("l_quantity").cast("int").cast("string"), F.lit("' - 6\""))).otherwise("see note 4")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3 + 5).alias("kind"), F.array_repeat(corner, (F.col("l_partkey") % 5).cast("int")).alias("vertices"), text.alias("content"))
    return vectors.markup_jobs(rows, "l_orderkey")


@register("vector_pages", f"SELECT p_type, count(*) FILTER ((x1 - x0) * (y1 - y0) > 1000) > 5 AS vector_page FROM ({BOX_SQL}) JOIN part ON p_partkey = id GROUP BY 1")
def vector_pages(spark, sf_dir):
    """a page for each type."""
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type")
    return vectors.vector_pages(boxes(spark, sf_dir).select("id", "box.*").join(types, "id"), ["p_type"])


@register("not_sprawling", "SELECT p_partkey AS id FROM part WHERE NOT (p_size + 5 > 44 AND p_partkey % 60 + 5 > 33)")
def not_sprawling(spark, sf_dir):
    """on a page of 80 by 60."""
    pt = lambda x, y: F.struct(F.col(f"box.{x}").alias("x"), F.col(f"box.{y}").alias("y"))
    rows = boxes(spark, sf_dir).select("id", F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1")).alias("points"))
    return vectors.not_sprawling(rows, "points", F.lit(80.0), F.lit(60.0)).select("id")


# Texts of blocks and whether they are callouts, worked out by hand.
BLOCKS = [
    ("FIBER  CEMENT LAP SIDING", True), ("BRICK VENEER", True), ("METAL PANEL - SEE DETAIL 4", False), ("ALUM. WINDOW", False), ("STANDING SEAM", True), ("SCALE: 1/8", False), ("ROOF", False), ("METL-SPAN CF36", True),
    ("EXISTING BRICK TO REMAIN", True), ("BRICK EXISTING TO REMAIN", False), ("LAP", True), ("a wall system of very many words that goes on and on and on and never says what in the end it might be about", False), ("TRIM, TYP.", True), ("COMPOSITE DECK", True), ("PANELS", False),
]


@register("callout_blocks", "SELECT p_partkey FROM part WHERE CAST(p_partkey % 15 AS INTEGER) IN (" + ", ".join(str(k) for k, (_, yes) in enumerate(BLOCKS) if yes) + ")")
def callout_blocks(spark, sf_dir):
    """F19; a page holds 120 parts whatever the table's size, 64 callouts of them, fewer than the limit."""
    text = F.get(F.array(*[F.lit(t) for t, _ in BLOCKS]), (F.col("p_partkey") % len(BLOCKS)).cast("int"))
    return vectors.callout_blocks(table(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey div 120").alias("page"), text.alias("text")), ["page"], "text", "p_partkey").select("p_partkey")


@register("light_fill", "SELECT p_partkey, r BETWEEN 0.8 AND 0.97 AND abs(r - g) < 0.04 AND a >= 0.0012 * 500000 AS light FROM (SELECT p_partkey, 0.75::DOUBLE + (p_partkey % 20) / 64.0::DOUBLE AS r, 0.75::DOUBLE + (p_partkey % 20) / 64.0::DOUBLE + (p_size % 5) / 64.0::DOUBLE AS g, (p_size + 5) * (p_partkey % 60 + 5) AS a FROM part)")
def light_fill(spark, sf_dir):
    """F21."""
    r = F.lit(0.75) + (F.col("p_partkey") % 20) / 64
    g = r + (F.col("p_size") % 5) / 64
    area = (F.col("p_size") + 5) * (F.col("p_partkey") % 60 + 5)
    return table(spark, sf_dir, "part").select("p_partkey", vectors.light_fill(F.array(r, g, g), area, F.lit(500000.0)).alias("light"))


@register("clip_regions", "SELECT p_partkey AS id, round(w * h * 0.0625::DOUBLE, 1) AS area_sf FROM (SELECT p_partkey, (p_size + 5) * 4 AS w, (p_partkey % 60 + 5) * 4 AS h FROM part) WHERE w >= 40 AND h >= 40 AND w * h <= 0.55 * 60000 AND w * h * 0.0625 >= 40")
def clip_regions(spark, sf_dir):
    """F22."""
    rows = boxes(spark, sf_dir).select("id", *[(F.col(f"box.{c}") * 4).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return vectors.clip_regions(rows, F.lit(60000.0), F.lit(0.25)).select("id", "area_sf")


_ENDS = "greatest(u0 - {x}, {x} - u0 - 10, 0) <= 20 AND greatest(v0 - {y}, {y} - v0 - 6, 0) <= 20"


@register("leaders", f"WITH s AS (SELECT * FROM ({BRAND_SQL}) WHERE (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) BETWEEN 625 AND 360000), b AS (SELECT p_brand AS page, p_partkey * 53 % 1000 AS u0, p_partkey * 29 % 1000 AS v0 FROM part WHERE p_partkey % 4 = 0) SELECT DISTINCT s.page, id FROM s JOIN b ON b.page = s.page AND (({_ENDS.format(x='x0', y='y0')}) OR ({_ENDS.format(x='x1', y='y1')}))")
def leaders(spark, sf_dir):
    """the diagonals of boxes near every fourth part's label."""
    k = F.col("p_partkey")
    d = lambda v: v.cast("double")
    segments = boxes(spark, sf_dir, "p_brand").select("page", "id", F.col("box.x0").alias("x1"), F.col("box.y0").alias("y1"), F.col("box.x1").alias("x2"), F.col("box.y1").alias("y2"))
    label = F.struct(d(k * 53 % 1000).alias("x0"), d(k * 29 % 1000).alias("y0"), d(k * 53 % 1000 + 10).alias("x1"), d(k * 29 % 1000 + 6).alias("y1"))
    blocks = table(spark, sf_dir, "part").filter(k % 4 == 0).select(F.col("p_brand").alias("page"), label.alias("box"))
    return vectors.leaders(segments, blocks, ["page"], "id", "box", most=None).select("page", "id")


_LINES = "SELECT p_partkey AS id, p_partkey // 80 AS page, p_partkey % 2 = 0 AS level, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y, p_size * 4 AS l, (p_partkey % 5) / 2.0::DOUBLE AS s FROM part"


def _segments(spark, sf_dir, page="p_partkey div 80"):
    """Level lines for even parts and upright ones for odd, some askew, some short."""
    k = F.col("p_partkey")
    x, y, length, skew = (k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double"), F.col("p_size") * 4.0, (k % 5) / 2
    level = k % 2 == 0
    return table(spark, sf_dir, "part").select(k.alias("id"), F.expr(page).alias("page"), x.alias("x1"), y.alias("y1"), F.when(level, x - length).otherwise(x + skew).alias("x2"), F.when(level, y + skew).otherwise(y + length).alias("y2"))


_STRAIGHT = f"SELECT id, page, CASE WHEN level THEN 'h' ELSE 'v' END AS axis, CASE WHEN level THEN x - l ELSE y END::DOUBLE AS a0, CASE WHEN level THEN x ELSE y + l END::DOUBLE AS a1, (CASE WHEN level THEN y ELSE x END + s / 2)::DOUBLE AS c, l::DOUBLE AS length FROM ({_LINES}) WHERE l >= 18 AND s <= 1.5"


@register("straight_lines", f"SELECT id, axis, a0, a1, c, length FROM ({_STRAIGHT})")
def straight_lines(spark, sf_dir):
    """G34."""
    return vectors.straight(_segments(spark, sf_dir)).select("id", "axis", "a0", "a1", "c", "length")


@register("line_corners", f"WITH s AS ({_STRAIGHT.replace('p_partkey // 80 AS page', 'p_brand AS page')}) SELECT h.page, h.id AS h, v.id AS v, v.c AS x, h.c AS y FROM s h JOIN s v ON h.page = v.page AND h.axis = 'h' AND v.axis = 'v' AND v.c BETWEEN h.a0 - 2 AND h.a1 + 2 AND h.c BETWEEN v.a0 - 2 AND v.a1 + 2")
def line_corners(spark, sf_dir):
    """J22."""
    return vectors.crossings(vectors.straight(_segments(spark, sf_dir, "p_brand")), ["page"], "id", most=None)


@register(
    "level_marks",
    """
    WITH r AS (SELECT p_partkey AS seq, p_partkey // 80 AS page, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y, p_partkey % 4 AS k, p_size AS n FROM part WHERE p_partkey % 10 >= 4),
         v AS (SELECT * FROM r WHERE k < 2),
         f AS (SELECT v.page, v.seq, arg_min(CASE WHEN q.k = 1 THEN 'T.O. STEEL ' || q.n || '''-0"' ELSE 'ROOF' END, q.seq) AS label FROM v JOIN r q ON q.page = v.page AND q.seq <> v.seq AND q.k IN (1, 2) AND abs(q.y - v.y) < 30 AND abs(q.x - v.x) < 160 GROUP BY 1, 2),
         t AS (SELECT v.page, v.seq, v.y::DOUBLE AS y, CASE WHEN k = 0 THEN n + 0.5 ELSE n END::DOUBLE AS ft, CASE WHEN k = 1 THEN 'T.O. STEEL ' || n || '''-0"' ELSE f.label END AS label FROM v LEFT JOIN f ON f.page = v.page AND f.seq = v.seq)
    SELECT page, seq, y, ft, label FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY seq) AS r FROM t WHERE label IS NOT NULL) WHERE r <= 40""",
)
def level_marks(spark, sf_dir):
    """Heights, labels with heights, labels alone and notes, some read with doubt."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(n, F.lit("'-6\""))).when(k % 4 == 1, F.concat(F.lit("T.O. STEEL "), n, F.lit("'-0\""))).when(k % 4 == 2, "ROOF").otherwise("note")
    rows = table(spark, sf_dir, "part").select(k.alias("seq"), F.expr("p_partkey div 80").alias("page"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 1000).cast("double").alias("y"), text.alias("text"), F.when(k % 10 >= 4, 0.9).otherwise(0.5).alias("conf"))
    return vectors.level_marks(rows, ["page"], "seq")


_EVENT = "SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events"


@register("accepted_pieces", f"WITH l AS (SELECT user_id, event_id % 3 <> 0 AS on_ FROM ({_EVENT}) WHERE r = 1) SELECT c_custkey AS piece, coalesce(on_, false) AND c_nationkey % 2 = 0 AS accepted, CASE WHEN coalesce(on_, false) AND c_nationkey % 2 = 0 THEN 'AI wall (accepted)' ELSE c_mktsegment END AS material, CASE WHEN coalesce(on_, false) AND c_nationkey % 2 = 0 THEN c_mktsegment END AS before_accept FROM customer LEFT JOIN l ON user_id = c_custkey")
def accepted_pieces(spark, sf_dir):
    """Customers as pieces, half of them suggestions; every third event undoes."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("piece"), F.col("c_mktsegment").alias("material"), (F.col("c_nationkey") % 2 == 0).alias("was"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("piece"), (F.col("event_id") % 3 == 0).alias("undo"), "ts", "event_id")
    out = overrides.with_accepted(c.withColumn("suggest_only", F.col("was")), e, ["piece"], ["ts", "event_id"])
    return out.select("piece", (F.col("was") & ~F.col("suggest_only")).alias("accepted"), "material", "before_accept")


@register("confirmations", "SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 4 <> 0")
def confirmations(spark, sf_dir):
    """R8."""
    e = table(spark, sf_dir, "events").withColumn("confirmed", F.when(F.col("event_id") % 4 == 0, False).when(F.col("event_id") % 4 == 1, True))
    return overrides.confirmations(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@register("restored_zones", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) - 1 AS INTEGER) AS position FROM lineitem")
def restored_zones(spark, sf_dir):
    """Every third zone is parked and comes back; the list is as it was."""
    z = overrides.parked(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber")])
    out = F.col("l_linenumber") % 3 == 0
    return overrides.restored(z.filter(~out), z.filter(out), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "position")


@register("global_total", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sf, count(*) AS zones FROM lineitem")
def global_total(spark, sf_dir):
    """A8."""
    return rollup.global_total(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@register("family_order", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_quantity DESC, l_linenumber) AS INTEGER) AS place FROM lineitem")
def family_order(spark, sf_dir):
    """T4."""
    rows = table(spark, sf_dir, "lineitem").withColumn("material", F.when(F.col("l_returnflag") == "R", "Panel wall (drawn fill)").otherwise("Wall area"))
    return rollup.family_first(rows, ["l_orderkey"], "material", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "place")


@register(
    "page_compare",
    """
    SELECT l_orderkey, round(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 1)::DOUBLE AS his_total, round(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 1)::DOUBLE AS our_total, count(*) FILTER (l_discount >= 0.03) AS found,
           count(*) FILTER (l_discount >= 0.07) AS money_right FROM lineitem GROUP BY 1""",
)
def page_compare(spark, sf_dir):
    """What is measured equals what is marked; tenfold discounts stand for the cover."""
    rows = table(spark, sf_dir, "lineitem").withColumn("cover", F.bround(F.col("l_discount") * 10, 2))
    return review.page_compare(rows.withColumn("got", F.col("l_extendedprice")), ["l_orderkey"], "l_extendedprice", "got", "cover")


@register("sheet_pages", "SELECT l_returnflag AS kind, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS pages FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber = 1) m JOIN (SELECT l_partkey, l_suppkey FROM lineitem) USING (l_partkey) GROUP BY 1")
def sheet_pages(spark, sf_dir):
    """Parts as sheets, suppliers as pages."""
    rows = table(spark, sf_dir, "lineitem")
    out = reconcile.sheet_pages(rows.filter("l_linenumber = 1").select("l_partkey", F.col("l_returnflag").alias("kind")), rows, "l_partkey", "kind", "l_suppkey")
    return out.select("kind", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@register("fill_regions", f"WITH b AS (SELECT id, (x1 - x0) * (y1 - y0) AS a, id % 3 AS k FROM ({BOX_SQL})) SELECT id, a::DOUBLE AS area_pt2, 4 AS corners FROM b WHERE a >= 0.0012 * 500000 AND id % 4 <> 0")
def fill_regions(spark, sf_dir):
    """Outlines with a point beside a corner, outlines that run back on themselves, and every fourth too dark."""
    b, k = boxes(spark, sf_dir), F.col("id")
    at = lambda x, y, d=0.0: F.struct((F.col(f"box.{x}") + d).alias("x"), F.col(f"box.{y}").alias("y"))
    plain = [at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")]
    points = F.when(k % 3 == 0, F.array(*plain)).when(k % 3 == 1, F.array(plain[0], at("x0", "y0", 0.25), *plain[1:])).otherwise(F.array(plain[0], plain[2], at("x1", "y1", -1.0), plain[0]))
    fill = F.when(k % 4 == 0, F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.lit(0.9), F.lit(0.91), F.lit(0.9)))
    out = openings.fill_regions(b.select("id", "box", fill.alias("fill"), points.alias("points")), "fill", "box", "points", F.lit(500000.0))
    return out.select("id", "area_pt2", F.size("points").alias("corners"))


@register("gap_openings", "SELECT p_partkey AS page, 0 AS position, 100::DOUBLE AS x0, 102::DOUBLE AS y0, 180::DOUBLE AS x1, (106 + 8 * (p_size % 20))::DOUBLE AS y1 FROM part WHERE p_size % 20 >= 4 AND p_partkey % 3 <> 0 AND p_partkey % 7 <> 0")
def gap_openings(spark, sf_dir):
    """A wall for each part with courses every 8 points that stop at a door of as many rows as its size tells; every third lacks a jamb,
    the door of every seventh is known."""
    d = lambda c: c.cast("double").alias
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), (F.col("p_size") % 20).alias("m"))
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(600.0).alias("y1"))
    pieces = part.select("page", F.lit(1).alias("id"), F.array(at(0, 0), at(600, 0), at(600, 600), at(0, 600)).alias("points"), box.alias("box"))
    rows = part.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(74))))
    door = F.col("k").between(13, F.col("m") + 13)
    ends = F.when(door, F.array(F.struct(F.lit(2.0).alias("lo"), F.lit(100.0).alias("hi")), F.struct(F.lit(180.0).alias("lo"), F.lit(598.0).alias("hi")))).otherwise(F.array(F.struct(F.lit(2.0).alias("lo"), F.lit(598.0).alias("hi"))))
    courses = rows.withColumn("e", F.explode(ends)).select("page", F.col("k").alias("seq"), F.lit("h").alias("axis"), d(F.col("k") * 8)("c"), "e.lo", "e.hi")
    jamb = part.withColumn("c", F.explode(F.when(F.col("page") % 3 == 0, F.array(F.lit(101.0))).otherwise(F.array(F.lit(101.0), F.lit(179.0))))).select("page", F.lit(100).alias("seq"), F.lit("v").alias("axis"), "c", F.lit(96.0).alias("lo"), F.lit(280.0).alias("hi"))
    known = part.filter("page % 7 = 0").select("page", F.lit(1).alias("id"), F.lit(100.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(180.0).alias("x1"), F.lit(280.0).alias("y1"))
    return openings.gap_openings(pieces, courses.unionByName(jamb), known, ["page"], 0.1).drop("id")


@register("framed_openings", "SELECT p_partkey AS page, 0 AS position, 100::DOUBLE AS x0, 100::DOUBLE AS y0, (112 + p_size)::DOUBLE AS x1, 150::DOUBLE AS y1 FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def framed_openings(spark, sf_dir):
    """A wall for each part with a window: every second has a nested frame, every third two mullions and others one."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_size").cast("double").alias("n"))
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    box = lambda *v: F.struct(*[(F.lit(float(c)) if isinstance(c, int) else c).alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    walls = part.select("page", F.lit(1).alias("id"), F.array(at(0, 0), at(600, 0), at(600, 600), at(0, 600)).alias("points"), box(0, 0, 600, 600).alias("box"))
    window = part.select("page", F.lit(1).alias("id"), box(100, 100, 112 + F.col("n"), 150).alias("box"))
    frame = part.filter("page % 2 = 0").select("page", F.lit(2).alias("id"), box(100, 100, 112 + F.col("n"), 149).alias("box"))
    line = lambda x: part.select("page", F.lit(x).alias("x1"), F.lit(105.0).alias("y1"), F.lit(x).alias("x2"), F.lit(145.0).alias("y2"))
    return openings.framed_openings(walls, window.unionByName(frame), line(105.0).unionByName(line(107.0).filter("page % 3 = 0")), ["page"], 0.1).drop("wall")
