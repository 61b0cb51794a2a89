"""Rollups, review and reconciliation over lineitem, orders and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.naming import scope_family
from ..operators import export, reconcile, review, rollup, windows
from .registry import register, table

BOOKED = "l_returnflag <> 'R'"
M = "CAST({} AS DECIMAL(18,2))"
EXT = M.format("l_extendedprice")


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def booked(spark, sf_dir):
    """returned lines stand for suggestions."""
    return rollup.booked(lines(spark, sf_dir).withColumn("suggest_only", F.col("l_returnflag") == "R").withColumn("out_of_scope", F.lit(None).cast("boolean")))


def _scope_sql(group: str, page: str) -> str:
    return f"""
    SELECT {group} AS group_key, CAST(sum({EXT}) AS DOUBLE) AS total_sf,
           CAST(sum(CASE WHEN l_linestatus = 'F' THEN {EXT} ELSE 0 END) AS DOUBLE) AS in_sf,
           CAST(sum(CASE WHEN l_linestatus <> 'F' THEN {EXT} ELSE 0 END) AS DOUBLE) AS parked_sf,
           CAST(count(*) AS BIGINT) AS zones, CAST(count(DISTINCT {page}) AS BIGINT) AS pages, bool_or(l_linestatus <> 'F') AS any_parked
    FROM lineitem WHERE {BOOKED} GROUP BY 1"""


@register("scope_summary", _scope_sql("l_suppkey", "l_partkey"))
def scope_summary(spark, sf_dir):
    return rollup.scope_summary(booked(spark, sf_dir), "l_suppkey", "l_partkey", F.col("l_extendedprice"), F.col("l_linestatus") == "F").orderBy(F.desc("total_sf"), "group_key")


@register("page_scope_summary", _scope_sql("l_partkey", "l_suppkey"))
def page_scope_summary(spark, sf_dir):
    return rollup.scope_summary(booked(spark, sf_dir), "l_partkey", "l_suppkey", F.col("l_extendedprice"), F.col("l_linestatus") == "F")


@register(
    "zone_rollup",
    f"""
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_linestatus DESC) AS r FROM lineitem WHERE {BOOKED})
    SELECT l_suppkey, CAST(sum({EXT}) AS DOUBLE) AS net_area, CAST(count(*) AS BIGINT) AS pieces, max(CASE WHEN r = 1 THEN l_linestatus END) AS category,
           CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'multi' ELSE min(l_returnflag) END AS reader_class
    FROM b GROUP BY l_suppkey""",
)
def zone_rollup(spark, sf_dir):
    rows = booked(spark, sf_dir).withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_linestatus"))
    out = rollup.zone_rollup(rows, ["l_suppkey"], "l_extendedprice", "l_linestatus", "l_returnflag", "o")
    return out.withColumn("reader_class", rollup.combined_class(F.col("readers"))).drop("readers")


@register(
    "dominant_name",
    f"""
    WITH n AS (SELECT l_suppkey, p_brand, sum({EXT}) AS s, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, p_brand) AS k FROM n)
    SELECT l_suppkey, CAST(sum(s) AS DOUBLE) AS net_area, CAST(sum(c) AS BIGINT) AS pieces, max(CASE WHEN k = 1 THEN p_brand END) AS dominant_name FROM r GROUP BY 1""",
)
def dominant_name(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_suppkey", "l_partkey", "l_extendedprice").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rollup.dominant_name(rows, ["l_suppkey"], "p_brand", "l_extendedprice")


@register(
    "materials_summary",
    f"""
    SELECT l_partkey, CAST(sum({EXT}) AS DOUBLE) AS total_sf, CAST(sum(CASE WHEN l_linestatus = 'F' THEN {EXT} ELSE 0 END) AS DOUBLE) AS named_sf,
           CAST(sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE {EXT} END) AS DOUBLE) AS unnamed_sf, CAST(count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS BIGINT) AS named_zones
    FROM lineitem GROUP BY 1""",
)
def materials_summary(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("given", F.when(F.col("l_linestatus") == "F", "named").otherwise(""))
    return rollup.materials_summary(rows, "l_partkey", "l_extendedprice", "given")


@register("linear_rollup", f"SELECT p_brand, CAST(sum({M.format('l_quantity')}) AS DOUBLE) AS lf FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def linear_rollup(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_partkey", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rollup.linear_rollup(rows, "p_brand", "l_quantity")


@register("having_min_cluster", f"SELECT l_suppkey, CAST(sum({EXT}) AS DOUBLE) AS sf FROM lineitem GROUP BY 1 HAVING sum({EXT}) >= 20000000 OR count(*) < 0 OR sum({EXT}) > (SELECT avg(s) FROM (SELECT CAST(sum({EXT}) AS DOUBLE) AS s FROM lineitem GROUP BY l_suppkey))")
def having_min_cluster(spark, sf_dir):
    """Suppliers above 20 million, or above the mean."""
    sums = lines(spark, sf_dir).groupBy("l_suppkey").agg(rollup.total("l_extendedprice").alias("sf"))
    mean = sums.agg(F.avg("sf").alias("m"))
    return sums.join(F.broadcast(mean), F.lit(True)).filter((F.col("sf") >= 20000000) | (F.col("sf") > F.col("m"))).drop("m")


@register(
    "topk_clusters",
    """
    WITH g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8)
    SELECT p_brand, p_partkey, p_retailprice, rank FROM (
      SELECT p_brand, p_partkey, p_retailprice, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part JOIN g USING (p_brand)) WHERE rank <= 30""",
)
def topk_clusters(spark, sf_dir):
    """The eight largest clusters, thirty members of each (limits are the operator's own)."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    top = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(8).select("p_brand")
    return rollup.top_per_group(part.join(F.broadcast(top), "p_brand"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 30)


@register("largest_per_key", "SELECT p_brand, max(p_retailprice) AS p_retailprice, max(CASE WHEN r = 1 THEN p_type END) AS p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_type DESC) AS r FROM part) GROUP BY 1")
def largest_per_key(spark, sf_dir):
    return rollup.largest_per_key(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_type")


@register("takeoff_csv_total", f"WITH g AS (SELECT l_returnflag AS material, CAST(sum({EXT}) AS DOUBLE) AS net, CAST(sum({M.format('l_quantity')}) AS DOUBLE) AS qty FROM lineitem GROUP BY 1) SELECT * FROM g UNION ALL SELECT 'TOTAL', CAST(sum({EXT}) AS DOUBLE), CAST(sum({M.format('l_quantity')}) AS DOUBLE) FROM lineitem")
def takeoff_csv_total(spark, sf_dir):
    g = lines(spark, sf_dir).groupBy(F.col("l_returnflag").alias("material")).agg(rollup.total("l_extendedprice").alias("net"), rollup.total("l_quantity").alias("qty"))
    return rollup.with_total(g, "material", ["net", "qty"])


@register("net_assist", f"SELECT l_orderkey, CAST(round(sum({EXT}), 1) + round(sum({M.format('l_quantity')}), 1) AS DOUBLE) AS gross, CAST(round(sum({M.format('l_quantity')}), 1) AS DOUBLE) AS openings, CAST(round(sum({EXT}), 1) AS DOUBLE) AS net FROM lineitem GROUP BY 1")
def net_assist(spark, sf_dir):
    """Gross - openings = net."""
    g = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sum(rollup.money("l_extendedprice")).alias("b"), F.sum(rollup.money("l_quantity")).alias("o"))
    gross, openings, net = rollup.net_assist(F.col("b"), F.col("o"))
    return g.select("l_orderkey", gross.alias("gross"), openings.alias("openings"), net.alias("net"))


@register("adjusted_legend", f"SELECT l_suppkey, l_returnflag, CAST(sum({EXT}) AS DOUBLE) AS net_sf, CAST(round(sum({EXT}) * 115 / 100, 1) AS DOUBLE) AS adjusted_sf FROM lineitem GROUP BY 1, 2")
def adjusted_legend(spark, sf_dir):
    return export.adjusted_legend(lines(spark, sf_dir), "l_suppkey", "l_returnflag", "l_extendedprice")


@register(
    "bid_lines",
    """
    WITH s AS (SELECT l_partkey AS material, l_suppkey AS page, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sf FROM lineitem GROUP BY 1, 2)
    SELECT material, CAST(sum(CAST(sf AS BIGINT)) AS BIGINT) AS qty, '=' || string_agg(CAST(CAST(sf AS BIGINT) AS VARCHAR), '+' ORDER BY page) AS formula,
           CAST(CAST(sum(CAST(sf AS BIGINT)) * 2 * CAST(max(p_retailprice) AS DECIMAL(12,4)) AS DECIMAL(18,2)) AS DOUBLE) AS amount
    FROM s JOIN part ON material = p_partkey WHERE sf > 0 GROUP BY 1""",
)
def bid_lines(spark, sf_dir):
    pages = lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("material"), F.col("l_suppkey").alias("page")).agg(rollup.total("l_quantity").alias("sf"))
    rates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("material"), F.col("p_retailprice").alias("rate"), F.lit(2).alias("conv"))
    return export.bid_lines(pages, "material", "sf", rates).select("material", "qty", "formula", "amount")


@register("without_materials", "SELECT p_partkey, p_name FROM part WHERE NOT contains(lower(p_name), 'red') AND NOT contains(lower(p_name), 'steel')")
def without_materials(spark, sf_dir):
    return rollup.without_materials(table(spark, sf_dir, "part"), "p_name", ["Red", "Steel"]).select("p_partkey", "p_name")


@register("chosen_materials", "WITH h AS (SELECT bool_or(contains(lower(p_name || ' ' || p_type), 'brass')) AS some_hit FROM part) SELECT p_partkey FROM part, h WHERE NOT some_hit OR contains(lower(p_name || ' ' || p_type), 'brass')")
def chosen_materials(spark, sf_dir):
    return export.chosen_materials(table(spark, sf_dir, "part"), "p_name", "p_type", ["Brass"]).select("p_partkey")


@register("over_read", f"SELECT l_suppkey, CAST(sum({EXT}) AS DOUBLE) AS net_sf, max(l_extendedprice) * 50 AS expected_sf FROM lineitem GROUP BY 1 HAVING CAST(sum({EXT}) AS DOUBLE) > 1.4 * (max(l_extendedprice) * 50)")
def over_read(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("e", F.col("l_extendedprice") * 50)
    return rollup.over_read(rows, "l_suppkey", "l_extendedprice", "e")


@register(
    "size_ratio_flags",
    f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT l_orderkey, CAST(sum({EXT}) AS DOUBLE) AS page_sf, max(l_extendedprice) AS largest, CAST(max(n) AS BIGINT) AS pieces, max(CASE WHEN k = n // 2 + 1 THEN l_extendedprice END) AS median,
           (max(n) >= 4 AND max(l_extendedprice) > 3 * max(CASE WHEN k = n // 2 + 1 THEN l_extendedprice END) AND max(l_extendedprice) > 1500) OR sum({EXT}) > 40000 AS flagged
    FROM r GROUP BY 1""",
)
def size_ratio_flags(spark, sf_dir):
    return rollup.size_ratio_flags(lines(spark, sf_dir), "l_orderkey", "l_extendedprice")


@register(
    "sanity_ratios",
    f"""
    WITH p AS (SELECT l_suppkey AS job, l_orderkey AS page, CAST(sum({EXT}) AS DOUBLE) AS sf, max(l_extendedprice) AS largest, count(*) AS n FROM lineitem GROUP BY 1, 2),
         j AS (SELECT l_suppkey AS job, CAST(sum({EXT}) AS DOUBLE) AS sf, max(l_extendedprice) AS largest, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'A' THEN {EXT} END) AS DOUBLE) AS so, CAST(sum(CASE WHEN l_returnflag = 'N' THEN {EXT} END) AS DOUBLE) AS un FROM lineitem GROUP BY 1)
    SELECT job, page, 'R2_page_sf_max' AS ratio, sf AS value, CAST(40000 AS DOUBLE) AS threshold FROM p WHERE sf > 40000
    UNION ALL SELECT job, page, 'R2_page_sf_min_nonzero', sf, 50 FROM p WHERE sf > 0 AND sf < 50
    UNION ALL SELECT job, page, 'R3_single_poly_sf_max', largest, 20000 FROM p WHERE largest > 20000
    UNION ALL SELECT job, page, 'R3_page_mean_poly_max', round(sf / n, 1), 5000 FROM p WHERE sf / n > 5000
    UNION ALL SELECT job, NULL, 'R1_job_total_sf', sf, 150 FROM j WHERE sf > 0 AND sf < 150
    UNION ALL SELECT job, NULL, 'R1_job_total_sf', sf, 100000 FROM j WHERE sf > 100000
    UNION ALL SELECT job, NULL, 'R4_dominance_share', round(largest / sf, 3), 0.85 FROM j WHERE n >= 5 AND largest / sf > 0.85
    UNION ALL SELECT job, NULL, 'R5_soffit_share_max', round(so / sf, 3), 0.35 FROM j WHERE so / sf > 0.35
    UNION ALL SELECT job, NULL, 'R5_unassigned_nonbfs_share_max', round(un / sf, 3), 0.25 FROM j WHERE un / sf > 0.25""",
)
def sanity_ratios(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("l_suppkey").alias("job"), F.col("l_orderkey").alias("pg"), "l_extendedprice", "l_returnflag")
    return reconcile.failed_ratios(rows, "job", "pg", "l_extendedprice", F.col("l_returnflag") == "A", F.col("l_returnflag") == "N")


@register(
    "bench_scores",
    f"""
    WITH t AS (SELECT l_orderkey, CAST(sum({EXT}) AS DOUBLE) AS got FROM lineitem GROUP BY 1),
         r AS (SELECT o_totalprice AS gold, got, least(got, o_totalprice) / greatest(got, o_totalprice) AS cover FROM orders JOIN t ON o_orderkey = l_orderkey)
    SELECT CAST(count(*) AS BIGINT) AS walls, CAST(count(CASE WHEN cover >= 0.3 THEN 1 END) AS BIGINT) AS found, CAST(count(CASE WHEN cover >= 0.7 THEN 1 END) AS BIGINT) AS covered,
           CAST(count(CASE WHEN cover >= 0.7 AND abs(got - gold) <= 0.15 * gold THEN 1 END) AS BIGINT) AS money_right FROM r""",
)
def bench_scores(spark, sf_dir):
    got = lines(spark, sf_dir).groupBy("l_orderkey").agg(rollup.total("l_extendedprice").alias("got"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("gold")).join(got, F.col("o_orderkey") == F.col("l_orderkey"))
    return review.bench_scores(r.withColumn("cover", F.least("got", "gold") / F.greatest("got", "gold")), "gold", "got", "cover")


@register(
    "autonomy_meter",
    f"""
    WITH t AS (SELECT l_orderkey, CAST(sum({EXT}) AS DOUBLE) AS auto FROM lineitem GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS jobs, round_even(avg(round_even(100 * (least(auto, o_totalprice) / greatest(auto, o_totalprice, 1.0)), 0)), 0) AS autonomy
    FROM orders JOIN t ON o_orderkey = l_orderkey WHERE o_totalprice > 0""",
)
def autonomy_meter(spark, sf_dir):
    """Of two finals of each order the later one counts."""
    auto = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(rollup.total("l_extendedprice").alias("auto"))
    final = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(2).alias("at"))
    earlier = final.select("o_orderkey", (F.col("o_totalprice") / 2).alias("o_totalprice"), F.lit(1).alias("at"))
    return review.autonomy(final.unionByName(earlier), auto, "o_orderkey", "o_totalprice", "auto", ["at"])


@register(
    "wilson_review",
    """
    WITH c AS (SELECT d.source AS cls, count(*) AS n, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS w FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL GROUP BY 1)
    SELECT cls, CAST(n AS BIGINT) AS walls, CAST(w AS BIGINT) AS wrong,
           round(100 * (w / CAST(n AS DOUBLE) + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(w / CAST(n AS DOUBLE) * (1 - w / CAST(n AS DOUBLE)) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 4) AS upper
    FROM c""",
)
def wilson_review(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").filter("quality is not null").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    g = rows.groupBy(F.col("source").alias("cls")).agg(F.count(F.lit(1)).alias("walls"), F.sum((F.col("quality") == 0).cast("bigint")).alias("wrong"))
    return g.withColumn("upper", F.round(review.wilson_upper(F.col("wrong"), F.col("walls")), 4)).orderBy(F.desc("upper"), "cls")


@register(
    "review_queue",
    """
    WITH z AS (SELECT event_id, value, CASE user_id % 11 WHEN 0 THEN 'multi' WHEN 1 THEN 'v13' WHEN 2 THEN 'train' WHEN 3 THEN 'fill' WHEN 4 THEN 'flood' WHEN 5 THEN 'band' WHEN 6 THEN 'color' WHEN 7 THEN 'hatch' WHEN 8 THEN 'rc' WHEN 9 THEN 'markup' ELSE 'model' END AS cls FROM events)
    SELECT event_id, cls, value, CAST(CASE cls WHEN 'multi' THEN 1 WHEN 'v13' THEN 2 WHEN 'train' THEN 3 WHEN 'fill' THEN 4 WHEN 'flood' THEN 5 WHEN 'band' THEN 6 WHEN 'color' THEN 7 WHEN 'hatch' THEN 8 WHEN 'rc' THEN 9 WHEN 'markup' THEN 10 ELSE 0 END AS INTEGER) AS review_rank,
           CASE cls WHEN 'multi' THEN 72.0 WHEN 'v13' THEN 54.5 WHEN 'train' THEN 44.1 WHEN 'fill' THEN 36.3 WHEN 'flood' THEN 32.6 WHEN 'band' THEN 30.1 WHEN 'color' THEN 28.9 WHEN 'hatch' THEN 26.8 WHEN 'rc' THEN 18.1 END::DOUBLE AS upper
    FROM z""",
)
def review_queue(spark, sf_dir):
    names = ["multi", "v13", "train", "fill", "flood", "band", "color", "hatch", "rc", "markup", "model"]
    cls = F.get(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % 11).cast("int"))
    z = table(spark, sf_dir, "events").select("event_id", "value", cls.alias("cls"))
    return review.review_queue(z, "cls", "value", "event_id").select("event_id", "cls", "value", "review_rank", "upper")


@register("convention_rollup", f"SELECT CAST(count(*) AS BIGINT) AS walls, CAST(sum({EXT}) AS DOUBLE) AS gross_sf, CAST(round(sum({EXT}) * 7 / 100, 0) AS DOUBLE) AS p25_sf, CAST(round(sum({EXT}) * 25 / 100, 0) AS DOUBLE) AS p75_sf FROM lineitem WHERE l_returnflag <> 'R' AND l_extendedprice >= 400")
def convention_rollup(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("s", F.col("l_returnflag") == "R").withColumn("h", F.array().cast("array<int>"))
    return review.convention_rollup(review.convention_flags(rows, "l_extendedprice", "s", "h"), "l_extendedprice")


@register("fingerprint")
def fingerprint(spark, sf_dir):
    """No SQL: the hash is Spark's own."""
    return review.fingerprint(lines(spark, sf_dir), "l_orderkey", "l_linenumber", "l_extendedprice")


@register(
    "declared_sources",
    """
    WITH a AS (SELECT p_brand AS k, max(p_type) AS v, max(p_size) AS s FROM part WHERE p_size > 30 GROUP BY 1),
         b AS (SELECT p_brand AS k, min(p_type) AS v, min(p_size) AS s FROM part GROUP BY 1)
    SELECT b.k AS k, CAST(CASE WHEN a.k IS NULL THEN 1 ELSE 0 END AS INTEGER) AS source, coalesce(a.v, b.v) AS v, coalesce(CASE WHEN a.s > 45 THEN NULL ELSE a.s END, b.s) AS s FROM b LEFT JOIN a ON a.k = b.k""",
)
def declared_sources(spark, sf_dir):
    """U4: the first source's values; what it lacks comes from the second."""
    part = table(spark, sf_dir, "part")
    a = part.filter("p_size > 30").groupBy(F.col("p_brand").alias("k")).agg(F.max("p_type").alias("v"), F.max("p_size").alias("s")).withColumn("s", F.when(F.col("s") <= 45, F.col("s")))
    b = part.groupBy(F.col("p_brand").alias("k")).agg(F.min("p_type").alias("v"), F.min("p_size").alias("s"))
    return reconcile.declared([a, b], ["k"], ["v", "s"])


def _declared_and_found(spark, sf_dir):
    tokens = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 9)
    named = lambda name, key: table(spark, sf_dir, name).select(key, "text", tokens.alias("tokens"), scope_family(F.col("text")).alias("family"))
    return named("benchmark", "item_id"), named("documents", "doc_id")


@register("declared_vs_found")
def declared_vs_found(spark, sf_dir):
    """J24 over the documents of all languages, with families: each item, and whether it is found. No SQL: a test holds it against
    brute force."""
    declared, found = _declared_and_found(spark, sf_dir)
    missing = reconcile.unmatched(declared, found, "tokens", "family", "item_id").select("item_id", F.lit(False).alias("__f"))
    return declared.join(missing, "item_id", "left").select("item_id", "text", "family", F.coalesce("__f", F.lit(True)).alias("found"))


@register("found_not_declared")
def found_not_declared(spark, sf_dir):
    """Documents that share neither a long word nor a family with an item."""
    declared, found = _declared_and_found(spark, sf_dir)
    return reconcile.unmatched(found, declared, "tokens", "family", "doc_id").select("doc_id", "family")


@register("check_status", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'fail' WHEN bool_or(l_returnflag = 'N') THEN 'unavailable' ELSE 'pass' END AS status FROM lineitem GROUP BY 1")
def check_status(spark, sf_dir):
    outcome = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "N", "unavailable").otherwise("pass")
    return reconcile.status(lines(spark, sf_dir).withColumn("outcome", outcome), "l_orderkey", "outcome")


@register("not_measured", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def not_measured(spark, sf_dir):
    """Sheets of the index without a measured page."""
    return reconcile.not_in(table(spark, sf_dir, "orders").select("o_orderkey"), lines(spark, sf_dir).filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@register(
    "scheme_gate",
    """
    WITH s AS (SELECT c_custkey, c_nationkey AS doc, c_mktsegment AS letters, c_custkey % 40 AS form FROM customer)
    SELECT c_custkey, count(*) OVER (PARTITION BY doc) - 1 >= 4 AND count(*) OVER (PARTITION BY doc, letters, form) - 1 = 0 AS scheme_mismatch,
           CASE WHEN count(*) OVER (PARTITION BY doc) - 1 >= 4 AND count(*) OVER (PARTITION BY doc, letters, form) - 1 = 0 THEN 0.59::DOUBLE ELSE 0.9::DOUBLE END AS conf FROM s""",
)
def scheme_gate(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("doc"), F.col("c_mktsegment").alias("letters"), (F.col("c_custkey") % 40).alias("form"), F.lit(0.9).alias("conf"))
    return reconcile.scheme_gate(s, "doc", "c_custkey", "letters", "form", "conf").select("c_custkey", "scheme_mismatch", "conf")


@register("story_table", "SELECT l_orderkey, CAST(count(DISTINCT l_linestatus || CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_quantity AS VARCHAR)) AS BIGINT) AS levels, max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) - min(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS height_ft FROM lineitem GROUP BY 1")
def story_table(spark, sf_dir):
    label = F.concat(F.when(F.col("l_linestatus") == "F", "ROOF ").otherwise("GRADE "), F.col("l_linenumber").cast("string"))
    return reconcile.story_table(lines(spark, sf_dir).withColumn("label", label), "l_orderkey", "label", "l_quantity")


@register("content_dedupe", "SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS is_copy FROM documents")
def content_dedupe(spark, sf_dir):
    """U5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    return reconcile.first_copies(docs, F.col("m"), ["doc_id"]).select("doc_id", "is_copy")


@register("fuzzy_dedupe", "SELECT p_partkey, row_number() OVER (PARTITION BY left(lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), 12) ORDER BY p_partkey) > 1 AS is_copy FROM part")
def fuzzy_dedupe(spark, sf_dir):
    """U11."""
    return reconcile.first_copies(table(spark, sf_dir, "part").select("p_partkey", "p_name"), reconcile.letters_key(F.col("p_name")), ["p_partkey"]).select("p_partkey", "is_copy")


@register("table_counts", "SELECT 'runs' AS \"table\", CAST(count(*) AS BIGINT) AS rows FROM orders UNION ALL SELECT 'hatches', CAST(count(*) AS BIGINT) FROM part")
def table_counts(spark, sf_dir):
    from ..operators.learning import table_counts as counts

    return counts(runs=table(spark, sf_dir, "orders"), hatches=table(spark, sf_dir, "part"))


@register("zone_nets", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS k FROM lineitem), g AS (SELECT l_orderkey, max(l_quantity) AS gross, sum(CASE WHEN k > 1 THEN l_quantity ELSE 0 END) AS o FROM r GROUP BY 1) SELECT l_orderkey, gross, least(o, 0.85 * gross) AS openings, gross - least(o, 0.85 * gross) AS net FROM g")
def zone_nets(spark, sf_dir):
    """G30."""
    from ..operators.measure import zone_nets as nets

    return nets(lines(spark, sf_dir).withColumn("id", F.col("l_partkey")), ["l_orderkey"], "l_quantity")


@register("dropped_by_budget", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders) SELECT o_orderkey FROM r WHERE k > 200 OR s > 20000000")
def dropped_by_budget(spark, sf_dir):
    """A41."""
    files = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("size"))
    return windows.dropped_by_budget(files, [F.desc("o_orderdate"), F.col("o_orderkey")], "size", 200, 20000000).select("o_orderkey")
