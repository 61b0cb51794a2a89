"""Logs, sessions, medians and scales over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learned, learning, pages, spatial, windows
from .registry import register, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@register("latest_label", "SELECT user_id, event_type, value, hits FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS hits FROM events) WHERE r = 1")
def latest_label(spark, sf_dir):
    """W1, R1."""
    return windows.latest_per_key(events(spark, sf_dir).select("user_id", "event_type", "value", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value", "hits")


@register("first_label", "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_label(spark, sf_dir):
    """W2."""
    return windows.first_per_key(events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


@register("hits_recall", "WITH c AS (SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS hits FROM events GROUP BY 1, 2) SELECT user_id, event_type, hits FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, event_type) AS r FROM c) WHERE r = 1")
def hits_recall(spark, sf_dir):
    """T7, W2."""
    return windows.best_by_hits(events(spark, sf_dir), "user_id", "event_type")


@register("confirmed_pairs", "SELECT event_type, trim(CAST(user_id % 50 AS VARCHAR)) AS name, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS n_jobs FROM events GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) >= 3")
def confirmed_pairs(spark, sf_dir):
    """A17."""
    rows = events(spark, sf_dir).select("event_type", (F.col("user_id") % 50).cast("string").alias("name"), F.to_date("ts").alias("job"))
    return learning.promoted_pairs(rows, "event_type", "name", "job").select("event_type", "name", "n_jobs")


@register("export_since", "SELECT event_id, ts FROM events WHERE ts > (SELECT min(ts) + INTERVAL 5 DAY FROM events)")
def export_since(spark, sf_dir):
    """Rows after a cursor (five days after the first)."""
    rows = events(spark, sf_dir).select("event_id", "ts")
    first = rows.agg(F.min("ts").alias("m")).first()["m"]
    from datetime import timedelta

    return rows.limit(0) if first is None else learning.since(rows, "ts", first + timedelta(days=5))


@register("gap_sessions", "WITH g AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) <= 5 THEN 0 ELSE 1 END AS n FROM events) SELECT user_id, event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g")
def gap_sessions(spark, sf_dir):
    """W5."""
    return windows.gap_sessions(events(spark, sf_dir), ["user_id"], ["value", "event_id"], F.col("value"), 5).select("user_id", "event_id", "session")


@register(
    "interval_union",
    """
    WITH i AS (SELECT l_orderkey, l_partkey AS a, l_partkey + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
         m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM i),
         g AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m),
         u AS (SELECT l_orderkey, k, max(b) - min(a) AS l FROM g GROUP BY 1, 2)
    SELECT l_orderkey, CAST(sum(l) AS BIGINT) AS union_length, CAST(count(*) AS BIGINT) AS islands FROM u GROUP BY 1""",
)
def interval_union(spark, sf_dir):
    """A29."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("b"))
    return windows.interval_union(rows, ["l_orderkey"], "a", "b").withColumn("union_length", F.col("union_length").cast("bigint"))


@register("upper_median", "SELECT l_suppkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS median FROM lineitem GROUP BY 1")
def upper_median(spark, sf_dir):
    """A20."""
    return windows.upper_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@register("nearest_rank_pct", "SELECT l_suppkey, list_sort(list(l_quantity))[least(CAST(floor(len(list(l_quantity)) * 90 / 100) AS BIGINT), len(list(l_quantity)) - 1) + 1] AS value FROM lineitem GROUP BY 1")
def nearest_rank_pct(spark, sf_dir):
    """A23."""
    return windows.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 90)


_WEIGHTED = """
    WITH s AS (SELECT l_suppkey AS job, l_discount AS v, sum(CAST(l_quantity AS DECIMAL(18,2))) AS w FROM lineitem GROUP BY 1, 2),
         r AS (SELECT *, sum(w) OVER (PARTITION BY job ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY job) AS a FROM s),
         m AS (SELECT job, min(v) AS median, CAST(max(a) AS DOUBLE) AS weight FROM r WHERE run * 2 >= a GROUP BY 1)
"""


@register("weighted_median", _WEIGHTED + "SELECT job, median, weight FROM m")
def weighted_median(spark, sf_dir):
    """A22."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("job"), F.col("l_discount").alias("v"), F.col("l_quantity").cast("decimal(18,2)").alias("w"))
    return windows.weighted_median(rows, ["job"], "v", F.col("w")).withColumn("weight", F.col("weight").cast("double"))


@register(
    "weighted_median_outliers",
    _WEIGHTED
    + """, n AS (SELECT l_suppkey AS job, count(*) AS n FROM lineitem GROUP BY 1),
         k AS (SELECT l_suppkey AS job, sum(CASE WHEN l_discount > 0.5 * median AND l_discount < 2 * median THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS near FROM lineitem JOIN m ON l_suppkey = job GROUP BY 1)
    SELECT l_suppkey AS job, l_orderkey, l_discount AS v, CAST(count(*) AS BIGINT) AS rows FROM lineitem JOIN m ON l_suppkey = m.job JOIN n ON n.job = m.job JOIN k ON k.job = m.job
    WHERE n >= 3 AND near * 2 > weight AND median > 0 AND l_discount / median >= 2 GROUP BY 1, 2, 3""",
)
def weighted_median_outliers(spark, sf_dir):
    """A22, A24."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("job"), "l_orderkey", F.col("l_discount").alias("v"), F.col("l_quantity").cast("decimal(18,2)").alias("w"))
    out = windows.scale_outliers(rows.filter("v > 0 or v = 0"), ["job"], "v", F.col("w"))
    return out.filter("median > 0 and outlier").groupBy("job", "l_orderkey", "v").agg(F.count(F.lit(1)).alias("rows"))


@register("mode_consensus", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS a, count(*) OVER (PARTITION BY user_id) AS kinds FROM c) SELECT user_id, event_type AS mode, CAST(n AS BIGINT) AS votes, kinds = 1 OR (n >= 2 AND n > a - n) AS confirmed FROM r WHERE k = 1")
def mode_consensus(spark, sf_dir):
    """A25."""
    return windows.mode_consensus(events(spark, sf_dir), ["user_id"], "event_type")


@register("series_gap", "WITH h AS (SELECT c_nationkey AS series, chr(CAST(65 + (c_custkey * 7 + c_nationkey) % 26 AS INTEGER)) AS letter FROM customer), m AS (SELECT series, max(ascii(letter)) AS m FROM h GROUP BY 1), e AS (SELECT series, chr(CAST(unnest(range(65, m + 1)) AS INTEGER)) AS missing FROM m) SELECT series, missing FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.series = e.series AND h.letter = e.missing)")
def series_gap(spark, sf_dir):
    """W9."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("series"), F.char(65 + (F.col("c_custkey") * 7 + F.col("c_nationkey")) % 26).alias("letter"))
    return windows.missing_in_series(rows, "series", "letter")


@register("trimmed_ends", "WITH v AS (SELECT l_orderkey, l_partkey, min(CASE WHEN l_quantity > 25 THEN l_partkey END) OVER (PARTITION BY l_orderkey) AS a, max(CASE WHEN l_quantity > 25 THEN l_partkey END) OVER (PARTITION BY l_orderkey) AS b FROM lineitem) SELECT l_orderkey, l_partkey FROM v WHERE l_partkey BETWEEN a AND b")
def trimmed_ends(spark, sf_dir):
    """W10."""
    return windows.trimmed_ends(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", F.col("l_quantity") > 25).select("l_orderkey", "l_partkey")


@register("strip_integral", "WITH c AS (SELECT l_orderkey, l_partkey AS c, max(l_quantity) AS h FROM lineitem GROUP BY 1, 2), w AS (SELECT *, (coalesce(c - lag(c) OVER (PARTITION BY l_orderkey ORDER BY c), 0) + coalesce(lead(c) OVER (PARTITION BY l_orderkey ORDER BY c) - c, 0)) / 2.0 AS w FROM c) SELECT l_orderkey, CAST(sum(CAST(w * h AS DECIMAL(18,2))) AS DOUBLE) AS area FROM w GROUP BY 1")
def strip_integral(spark, sf_dir):
    """Exact in halves, so the sum does not depend on its order."""
    out = spatial.strip_integral(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("double").alias("c"), "l_quantity"), "l_orderkey", "c", "l_quantity")
    return out.select("l_orderkey", F.col("area").cast("double").alias("area"))


@register("sibling_scale", "WITH p AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_nationkey % 3 + CASE WHEN c_custkey % 7 = 0 AND c_nationkey % 2 = 0 THEN 1 ELSE 0 END) END::DOUBLE AS s FROM customer) SELECT c_custkey, CASE WHEN s IS NULL AND min(s) OVER w = max(s) OVER w THEN min(s) OVER w END AS inherited_scale FROM p WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment)")
def sibling_scale(spark, sf_dir):
    """J35."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    s = F.when(k % 5 != 0, n % 3 + F.when((k % 7 == 0) & (n % 2 == 0), 1).otherwise(0)).cast("double")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", s.alias("s"), F.lit(True).alias("sure"))
    return pages.sibling_scale(rows, "c_nationkey", ["c_mktsegment"], "s", "sure").select("c_custkey", "inherited_scale")


@register(
    "label_outliers",
    """
    WITH i AS (SELECT l_orderkey, l_partkey, l_quantity AS sf, l_linenumber * 100.0::DOUBLE AS a, 72 * sqrt(l_quantity / (l_linenumber * 100.0::DOUBLE)) AS s FROM lineitem),
         r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM i), m AS (SELECT *, max(CASE WHEN k = n // 2 + 1 THEN s END) OVER (PARTITION BY l_orderkey) AS med FROM r)
    SELECT l_orderkey, CAST(count(*) AS BIGINT) AS labels, CAST(count(CASE WHEN n >= 3 AND (s / med > 1.32 OR s / med < 0.76) THEN 1 END) AS BIGINT) AS outliers FROM m GROUP BY 1""",
)
def label_outliers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("sf"), (F.col("l_linenumber") * F.lit(100.0)).alias("a"))
    return pages.label_outliers(rows, "l_orderkey", "sf", "a").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("labels"), F.count_if("label_outlier").alias("outliers"))


@register("text_reliable", "SELECT count(CASE WHEN length(text) > 150 THEN 1 END) >= greatest(3, floor(count(*) * 0.3)) AS text_reliable FROM documents")
def text_reliable(spark, sf_dir):
    """F12."""
    return pages.text_reliable(table(spark, sf_dir, "documents"), "text")


@register("segment_stats", "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS segments, count(*) > 250000 AS too_dense, count(*) >= 40000 AND count(CASE WHEN l_discount <= 0.6 THEN 1 END) >= 0.8 * count(*) AS dense FROM lineitem GROUP BY 1")
def segment_stats(spark, sf_dir):
    """F9, F10."""
    return pages.segment_stats(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount")


@register("page_budget", "SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS budget_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 8")
def page_budget(spark, sf_dir):
    """A budget of eight pages a document is the operator."""
    from ..sources.documents import page_budget as budget

    return budget(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "budget_rank")


@register("merged_tiles", "WITH m AS (SELECT l_partkey, l_suppkey, l_returnflag, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS p FROM lineitem GROUP BY 1, 2, 3) SELECT l_partkey, l_suppkey, l_returnflag, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY p DESC, l_returnflag) AS r FROM m) WHERE r = 1")
def merged_tiles(spark, sf_dir):
    """A31."""
    from ..operators.measure import merged_tiles as merged

    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", F.col("l_discount").cast("decimal(18,2)").alias("d"))
    sums = windows.dealt(rows, ["l_partkey", "l_suppkey"]).groupBy("l_partkey", "l_suppkey", "l_returnflag").agg((F.sum("d").cast("double") / F.count(F.lit(1))).alias("p"))
    return merged(sums, ["l_partkey", "l_suppkey"], "l_returnflag", "p").withColumn("p", F.round("p", 6))


@register(
    "two_levels",
    """
    WITH v AS (SELECT l_suppkey, l_quantity::DOUBLE AS v, count(*) AS c FROM lineitem GROUP BY 1, 2),
         r AS (SELECT l_suppkey, v, sum(c) OVER w AS n, sum(c * v) OVER w AS s, sum(c * v * v) OVER w AS q, sum(c) OVER a AS m, sum(c * v) OVER a AS t, sum(c * v * v) OVER a AS u FROM v
               WINDOW w AS (PARTITION BY l_suppkey ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY l_suppkey)),
         b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round((q - s * s / n) + (u - q - (t - s) * (t - s) / (m - n)), 6), v) AS k FROM r WHERE n < m)
    SELECT l_suppkey, v AS cut, m > 300 AND (t - s) / (m - n) - s / n > 22 AS separated FROM b WHERE k = 1""",
)
def two_levels(spark, sf_dir):
    """K4."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    return learned.two_levels(rows, ["l_suppkey"], "l_quantity").select("l_suppkey", "cut", "separated")


@register("texture_kmeans")
def texture_kmeans(spark, sf_dir):
    """Vectors by all their components; no SQL: fitted clusters."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    width = rows.select(F.max(F.size("embedding"))).first()[0] or 0
    each = rows.select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(f"f{k}") for k in range(width)])
    return learned.texture_groups(each, [f"f{k}" for k in range(width)], learned.cluster_count(rows.count())).select("vec_id", "cluster")
