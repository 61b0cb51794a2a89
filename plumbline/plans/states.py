"""Overrides, upserts and streams over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overrides
from ..sources.folder import shared_path
from ..sources.tables import upsert as upsert_rows
from ..streaming import corrections as stream
from .registry import register, table

_LATEST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events"


def _events(spark, sf_dir):
    """Events as overrides of a customer: purchases set a net, logouts clear it."""
    e = table(spark, sf_dir, "events")
    clear = F.pmod(F.col("event_id"), F.lit(5)) == 0
    return e.select(F.lit("j").alias("job_id"), "user_id", F.when(~clear, F.col("value")).alias("net"), F.lit(False).alias("reset"), "ts", "event_id")


@register("net_override", f"WITH l AS (SELECT user_id, CASE WHEN event_id % 5 <> 0 THEN value END AS net FROM ({_LATEST}) WHERE r = 1) SELECT o_orderkey, coalesce(net, o_totalprice) AS final_net, net IS NOT NULL AS overridden FROM orders LEFT JOIN l ON o_custkey = user_id")
def net_override(spark, sf_dir):
    """J2, R5."""
    now = overrides.current(_events(spark, sf_dir), ["user_id"], "net", ["ts", "event_id"])
    zones = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("net_area"))
    return overrides.with_nets(zones, now.drop("job_id"), ["user_id"]).select("o_orderkey", "final_net", "overridden")


@register("scope_gate", "SELECT o_orderkey, o_orderpriority <> '5-LOW' AND o_custkey % 9 <> 0 AS in_scope FROM orders")
def scope_gate(spark, sf_dir):
    """A priority and every ninth customer are switched off."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("j").alias("job_id"), F.col("o_orderpriority").alias("group"), F.col("o_custkey").cast("int").alias("page"))
    groups = o.select("job_id", F.col("group").alias("key")).distinct().filter("key = '5-LOW'").withColumn("in_scope", F.lit(False))
    switched = o.select("job_id", F.col("page").cast("string").alias("key")).distinct().filter("cast(key as int) % 9 = 0").withColumn("in_scope", F.lit(False))
    return overrides.with_scope(o, groups, switched).select("o_orderkey", "in_scope")


@register("display_names", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'Given ' || c_mktsegment ELSE c_name END AS display_name FROM customer")
def display_names(spark, sf_dir):
    """J3, X21."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_name").alias("material"))
    names = c.select("c_nationkey", "c_mktsegment").distinct().withColumn("name", F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("Given "), F.col("c_mktsegment"))).otherwise(""))
    return overrides.with_names(c, names, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "display_name")


@register("job_states", "WITH t AS (SELECT max(ts) AS t FROM events WHERE event_id % 2 = 0) SELECT user_id, CASE WHEN event_type IN (SELECT min(event_type) FROM events) AND ts < t THEN 'error' WHEN event_type IN (SELECT min(event_type) FROM events) THEN 'running' ELSE event_type END AS state FROM (" + _LATEST + "), t WHERE r = 1")
def job_states(spark, sf_dir):
    """Jobs that a restart finds running are errors."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    least = e.agg(F.min("event_type").alias("m"))
    e = e.join(F.broadcast(least), F.lit(True)).withColumn("state", F.when(F.col("event_type") == F.col("m"), "running").otherwise(F.col("event_type")))
    return overrides.job_states(e.select("user_id", "state", "ts", "event_id"), "user_id", "state", ["ts", "event_id"], e.filter("event_id % 2 = 0").select("ts")).select("user_id", "state")


@register("upsert", "WITH n AS (SELECT user_id, max(value) AS value, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1), o AS (SELECT user_id, min(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.value, o.value) AS value, CAST(CASE WHEN o.user_id IS NULL THEN 1 WHEN n.user_id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS hits FROM n FULL JOIN o ON n.user_id = o.user_id")
def upsert(spark, sf_dir):
    """W1, S15."""
    e = table(spark, sf_dir, "events")
    old = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.min("value").alias("value")).withColumns({"at": F.lit(1), "hits": F.lit(1)})
    new = e.filter("event_id % 2 = 1").groupBy("user_id").agg(F.max("value").alias("value")).withColumn("at", F.lit(2))
    return upsert_rows(old, new, ["user_id"], "at").select("user_id", "value", "hits")


def _source(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads a folder; the table may be one file
    name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(path if _is_folder(spark, path) else f"{name[0]}/{{{name[1]}}}")


def _is_folder(spark, path: str) -> bool:
    """A table of one file is the file itself."""
    return not any(f.rstrip("/").endswith(path.rsplit("/", 1)[1]) for f in spark.read.parquet(path).inputFiles())


@register("learn_stream", "SELECT user_id, event_type, value, hits FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS hits FROM events) WHERE r = 1")
def learn_stream(spark, sf_dir):
    """The stream's table equals the batch's."""
    at = shared_path(spark, "stream")
    rows = _source(spark, sf_dir).select("user_id", "event_type", "value", "ts", "event_id")
    stream.learn_stream(rows, ["user_id"], ["ts", "event_id"], f"{at}/table", f"{at}/state").awaitTermination()
    return stream.newest(spark, f"{at}/table").select("user_id", "event_type", "value", "hits")


@register("job_state_stream", f"SELECT user_id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS r FROM events) WHERE r = 1")
def job_state_stream(spark, sf_dir):
    """R4."""
    at = shared_path(spark, "stream")
    rows = _source(spark, sf_dir).select("user_id", F.col("event_type").alias("state"), "ts")
    stream.job_state_stream(rows, "user_id", "state", "ts", f"{at}/table", f"{at}/state").awaitTermination()
    return stream.newest(spark, f"{at}/table").select("user_id", "state")
