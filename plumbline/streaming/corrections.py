"""Corrections and job states as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import latest_per_key
from ..sources.folder import drop_path


def _held(spark: SparkSession, table: str, version: int) -> dict[int, int]:
    """The version that holds each bucket after a batch: at most a row a bucket."""
    return {r["bucket"]: r["held"] for r in spark.read.parquet(f"{table}/manifest/version={version}").collect()}


def _rows(spark: SparkSession, table: str, held: dict[int, int]) -> DataFrame | None:
    paths = [f"{table}/rows/__version={v}/__bucket={b}" for b, v in sorted(held.items())]
    return spark.read.option("basePath", f"{table}/rows").parquet(*paths) if paths else None


def learn_stream(events: DataFrame, keys: list[str], order: list[str], table: str, checkpoint: str, buckets: int = 64):
    """Each batch is folded into the latest row of each key. Rows lie in buckets of their keys; a batch writes the buckets that it
    touches under its own number, and a manifest of the number that holds each bucket, so a batch that is run again writes the same. A
    batch needs the manifest and the buckets of its predecessor: a lost file fails it, and is no empty table. What the last two
    manifests don't name is deleted. Returns the running query."""
    hits = "hits"

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest_per_key(batch, keys, order).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        before = _held(spark, table, number - 1) if number else {}
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # at most `buckets` rows
        old = _rows(spark, table, {b: before[b] for b in touched if b in before})
        both = new if old is None else old.select(*new.columns).unionByName(new)
        rest = [c for c in new.columns if c not in (*keys, hits, "__bucket")]
        out = both.groupBy("__bucket", *keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"), F.sum(hits).alias(hits)).select(*keys, "r.*", hits, "__bucket")
        out.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{table}/rows/__version={number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, held bigint").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/version={number}")
        if number >= 2:
            stays = {*before.items(), *now.items()}
            for b, v in set(_held(spark, table, number - 2).items()) - stays:
                drop_path(f"{table}/rows/__version={v}/__bucket={b}")
            drop_path(f"{table}/manifest/version={number - 2}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, table: str) -> DataFrame:
    """The table after the last batch."""
    last = spark.read.parquet(f"{table}/manifest").agg(F.max("version")).first()[0]
    return _rows(spark, table, _held(spark, table, last)).drop("__version", "__bucket")


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event time; what comes later than the watermark is left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def job_state_stream(events: DataFrame, job: str, state: str, order: str, table: str, checkpoint: str):
    """The last state of each job, whatever the order of arrival."""
    return learn_stream(events.select(job, state, order), [job], [order, state], table, checkpoint)
