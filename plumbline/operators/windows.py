"""Window operators (W1-W12, A20-A25, A29, T9, A41): latest, first, sessions, unions, medians, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folder import keep


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows by keys, in four parts for each shuffle partition of the session. Adaptive execution joins parts by their bytes on the wire,
    and rows of a few numbers take many times that in a task that sorts or gathers them; a number of parts that is named stays."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def latest_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Replay of a log, the last row of each key with the number of its rows. An aggregate, so it combines before the
    shuffle and a hot key costs a row a task; order must be total."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"), F.count(F.lit(1)).alias("hits")).select(*keys, "__r.*", "hits")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W2, W12."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def best_by_hits(log: DataFrame, key: str, label: str) -> DataFrame:
    """The label with most hits of each key; the least label on ties."""
    counts = log.groupBy(key, label).agg(F.count(F.lit(1)).alias("hits"))
    return counts.groupBy(key).agg(F.min_by(F.struct(label, "hits"), F.struct(-F.col("hits"), F.col(label))).alias("__r")).select(key, "__r.*")


def gap_sessions(rows: DataFrame, keys: list[str], order: list[str], value: Column, gap: float) -> DataFrame:
    """Rows numbered by runs whose neighbours are at most gap apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(value - F.lag(value).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def interval_union(rows: DataFrame, keys: list[str], a: str, b: str, stitch: float = 0.0) -> DataFrame:
    """Length of the union of intervals, and how many islands they form. Gaps up to stitch close."""
    w = Window.partitionBy(*keys).orderBy(a, b)
    reach = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = dealt(rows, keys).withColumn("__new", F.when(F.col(a) <= reach + stitch, 0).otherwise(1))
    island = marked.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy(*keys, "__i").agg((F.max(b) - F.min(a)).alias("__l"))
    return merged.groupBy(*keys).agg(F.sum("__l").alias("union_length"), F.count(F.lit(1)).alias("islands"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """The first value whose running weight reaches half. Weights of equal values add up before the window."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys)
    run = sums.withColumns({"__run": F.sum("__w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__w").over(w)})
    return run.filter(F.col("__run") * 2 >= F.col("__all")).groupBy(*keys).agg(F.min(value).alias("median"), F.first("__all").alias("weight"))


def scale_outliers(rows: DataFrame, keys: list[str], scale: str, weight: Column, least: int = 3) -> DataFrame:
    """Weighted-median outliers: with at least three rows, and most weight strictly between half and twice the median, rows
    of twice the median or more are flagged."""
    rows = dealt(rows, keys)
    m = weighted_median(rows, keys, scale, weight).join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys)
    j = rows.join(m, keys)
    near = j.groupBy(*keys).agg(F.sum(F.when((F.col(scale) > 0.5 * F.col("median")) & (F.col(scale) < 2 * F.col("median")), weight)).alias("__near"))
    out = j.join(near, keys)
    agreed = (F.col("__n") >= least) & (F.col("__near") * 2 > F.col("weight"))
    return out.withColumn("ratio", F.col(scale) / F.col("median")).withColumn("outlier", F.coalesce(agreed, F.lit(False)) & (F.col("ratio") >= 2)).drop("__n", "__near")


def _at_rank(rows: DataFrame, keys: list[str], value: str, rank, name: str) -> DataFrame:
    """The value at a place (from 0, of the number of rows) of each key's sorted list. Equal values are counted before the
    window, and combine before the shuffle; it runs over distinct values."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys)
    run = counts.withColumns({"__to": F.sum("__c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("__c").over(w)})
    at = rank(F.col("__n"))
    return run.filter((F.col("__to") > at) & (F.col("__to") - F.col("__c") <= at)).select(*keys, F.col(value).alias(name))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sorted[n // 2]."""
    return _at_rank(rows, keys, value, lambda n: F.floor(n / 2), "median")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percent: float) -> DataFrame:
    """The value at index int(p / 100 n), at most the last."""
    return _at_rank(rows, keys, value, lambda n: F.least(F.floor(n * percent / 100), n - 1), "value")


def mode_consensus(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value, confirmed where it is alone, or has at least two votes and more than all others."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    g = counts.groupBy(*keys).agg(F.min_by(F.struct(value, "__n"), F.struct(-F.col("__n"), F.col(value))).alias("b"), F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__kinds"))
    n = F.col("b.__n")
    return g.select(*keys, F.col(f"b.{value}").alias("mode"), n.alias("votes"), ((F.col("__kinds") == 1) | ((n >= 2) & (n > F.col("__all") - n))).alias("confirmed"))


def missing_in_series(rows: DataFrame, prefix: str, letter: str) -> DataFrame:
    """Letters from A to the largest that a series lacks."""
    own = rows.groupBy(prefix).agg(F.max(F.ascii(letter)).alias("__m"), F.collect_set(letter).alias("__have"))
    every = F.transform(F.sequence(F.lit(65), F.col("__m")), lambda k: F.char(k))
    return own.select(prefix, F.explode(F.array_except(every, F.col("__have"))).alias("missing"))


def dropped_by_budget(rows: DataFrame, order: list[Column], size: str, most_rows: int, most_size: float) -> DataFrame:
    """In order, what lies beyond the number or the size that may stay. Rows are dealt by ranges of the order and written
    once; each range runs by itself, on top of the sums of the ranges before it (a row each)."""
    ranges = keep(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"), F.sum(size).alias("__z"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__r0"), F.coalesce(F.sum("__z").over(before), F.lit(0)).alias("__s0"))
    w = Window.partitionBy("__p").orderBy(*order)
    run = ranges.withColumns({"__r": F.row_number().over(w), "__s": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))}).join(F.broadcast(sums), "__p")  # a row a range
    return run.filter((F.col("__r") + F.col("__r0") > most_rows) | (F.col("__s") + F.col("__s0") > most_size)).select(*rows.columns)


def trimmed_ends(rows: DataFrame, keys: list[str], order: str, valid: Column) -> DataFrame:
    """Rows between the first and the last valid one."""
    w = Window.partitionBy(*keys)
    v = rows.withColumns({"__a": F.min(F.when(valid, F.col(order))).over(w), "__b": F.max(F.when(valid, F.col(order))).over(w)})
    return v.filter(F.col(order).between(F.col("__a"), F.col("__b"))).drop("__a", "__b")
