"""Sequential folds over sorted arrays (W6, W11, T9, A20-A23, A29, M9), as aggregate()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """sorted[n // 2]."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def nearest_rank(values: Column, percent: float) -> Column:
    """The value at index int(p / 100 n), at most the last."""
    at = F.least(F.floor(F.size(values) * percent / 100).cast("int"), F.size(values) - 1)
    return F.get(F.array_sort(values), F.greatest(at, F.lit(0)))


def spaced(values: Column, gap: float) -> Column:
    """Of a sorted list, each value more than gap above the last one kept."""
    none = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), none, lambda s, v: F.when((F.size(s) == 0) | (v - F.element_at(s, -1) > gap), F.concat(s, F.array(v.cast("double")))).otherwise(s))


def merged_runs(values: Column, tolerance: float) -> Column:
    """Runs of a list whose values stay within tolerance of the run's first, as that first value and the length."""
    none = F.array().cast("array<struct<value:double,n:int>>")
    one = lambda v, n: F.struct(v.cast("double").alias("value"), n.cast("int").alias("n"))

    def step(s: Column, v: Column) -> Column:
        last = F.element_at(s, -1)
        return F.when((F.size(s) == 0) | (F.abs(v - last["value"]) > tolerance), F.concat(s, F.array(one(v, F.lit(1))))).otherwise(F.concat(F.slice(s, 1, F.size(s) - 1), F.array(one(last["value"], last["n"] + 1))))

    return F.aggregate(values, none, step)


def budgeted(values: Column, most: Column, skip: bool = True, count: int = 24) -> Column:
    """Largest first while the sum stays within `most`; what does not fit is skipped, or ends the fold."""
    start = F.struct(F.array().cast("array<double>").alias("kept"), F.lit(0.0).alias("total"), F.lit(False).alias("done"))

    def step(s: Column, v: Column) -> Column:
        fits = (~s["done"]) & (s["total"] + v <= most) & (F.size(s["kept"]) < count)
        kept = F.when(fits, F.concat(s["kept"], F.array(v.cast("double")))).otherwise(s["kept"])
        return F.struct(kept.alias("kept"), (s["total"] + F.when(fits, v).otherwise(F.lit(0.0))).cast("double").alias("total"), (s["done"] | (F.lit(not skip) & ~fits)).alias("done"))

    return F.aggregate(F.reverse(F.array_sort(values)), start, step, lambda s: s["kept"])


def union_length(intervals: Column, stitch: float = 0.0) -> Column:
    """Length of the union of array<struct<a, b>>; gaps up to stitch close."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))

    def step(s: Column, i: Column) -> Column:
        apart = s["b"].isNull() | (i["a"] > s["b"] + stitch)
        return F.struct((s["total"] + F.when(apart, F.coalesce(s["b"] - s["a"], F.lit(0.0))).otherwise(F.lit(0.0))).alias("total"), F.when(apart, i["a"]).otherwise(s["a"]).cast("double").alias("a"), F.when(apart, i["b"]).otherwise(F.greatest(s["b"], i["b"])).cast("double").alias("b"))

    return F.aggregate(F.array_sort(intervals), start, step, lambda s: s["total"] + F.coalesce(s["b"] - s["a"], F.lit(0.0)))


def closes(parts: Column, target: Column, tolerance: float = 0.03, most: int = 16) -> Column:
    """M9: some of the parts (the largest 16) sum to the target within 3%. Sums are kept in tenths of a foot, so the work is bounded."""
    limit = target * (1 + tolerance)
    usable = F.slice(F.reverse(F.array_sort(F.filter(parts, lambda p: (p > 0) & (p <= limit)))), 1, most)
    sums = F.aggregate(usable, F.array(F.lit(0.0)), lambda s, p: F.array_distinct(F.concat(s, F.filter(F.transform(s, lambda x: F.round(x + p, 1)), lambda x: x <= limit))))
    return (F.size(usable) > 0) & F.exists(sums, lambda x: F.abs(x - target) <= target * tolerance)


def axis_overall(lengths: Column, low: float = 6.0, high: float = 400.0, least: int = 3) -> Column:
    """M9: the largest printed length of an axis, if smaller ones close to it; else null."""
    overall = F.array_max(lengths)
    parts = F.filter(lengths, lambda x: x < overall * 0.97)
    return F.when((F.size(lengths) >= least) & overall.between(low, high) & (F.size(parts) >= 2) & closes(parts, overall), overall)


def printed_area(widths: Column, heights: Column) -> Column:
    """Width times height, where both close."""
    return axis_overall(widths) * axis_overall(heights)
