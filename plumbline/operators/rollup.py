"""Pieces to zones and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import filled

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    """Exact sums need decimals: sums of doubles depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def total(c: Column | str) -> Column:
    return F.coalesce(F.sum(money(c)), F.lit(0).cast(MONEY)).cast("double")


def booked(rows: DataFrame, suggest: str = "suggest_only", out: str = "out_of_scope") -> DataFrame:
    """what every total is made of; absent flags are false."""
    off = F.lit(False)
    return rows.filter(~F.coalesce(F.col(suggest), off) & ~F.coalesce(F.col(out), off))


def counted(rows: DataFrame, area: str = "area_sf", suggest: str = "suggest_only") -> DataFrame:
    """F2."""
    return rows.filter(~F.coalesce(F.col(suggest), F.lit(False)) & (F.col(area) > 0))


def without_materials(rows: DataFrame, name: str, ignored: list[str]) -> DataFrame:
    """rows whose name holds none of the ignored words."""
    low = F.lower(F.coalesce(F.col(name), F.lit("")))
    for word in ignored:
        rows = rows.filter(~F.contains(low, F.lit(word.lower())))
    return rows


def zone_rollup(pieces: DataFrame, keys: list[str], area: str, category: str, reader: str, order: str) -> DataFrame:
    """A1: per zone the sum, the count, the category of the last piece and the set of readers."""
    return pieces.groupBy(*keys).agg(
        total(area).alias("net_area"), F.count(F.lit(1)).alias("pieces"), F.max_by(category, order).alias("category"), F.array_sort(F.collect_set(reader)).alias("readers"),
    )


def combined_class(readers: Column) -> Column:
    """None is null, one is itself, several are multi."""
    return F.when(F.size(readers) == 0, None).when(F.size(readers) == 1, F.get(readers, F.lit(0))).otherwise(F.lit("multi"))


def dominant_name(pieces: DataFrame, keys: list[str], name: str, area: str) -> DataFrame:
    """A2: per group its total and the name with the largest sum; the least name on ties.
    Two partial aggregations; the second reads one row a name and group."""
    by_name = pieces.groupBy(*keys, name).agg(F.sum(money(area)).alias("__sf"), F.count(F.lit(1)).alias("__n"))
    largest = F.min_by(name, F.struct(-F.col("__sf"), F.col(name)))
    return by_name.groupBy(*keys).agg(F.sum("__sf").cast("double").alias("net_area"), F.sum("__n").alias("pieces"), largest.alias("dominant_name"))


def scope_summary(zones: DataFrame, group: str, page: str, sf: Column, in_scope: Column) -> DataFrame:
    """A4, A5: totals in and out of scope, zones, distinct pages and whether any is parked."""
    zero = F.lit(0).cast(MONEY)
    return zones.groupBy(F.col(group).alias("group_key")).agg(
        total(sf).alias("total_sf"), F.sum(F.when(in_scope, money(sf)).otherwise(zero)).cast("double").alias("in_sf"), F.sum(F.when(in_scope, zero).otherwise(money(sf))).cast("double").alias("parked_sf"),
        F.count(F.lit(1)).alias("zones"), F.countDistinct(page).alias("pages"), F.bool_or(~in_scope).alias("any_parked"),
    )


def materials_summary(zones: DataFrame, group: str, sf: str, given: str) -> DataFrame:
    """A4 by material with the named and unnamed share."""
    named, zero = filled(F.col(given)).isNotNull(), F.lit(0).cast(MONEY)
    return zones.groupBy(group).agg(total(sf).alias("total_sf"), F.sum(F.when(named, money(sf)).otherwise(zero)).cast("double").alias("named_sf"), F.sum(F.when(named, zero).otherwise(money(sf))).cast("double").alias("unnamed_sf"), F.count_if(named).alias("named_zones"))


def linear_rollup(items: DataFrame, material: str, lf: str) -> DataFrame:
    """Sums by name, largest first."""
    return items.groupBy(material).agg(total(lf).alias("lf")).orderBy(F.desc("lf"), material)


def opening_share(openings: Column, n: Column, holes: Column) -> tuple[Column, Column]:
    """Openings are never negative; their number is given, or that of the holes."""
    return F.greatest(F.coalesce(openings, F.lit(0.0)), F.lit(0.0)), F.coalesce(n, F.size(holes), F.lit(0))


def net_assist(booked_sf: Column, openings: Column) -> tuple[Column, Column, Column]:
    """Gross, openings and net, balanced to the cent: gross - openings = net."""
    o = F.round(F.greatest(openings, F.lit(0)).cast("decimal(18,2)"), 1)
    net = F.round(booked_sf.cast("decimal(18,2)"), 1)
    return (net + o).cast("double"), o.cast("double"), net.cast("double")


def with_total(rows: DataFrame, label: str, sums: list[str], text: str = "TOTAL") -> DataFrame:
    """The rows and one that sums them, in one pass."""
    return rows.select(label, *sums).unionByName(rows.agg(*[total(c).alias(c) for c in sums]).withColumn(label, F.lit(text)))


def adjusted(sf: Column, percent: float = 15) -> Column:
    """A13."""
    return F.round(sf * (1 + percent / 100), 1)


def largest_per_key(rows: DataFrame, key: str, value: str, *more: str) -> DataFrame:
    """The row of each key with the largest value."""
    return rows.groupBy(key).agg(F.max(value).alias(value), *[F.max_by(c, F.struct(value, c)).alias(c) for c in more])


def having_sum(groups: DataFrame, value: str, least: float) -> DataFrame:
    """A15, A16."""
    return groups.filter(F.col(value) >= least)


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int, into: str = "rank") -> DataFrame:
    """The first n of each group; Catalyst keeps n rows a task and group before the shuffle."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(into) <= n)


def over_read(zones: DataFrame, page: str, net: str, expected: str, factor: float = 1.4) -> DataFrame:
    """Pages whose zones exceed the facade that is expected."""
    return zones.groupBy(page).agg(total(net).alias("net_sf"), F.max(expected).alias("expected_sf")).filter(F.col("net_sf") > factor * F.col("expected_sf"))


def size_ratio_flags(pieces: DataFrame, page: str, area: str) -> DataFrame:
    """Page sanity: at least four pieces with one over three upper medians and 1500, or over 40000 in all."""
    from ..functions.folds import upper_median

    g = pieces.groupBy(page).agg(F.collect_list(area).alias("__a"), total(area).alias("page_sf"), F.max(area).alias("largest"), F.count(F.lit(1)).alias("pieces"))
    g = g.withColumn("median", upper_median(F.col("__a"))).drop("__a")
    return g.withColumn("flagged", ((F.col("pieces") >= 4) & (F.col("largest") > 3 * F.col("median")) & (F.col("largest") > 1500)) | (F.col("page_sf") > 40000))


def union_all(*tables: DataFrame) -> DataFrame:
    """U1."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


# Fixed value: what is drawn as a filled wall comes before all other readings.
FIRST_FAMILY = "Panel wall"


def global_total(zones: DataFrame, net: str) -> DataFrame:
    """One row, the sum of all booked zones."""
    return zones.agg(total(net).alias("total_sf"), F.count(F.lit(1)).alias("zones"))


def family_first(pieces: DataFrame, keys: list[str], material: str, area: str, *ties: str) -> DataFrame:
    """T4: pieces with their place: filled walls first, then the largest."""
    order = [F.when(F.startswith(F.col(material), F.lit(FIRST_FAMILY)), 0).otherwise(1), F.desc(area), *ties]
    return pieces.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
