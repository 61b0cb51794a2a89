"""What leaves the engine (S19-S22, A12, A13, F14): bids, evidence summaries, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import safe_cell
from ..functions.rules import has
from .rollup import with_total


def bid_lines(pages: DataFrame, material: str, sf: str, rates: DataFrame) -> DataFrame:
    """Quantity is the sum of whole square feet of the pages above zero; amount = quantity x conversion x rate.
    rates: material, rate, conv."""
    q = pages.filter(F.col(sf) > 0).groupBy(material).agg(F.sum(F.bround(sf, 0).cast("bigint")).alias("qty"), F.concat(F.lit("="), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.bround(sf, 0).cast("bigint").alias("v")))), lambda s: s["v"].cast("string")), "+")).alias("formula"))
    return q.join(rates, material).withColumn("amount", (F.col("qty") * F.col("conv").cast("decimal(12,4)") * F.col("rate").cast("decimal(12,4)")).cast("decimal(18,2)").cast("double"))


def proposal_quantity(pages: DataFrame, material: str, sf: str) -> DataFrame:
    """The proposal rounds the sum, not the pages."""
    return pages.filter(F.col(sf) > 0).groupBy(material).agg(F.bround(F.sum(F.col(sf).cast("decimal(18,2)")), 0).cast("bigint").alias("qty"))


def chosen_materials(zones: DataFrame, name: str, category: str, words: list[str]) -> DataFrame:
    """zones whose name or category holds one of the words; all, if none does. The test for none is one aggregate row."""
    if not words:
        return zones
    text = F.lower(F.concat_ws(" ", name, category))
    hit = has(text, *[w.lower() for w in words])
    some = zones.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("__any"))
    return zones.join(F.broadcast(some), F.lit(True), "left").filter(~F.col("__any") | hit).drop("__any")


def takeoff_csv(zones: DataFrame, path: str, label: str, sums: list[str]) -> None:
    """One file with a header, the rows in order and a total; texts that a sheet would read as formulas are guarded."""
    rows = with_total(zones, label, sums).withColumn(label, safe_cell(F.col(label)))
    rows.orderBy(F.col(label) == "TOTAL", label).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def adjusted_legend(zones: DataFrame, page: str, label: str, sf: str, percent: float = 15) -> DataFrame:
    """A page's legend with the adjusted total."""
    s = F.sum(F.col(sf).cast("decimal(18,2)"))
    return zones.groupBy(page, label).agg(s.cast("double").alias("net_sf"), F.round(s * F.lit(100 + percent) / 100, 1).cast("double").alias("adjusted_sf"))
