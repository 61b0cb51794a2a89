"""Review order by measured risk (A37, J5, T1, W7, X8) and scoring against marked walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import latest_per_key

# The measured risk of each reader class (walls, booked too high, rate %, upper bound %).
RISK = [
    ("multi", 70, 43, 61.4, 72.0),
    ("v13", 878, 450, 51.3, 54.5),
    ("train", 248, 94, 37.9, 44.1),
    ("fill", 38, 8, 21.1, 36.3),
    ("flood", 102, 24, 23.5, 32.6),
    ("band", 20, 2, 10.0, 30.1),
    ("color", 136, 29, 21.3, 28.9),
    ("hatch", 23, 2, 8.7, 26.8),
    ("rc", 223, 29, 13.0, 18.1),
]


def risk_table(spark: SparkSession) -> DataFrame:
    """The table with each class's place, riskiest first. Nine rows."""
    rows = [(c, n, w, r, u, k + 1) for k, (c, n, w, r, u) in enumerate(sorted(RISK, key=lambda x: (-x[4], x[0])))]
    return spark.createDataFrame(rows, "class string, walls int, wrong_high int, rate double, upper double, risk_rank int")


def wilson_upper(wrong: Column, n: Column, z: float = 1.96) -> Column:
    """Upper bound in percent."""
    p = wrong / n
    return 100 * (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def review_rank(cls: Column, rank: Column) -> Column:
    """Classes without a measurement come first, markup last."""
    return F.when(cls == "markup", len(RISK) + 1).otherwise(F.coalesce(rank, F.lit(0)))


def review_queue(zones: DataFrame, cls: str, sf: str, *ties: str) -> DataFrame:
    """Riskiest class first, then the largest area; every zone stays."""
    ranked = zones.join(F.broadcast(risk_table(zones.sparkSession)), F.col(cls) == F.col("class"), "left").drop("class")
    return ranked.withColumn("review_rank", review_rank(F.col(cls), F.col("risk_rank"))).drop("risk_rank").orderBy("review_rank", F.desc(F.coalesce(F.col(sf), F.lit(0))), *ties)


# What the queue tells the reviewer.
WHY_MEASURED = "this reader booked more SF than the wall on %d of %d benchmark walls (%.0f%%)"
WHY_MARKUP = "your own marked polygon — exact by geometry, nothing to re-measure"
WHY_UNMEASURED = "this reader has no corpus measurement — review it before the graded ones"


def why(cls: Column, wrong: Column, walls: Column, rate: Column) -> Column:
    """X8."""
    return F.when(cls == "markup", WHY_MARKUP).when(walls.isNull(), WHY_UNMEASURED).otherwise(F.format_string(WHY_MEASURED, wrong, walls, rate))


def agreement_percent(auto: Column, final: Column) -> Column:
    """100 min / max, the divisor 1 at least, as a whole percent; null where nothing is final."""
    return F.when(final > 0, F.bround(100 * (F.least(auto, final) / F.greatest(auto, final, F.lit(1.0))), 0))


def autonomy(finals: DataFrame, autos: DataFrame, job: str, final: str, auto: str, order: list[str] | None = None) -> DataFrame:
    """Mean agreement, a whole percent, over jobs whose latest final (by order, where it is given) is above zero."""
    latest = finals if order is None else latest_per_key(finals, [job], order).drop("hits")
    j = latest.join(autos, job).filter(F.col(final) > 0)
    return j.agg(F.count(F.lit(1)).alias("jobs"), F.bround(F.avg(agreement_percent(F.col(auto), F.col(final))), 0).alias("autonomy"))


def bench_scores(results: DataFrame, gold: str, got: str, cover: str) -> DataFrame:
    """Walls found (cover 0.3), covered (0.7) and right in money (0.7, and within 15%)."""
    right = (F.col(cover) >= 0.7) & (F.abs(F.col(got) - F.col(gold)) <= 0.15 * F.col(gold))
    return results.agg(F.count(F.lit(1)).alias("walls"), F.count_if(F.col(cover) >= 0.3).alias("found"), F.count_if(F.col(cover) >= 0.7).alias("covered"), F.count_if(right).alias("money_right"))


def page_compare(walls: DataFrame, keys: list[str], gold: str, got: str, cover: str) -> DataFrame:
    """Per page the marked and the measured sum, and how many walls are found and right in money."""
    right = (F.col(cover) >= 0.7) & (F.abs(F.col(got) - F.col(gold)) <= 0.15 * F.col(gold))
    whole = lambda c: F.round(F.sum(F.col(c).cast("decimal(18,2)")), 1).cast("double")
    return walls.groupBy(*keys).agg(whole(gold).alias("his_total"), whole(got).alias("our_total"), F.count_if(F.col(cover) >= 0.3).alias("found"), F.count_if(right).alias("money_right"))


def convention_flags(pieces: DataFrame, area: str, suggest: str, holes: str) -> DataFrame:
    """Large auto pieces without openings, with the share of such walls that are booked net."""
    open_ = (~F.coalesce(F.col(suggest), F.lit(False))) & (F.coalesce(F.size(holes), F.lit(0)) == 0) & (F.col(area) >= 400)
    band = F.when(F.col(area) < 1200, F.struct(F.lit("400-1,200 SF").alias("band"), F.lit(72).alias("books_net"))).otherwise(F.struct(F.lit("1,200+ SF").alias("band"), F.lit(75).alias("books_net")))
    return pieces.filter(open_).withColumn("convention", band)


def convention_rollup(flagged: DataFrame, area: str) -> DataFrame:
    gross = F.sum(F.col(area).cast("decimal(18,2)"))
    return flagged.agg(F.count(F.lit(1)).alias("walls"), gross.cast("double").alias("gross_sf"), F.round(gross * F.lit(7) / 100, 0).cast("double").alias("p25_sf"), F.round(gross * F.lit(25) / 100, 0).cast("double").alias("p75_sf"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One digest of all numbers, whatever the order of rows; equal before and after what must change nothing."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("sum_hash"), F.bit_xor(F.xxhash64(*columns)).alias("xor_hash"))
