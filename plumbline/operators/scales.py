"""Scale from dimension strings and level marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import on_rung
from ..sources.folder import keep

# Points between elevations, least rise of a pair, width of a group of slopes, least agreement, and plausible scales.
ELEVATION_GAP, LEAST_RISE, SLOPE_SHARE, AGREEMENT, FEET_PER_INCH = 250.0, 8.0, 0.06, 0.94, (0.5, 40)


def consensus(votes: DataFrame, keys: list[str], tolerance: float = 0.03) -> DataFrame:
    """Votes has (keys, id, ft_per_pt), several candidates a dimension. Each candidate is an anchor; a dimension
    supports it if one of its own lies within 3%. The anchor with most support wins with at least 4 and 35% of the
    dimensions, unless a rival more than 6% away is nearly as strong and has at least 1.6 times as many dimensions that reach it
    alone; then the rival wins if it has three of them, and nothing does if neither side leads.

    Dimensions with the same candidates are one row with their number: ids go no further than that, and votes that are dealt by keys already are not
    moved for it. Anchors and candidates of one page meet by bands of the logarithm, so the join is an equi join."""
    import math

    sets = votes.groupBy(*keys, "id").agg(F.array_sort(F.collect_set("ft_per_pt")).alias("__s"))
    sets = keep(sets.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__c"), F.count("id").alias("__d")), "votes")
    band = -math.log1p(-tolerance) * 1.01  # the low side is the wider one
    b = F.floor(F.log("ft_per_pt") / band).cast("bigint")
    anchors = sets.select(*keys, F.explode("__s").alias("a")).distinct().withColumn("__b", F.explode(F.sequence(F.floor(F.log("a") / band).cast("bigint") - 1, F.floor(F.log("a") / band).cast("bigint") + 1)))
    pairs = anchors.join(sets.select(*keys, "__s", "__c", F.explode("__s").alias("ft_per_pt")).withColumn("__b", b), [*keys, "__b"]).filter(F.abs(F.col("ft_per_pt") - F.col("a")) / F.col("a") <= tolerance)
    reach = pairs.groupBy(*keys, "a", "__s").agg(F.min_by("ft_per_pt", F.struct(F.abs(F.col("ft_per_pt") - F.col("a")), "ft_per_pt")).alias("v"), F.first("__c").alias("__c"))
    support = reach.groupBy(*keys, "a").agg(F.sum("__c").alias("n"))
    total = sets.groupBy(*keys).agg(F.sum("__d").alias("dims"))
    best = support.groupBy(*keys).agg(F.min_by(F.struct("a", "n"), F.struct(-F.col("n"), F.col("a"))).alias("b")).select(*keys, F.col("b.a").alias("best"), F.col("b.n").alias("best_n"))
    best = best.join(total, keys).filter((F.col("dims") >= 3) & (F.col("best_n") >= 4) & (F.col("best_n") >= 0.35 * F.col("dims")))
    rival = support.join(best, keys).filter(F.abs(F.col("a") - F.col("best")) / F.col("best") > 0.06)
    rival = rival.groupBy(*keys).agg(F.min_by(F.struct("a", "n"), F.struct(-F.col("n"), F.col("a"))).alias("r")).select(*keys, F.col("r.a").alias("rival"), F.col("r.n").alias("rival_n"))
    both = best.join(rival, keys, "left")
    flags = reach.join(both, keys).groupBy(*keys, "__s").agg(F.bool_or(F.col("a") == F.col("best")).alias("p"), F.coalesce(F.bool_or(F.col("a") == F.col("rival")), F.lit(False)).alias("q"), F.first("__c").alias("__c"))
    dims = lambda of: F.sum(F.when(of, F.col("__c")).otherwise(0))
    alone = flags.groupBy(*keys).agg(dims(F.col("p") & ~F.col("q")).alias("own"), dims(F.col("q") & ~F.col("p")).alias("other"))
    j = both.join(alone, keys)
    close = F.coalesce(F.col("rival_n") * 1.6 > F.col("best_n"), F.lit(False))
    win = F.when(~close, F.col("best")).when((F.col("other") >= 3) & (F.col("other") >= 1.6 * F.col("own")), F.col("rival")).when((F.col("own") >= 3) & (F.col("own") >= 1.6 * F.col("other")), F.col("best"))
    chosen = j.select(*keys, win.alias("a")).filter("a is not null").join(reach, [*keys, "a"])
    w = Window.partitionBy(*keys)
    counts = chosen.groupBy(*keys, "v").agg(F.sum("__c").alias("__c"))
    ranked = counts.withColumns({"__to": F.sum("__c").over(w.orderBy("v")), "n": F.sum("__c").over(w)})
    middle = F.floor(F.col("n") / 2)
    return ranked.filter((F.col("__to") > middle) & (F.col("__to") - F.col("__c") <= middle)).select(*keys, F.col("v").alias("ft_per_pt"), F.col("n").alias("support"))


def two_frames(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """the first frame's answer, else the second's where the page is rotated and the answer is a standard scale."""
    s = second.filter(F.col("rotated") & on_rung(F.col("ft_per_pt") * 72)).select(*keys, F.col("ft_per_pt").alias("__s"))
    return first.select(*keys, "ft_per_pt").join(s, keys, "full_outer").select(*keys, F.coalesce("ft_per_pt", "__s").alias("ft_per_pt"))


def scale_from_levels(levels: DataFrame, page: str, y: str, feet: str) -> DataFrame:
    """(page, ft_per_pt, quality, marks). Distinct level marks (y down the page, feet) fall into elevations where their heights are
    over 250 points apart. In each, slopes of all pairs 8 points or more apart that fall down the page; the largest group of slopes
    within 6% of one of them, the steepest first, gives its median where it has two at least. The page's scale is the median of
    its elevations, within 0.5 to 40 feet an inch; elevations must agree to 0.94. A page has 40 marks at most, so pairs are formed within its arrays."""
    marks = levels.select(page, F.col(y).cast("double").alias("__y"), F.col(feet).cast("double").alias("__f")).distinct()
    new = F.when(F.col("__y") - F.lag("__y").over(Window.partitionBy(page).orderBy("__y", "__f")) > ELEVATION_GAP, 1).otherwise(0)
    order = Window.partitionBy(page).orderBy("__y", "__f").rowsBetween(Window.unboundedPreceding, 0)
    own = marks.withColumn("__n", new).withColumn("__e", F.sum("__n").over(order)).groupBy(page, "__e").agg(F.array_sort(F.collect_list(F.struct("__y", "__f"))).alias("m"))
    slope = lambda a, b: (b["__f"] - a["__f"]) / (b["__y"] - a["__y"])
    later = lambda a, i: F.filter(F.slice("m", i + 2, F.size("m")), lambda b: b["__y"] - a["__y"] >= LEAST_RISE)
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(later(a, i), lambda b: slope(a, b))))
    own = own.withColumn("s", F.array_sort(F.filter(pairs, lambda s: s < 0))).filter(F.size("s") >= 2)
    near = lambda p: F.filter("s", lambda s: F.abs(s - p) <= SLOPE_SHARE * F.abs(p))
    own = own.withColumn("k", F.transform("s", lambda p: F.size(near(p))))
    own = own.withColumn("g", near(F.get("s", (F.array_position("k", F.array_max("k")) - 1).cast("int")))).filter(F.size("g") >= 2)
    middle = (F.get("g", F.floor((F.size("g") - 1) / 2).cast("int")) + F.get("g", F.floor(F.size("g") / 2).cast("int"))) / 2
    fits = own.select(page, middle.alias("s"), F.size("m").alias("marks"))
    out = fits.groupBy(page).agg(F.abs(F.median("s")).alias("ft_per_pt"), (F.max("s") - F.min("s")).alias("spread"), F.sum("marks").alias("marks"), F.count(F.lit(1)).alias("n"))
    quality = 1 - F.least(F.lit(1.0), F.col("spread") / F.col("ft_per_pt"))
    fit = (F.col("ft_per_pt") * 72).between(*FEET_PER_INCH) & ((F.col("n") == 1) | (quality >= AGREEMENT))
    return out.filter(fit).select(page, "ft_per_pt", F.round(quality, 4).alias("quality"), "marks")
