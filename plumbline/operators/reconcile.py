"""Declared against found, sanity ratios, checks and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import flag_of, scope_family

# Limits of the sanity ratios.
LIMITS = {
    "R1_job_total_sf": (150, 100_000),
    "R2_page_sf_max": 40_000,
    "R2_page_sf_min_nonzero": 50,
    "R3_single_poly_sf_max": 20_000,
    "R3_page_mean_poly_max": 5_000,
    "R4_dominance_share": 0.85,
    "R4_dominance_min_walls": 5,
    "R5_soffit_share_max": 0.35,
    "R5_unassigned_nonbfs_share_max": 0.25,
}


def declared(sources: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """U4: sources in order of trust; the first that has a key gives it, later ones fill what is missing."""
    rows = None
    for k, s in enumerate(sources):
        own = s.select(*keys, *values).withColumn("__s", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col("__s"), F.col(c)))).alias(c)
    return rows.groupBy(*keys).agg(F.min("__s").alias("source"), *[first(c) for c in values])


def unmatched(left: DataFrame, right: DataFrame, tokens: str, family: str, key: str) -> DataFrame:
    """Rows of the left that share neither a code token nor a (real) family with any row of the right.
    Two equi anti joins; no row meets all others."""
    by_token = left.select(key, F.explode(tokens).alias("__t")).join(right.select(F.explode(tokens).alias("__t")).distinct(), "__t", "left_semi").select(key).distinct()
    real = lambda d: d.filter(~F.col(family).isin("unassigned", "junk-name"))
    by_family = real(left).join(real(right).select(family).distinct(), family, "left_semi").select(key).distinct()
    return left.join(by_token, key, "left_anti").join(by_family, key, "left_anti")


def stated_but_missing(missing: DataFrame, sf: str, name: str, least: float = 100) -> DataFrame:
    """F32."""
    return missing.filter((F.col(sf) >= least) & (scope_family(F.col(name)) != "non-bfs"))


def first_copies(rows: DataFrame, content: Column, order: list[str]) -> DataFrame:
    """Rows with a flag that an earlier row has the same content; null content is never a copy. The first of each
    content is an aggregate, so a hot content combines before the shuffle."""
    keyed = rows.withColumn("__k", content)
    firsts = keyed.filter("__k is not null").groupBy("__k").agg(F.min(F.struct(*order)).alias("__f"))
    return keyed.join(firsts, "__k", "left").withColumn("is_copy", F.coalesce(F.struct(*order) > F.col("__f"), F.lit(False))).drop("__k", "__f")


def letters_key(text: Column, n: int = 12) -> Column:
    """Letters alone, lower-cased, the first n."""
    return F.left(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), F.lit(n))


def outline_key(points: Column, places: int = 3) -> Column:
    """A polygon by its rounded vertices, wherever it starts."""
    return F.to_json(F.array_sort(F.transform(points, lambda p: F.struct(F.round(p["x"], places).alias("x"), F.round(p["y"], places).alias("y")))))


def failed_ratios(pieces: DataFrame, job: str, page: str, area: str, soffit: Column, unassigned: Column) -> DataFrame:
    """(job, page or null, ratio, value, threshold) of each limit that is broken. Two aggregations of the pieces, the
    page's and the job's, and one unpivot each."""
    m = F.sum(F.col(area).cast("decimal(18,2)"))
    pages = pieces.groupBy(job, page).agg(m.cast("double").alias("sf"), F.max(area).alias("largest"), F.count(F.lit(1)).alias("n"))
    jobs = pieces.groupBy(job).agg(m.cast("double").alias("sf"), F.max(area).alias("largest"), F.count(F.lit(1)).alias("n"), F.sum(F.when(soffit, F.col(area).cast("decimal(18,2)"))).cast("double").alias("soffit"), F.sum(F.when(unassigned, F.col(area).cast("decimal(18,2)"))).cast("double").alias("unassigned"))
    test = lambda name, holds, value, limit: F.when(holds, F.struct(F.lit(name).alias("ratio"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold")))
    low, high = LIMITS["R1_job_total_sf"]
    sf, mean, share = F.col("sf"), F.col("sf") / F.col("n"), F.col("largest") / F.col("sf")
    of_page = F.array(
        test("R2_page_sf_max", sf > LIMITS["R2_page_sf_max"], sf, LIMITS["R2_page_sf_max"]),
        test("R2_page_sf_min_nonzero", (sf > 0) & (sf < LIMITS["R2_page_sf_min_nonzero"]), sf, LIMITS["R2_page_sf_min_nonzero"]),
        test("R3_single_poly_sf_max", F.col("largest") > LIMITS["R3_single_poly_sf_max"], F.col("largest"), LIMITS["R3_single_poly_sf_max"]),
        test("R3_page_mean_poly_max", mean > LIMITS["R3_page_mean_poly_max"], F.round(mean, 1), LIMITS["R3_page_mean_poly_max"]),
    )
    of_job = F.array(
        test("R1_job_total_sf", (sf > 0) & (sf < low), sf, low), test("R1_job_total_sf", sf > high, sf, high),
        test("R4_dominance_share", (F.col("n") >= LIMITS["R4_dominance_min_walls"]) & (share > LIMITS["R4_dominance_share"]), F.round(share, 3), LIMITS["R4_dominance_share"]),
        test("R5_soffit_share_max", F.col("soffit") / sf > LIMITS["R5_soffit_share_max"], F.round(F.col("soffit") / sf, 3), LIMITS["R5_soffit_share_max"]),
        test("R5_unassigned_nonbfs_share_max", F.col("unassigned") / sf > LIMITS["R5_unassigned_nonbfs_share_max"], F.round(F.col("unassigned") / sf, 3), LIMITS["R5_unassigned_nonbfs_share_max"]),
    )
    a = pages.select(job, F.col(page).alias("page"), F.explode(F.array_compact(of_page)).alias("r")).select(job, "page", "r.*")
    b = jobs.select(job, F.lit(None).cast(pages.schema[page].dataType).alias("page"), F.explode(F.array_compact(of_job)).alias("r")).select(job, "page", "r.*")
    return a.unionByName(b)


def classified_flags(flags: DataFrame, text: str) -> DataFrame:
    """Distinct flags with code, severity and scope."""
    return flags.withColumn("f", flag_of(F.col(text))).filter(F.col("f").isNotNull()).select(*flags.columns, "f.*").distinct()


def sentinel_counts(pages: DataFrame, job: str, found: str) -> DataFrame:
    """Pages with each convention."""
    return pages.select(job, F.explode(found).alias("sentinel")).groupBy(job, "sentinel").agg(F.count(F.lit(1)).alias("pages"))


def status(rows: DataFrame, key: str, outcome: str) -> DataFrame:
    """Fail outranks unavailable, which outranks pass."""
    o = F.col(outcome)
    return rows.groupBy(key).agg(F.when(F.bool_or(o == "fail"), "fail").when(F.bool_or(o == "unavailable"), "unavailable").otherwise("pass").alias("status"))


def verdict(checks: DataFrame, lists: DataFrame, flags: DataFrame, job: str, most: int = 60) -> DataFrame:
    """Verified only if every check passes, no list has entries and no flag is critical."""
    c = checks.groupBy(job).agg(F.bool_and(F.col("status") == "pass").alias("__c"), F.array_sort(F.collect_set(F.when(F.col("status") != "pass", F.concat("check", F.lit(": "), "status")))).alias("__cr"))
    li = lists.groupBy(job).agg(F.count(F.lit(1)).alias("__l"), F.array_sort(F.collect_set("reason")).alias("__lr"))
    fl = flags.filter("severity = 'critical'").groupBy(job).agg(F.count(F.lit(1)).alias("__f"), F.array_sort(F.collect_set("code")).alias("__fr"))
    j = c.join(li, job, "left").join(fl, job, "left")
    none = F.array().cast("array<string>")
    ok = F.col("__c") & (F.coalesce("__l", F.lit(0)) == 0) & (F.coalesce("__f", F.lit(0)) == 0)
    reasons = F.slice(F.array_distinct(F.concat(*[F.coalesce(F.col(x), none) for x in ("__cr", "__lr", "__fr")])), 1, most)
    return j.select(job, F.when(ok, "verified").otherwise("unverified").alias("verdict"), reasons.alias("reasons"))


def scheme_gate(sheets: DataFrame, doc: str, page: str, letters: str, form: str, conf: str, least: int = 4, cap: float = 0.59) -> DataFrame:
    """A sheet whose family no other page of a document with at least four others has is capped below binding."""
    w = Window.partitionBy(doc)
    others, same = F.count(F.lit(1)).over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(doc, letters, form)) - 1
    gated = (others >= least) & (same == 0)
    return sheets.withColumn("scheme_mismatch", gated).withColumn(conf, F.when(F.col("scheme_mismatch"), F.least(F.col(conf), F.lit(cap))).otherwise(F.col(conf)))


def not_in(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Anti join."""
    return rows.join(other.select(*on).distinct(), on, "left_anti")


def flags_on_pages(flags: DataFrame, pages: DataFrame, job: str, page: str, text: str) -> DataFrame:
    """A flag stands on its page, or on the job's list where the page has no entry; once each."""
    j = flags.select(job, page, text).distinct().join(pages.select(job, page, F.lit(True).alias("__p")), [job, page], "left")
    return j.withColumn("on", F.when(F.col("__p"), "page").otherwise("job")).drop("__p")


def story_table(levels: DataFrame, page: str, label: str, feet: str) -> DataFrame:
    """Distinct levels, and the height between the highest roof and the lowest grade."""
    up, low = F.upper(label), F.col(feet)
    roof, grade = up.rlike("ROOF|PARAPET"), up.rlike("GRADE")
    return levels.groupBy(page).agg(F.countDistinct(label, feet).alias("levels"), (F.max(F.when(roof, low)) - F.min(F.when(grade, low))).alias("height_ft"))


def sheet_pages(matches: DataFrame, pages: DataFrame, sheet: str, kind: str, page: str) -> DataFrame:
    """The pages of each kind, in order, of the sheets that the matches (sheet, kind) name."""
    return matches.select(sheet, kind).distinct().join(pages.select(sheet, page), sheet).groupBy(kind).agg(F.array_sort(F.collect_set(page)).alias("pages"))
