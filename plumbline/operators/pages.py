"""Page predicates and scale guards (F4-F12, F28, F31, F33, A47, A48, J35, A20 label outliers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import first_match, has

# Phrases of sheet titles.
SITE = ["SITE PLAN", "LANDSCAPE PLAN", "GRADING PLAN", "UTILITY PLAN", "PAVING PLAN", "DRAINAGE PLAN", "EROSION CONTROL", "LIMIT OF WORK", "PLANTING PLAN", "CIVIL SITE"]
WALLS = ["SIDING", "BRICK", "MASON", "EIFS", "STUCCO", "METAL PANEL", "MTL PANEL", "FIBER CEMENT", "HARDIE", "NICHIHA", "CMU", "VENEER", "CURTAIN WALL", "STOREFRONT", "SPANDREL", "CLADDING", "WALL TYPE", "MATERIAL LEGEND", "MATERIAL SCHEDULE", "ALUCOBOND", "CLAPBOARD", "SHINGLE", "SHAKE", "PRECAST"]
VIEWS_3D = ["AXONOMETRIC", "AXONOMETRICS", "ISOMETRIC", "PERSPECTIVE", "3D VIEW", "3-D VIEW", "3D MASSING", "MASSING MODEL", "MASSING DIAGRAM", "MASSING STUDY", "AERIAL VIEW", "AERIAL PERSPECTIVE", "BIRD'S EYE", "BIRDS EYE", "BIRD'S-EYE", "EYE VIEW", "RENDERING", "RENDERINGS", "RENDERED VIEW", "EXTERIOR RENDERING", "3D RENDERING", "PHOTOREALISTIC", "MASSING"]
ELEVATION_TITLE = r"\b(north|south|east|west|front|rear|left|right|side|partial|overall|exterior|building)\s+[\w\s]{0,18}elevation"
ELEVATION_TITLE_3D = r"\b(north|south|east|west|front|rear|left|right|side|partial|overall|exterior|building|typ(?:ical)?)\s+[\w\s]{0,18}elevation"
PLAN_TITLE = r"\b((FIRST|SECOND|THIRD|GROUND|\d+(ST|ND|RD|TH))\s+)?(FLOOR|ROOF)\s+PLAN\b"
PLANS, ELEVATIONS = ["roof plan", "floor plan"], ["elevation", "return", "soffit"]
NOT_A_TITLE, SERIES_400 = r"\b(SEE|REFER|PER|FOR|TYP)\b|\bINTERIOR\b", r"^A-?4(\d|\.)"


def elevation_page(text: Column, levels: Column, long_lines: Column, by_ocr: Column | None = None) -> Column:
    """an elevation title; else not a plan; else the words; else a bare page with levels and long lines; else the OCR's word."""
    t = F.lower(F.coalesce(text, F.lit("")))
    ocr = F.coalesce(by_ocr, F.lit(False)) if by_ocr is not None else F.lit(False)
    return first_match([(t.rlike(ELEVATION_TITLE), True), (has(t, *PLANS), ocr), (has(t, *ELEVATIONS), True), ((F.length(t) < 60) & (levels >= 3) & (long_lines >= 3), True)], ocr)


def site_sheet(text: Column) -> Column:
    """F5."""
    u = F.upper(F.coalesce(text, F.lit("")))
    return has(u, *SITE) & ~has(u, *WALLS)


def view_3d_sheet(text: Column) -> Column:
    """F6."""
    return has(F.upper(F.coalesce(text, F.lit(""))), *VIEWS_3D) & ~F.lower(F.coalesce(text, F.lit(""))).rlike(ELEVATION_TITLE_3D)


def plan_page(title: Column) -> Column:
    """F28."""
    return F.upper(F.coalesce(title, F.lit(""))).rlike(PLAN_TITLE)


def scale_guard(scale: Column, confirmed: Column, text: Column, site_cut: float = 100, blind_cut: float = 9) -> Column:
    """one action: drop, demote, or keep."""
    c = F.coalesce(confirmed, F.lit(False))
    return first_match([(c & (scale >= site_cut), "drop"), (~c & (scale >= site_cut), "demote"), (c & (scale >= blind_cut) & site_sheet(text), "demote"), (view_3d_sheet(text), "demote")], "keep")


def size_outlier(share: Column, reader: Column, demoted: Column, most: float = 0.5) -> Column:
    """F8."""
    return (share > most) & ~F.coalesce(reader, F.lit("")).isin("v13", "markup") & ~F.coalesce(demoted, F.lit(False))


def segment_stats(segments: DataFrame, page: str, width: str) -> DataFrame:
    """too many segments to read, and pages dense with hairlines."""
    n, hair = F.count(F.lit(1)), F.count_if(F.col(width) <= 0.6)
    return segments.groupBy(page).agg(n.alias("segments"), (n > 250_000).alias("too_dense"), ((n >= 40_000) & (hair >= 0.8 * n)).alias("dense"))


def text_reliable(pages: DataFrame, text: str) -> DataFrame:
    """enough pages carry text."""
    return pages.agg((F.count_if(F.length(text) > 150) >= F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) * 0.3))).alias("text_reliable"))


def admission(title: Column, sheet: Column) -> Column:
    """struct<admit, reason>."""
    pair = lambda a, r: F.struct(F.lit(a).alias("admit"), F.lit(r).alias("reason"))
    u = F.upper(F.coalesce(title, F.lit("")))
    return first_match([(has(u, "ELEVATION") & ~u.rlike(NOT_A_TITLE), pair(True, "title")), (F.coalesce(sheet, F.lit("")).rlike(SERIES_400), pair(True, "series"))], pair(False, "none"))


def in_title_block(x: Column, y: Column, width: Column, height: Column) -> Column:
    """right 18% and bottom 20% of the page."""
    return (x >= 0.82 * width) & (y >= 0.80 * height)


def resolved_scale(*ways: Column, default: float = 8.0) -> Column:
    """The first way that found a struct<value, confirmed, source>; else the default, unconfirmed."""
    last = F.struct(F.lit(default).alias("value"), F.lit(False).alias("confirmed"), F.lit("default").alias("source"))
    return F.coalesce(*ways, last)


def sibling_scale(pages: DataFrame, doc: str, size: list[str], scale: str, confident: str) -> DataFrame:
    """A page without a scale takes the one that all confident pages of its document and size agree on."""
    w = Window.partitionBy(doc, *size)
    own = F.when(F.coalesce(F.col(confident), F.lit(False)), F.round(F.col(scale), 4))
    agreed = F.when(F.min(own).over(w) == F.max(own).over(w), F.min(own).over(w))
    return pages.withColumn("inherited_scale", F.when(F.col(scale).isNull(), agreed))


def label_outliers(pieces: DataFrame, page: str, sf: str, area_pt2: str) -> DataFrame:
    """Labels whose implied scale is off the page's upper median by more than 32% up or 24% down, with the area it implies."""
    implied = 72 * F.sqrt(F.col(sf) / F.col(area_pt2))
    rows = pieces.filter((F.col(sf) > 0) & (F.col(area_pt2) > 0)).withColumn("implied", implied)
    w = Window.partitionBy(page)
    r = rows.withColumns({"__r": F.row_number().over(w.orderBy("implied")), "__n": F.count(F.lit(1)).over(w)})
    r = r.withColumn("median", F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 2) + 1, F.col("implied"))).over(w))
    ratio = F.col("implied") / F.col("median")
    return r.withColumn("label_outlier", (F.col("__n") >= 3) & ((ratio > 1.32) | (ratio < 0.76))).withColumn("implied_sf", F.col(sf) * F.pow(F.col("median") / F.col("implied"), F.lit(2))).drop("__r", "__n")
