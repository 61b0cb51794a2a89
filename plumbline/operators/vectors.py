"""Filters and joins over drawn vectors and read texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import loose_feet
from ..functions.rules import squeezed
from .spatial import box_join

# Vocabularies of callouts and of level marks, and the limits of the readers.
MATERIAL_WORDS = r"(?i)\b(panel|siding|lap|shake|shingle|brick|masonry|cmu|stucco|eifs|acm|metal|aluminum|alum|composite|fiber|cement|cementitious|hardie|azek|pvc|board\s*&?\s*batten|standing\s*seam|metl[-\s]?span|kingspan|soffit|fascia|trim|veneer|cladding|wall\s*system)\b"
NOISE_WORDS = r"(?i)\b(scale|elevation\s*$|sheet|drawn|date|revision|note[s]?:|typ\.?$|see\s+(detail|spec|struct)|contractor|install|provide|existing\s+to\s+remain)\b"
NO_CLADDING = r"(?i)\b(glass|glazing|window|door|louver|vent|hose\s*bibb|meter|knox|sconce|light\s*pak|spandrel|parking|column\s*wrap|canopy)\b"
LEVEL_LABEL = r"(?i)\b(T\.?O\.?|B\.?O\.?|FIN|FLOOR|FLR|CEILING|ROOF|EAVE|RIDGE|PARAPET|GRADE|STEEL|WALL|FTG)\b"
LEVEL_VALUE = r"(\d{1,3})'\s*-?\s*(\d{1,2})?"
LEAST_LINE, LEADER, ANCHOR, MOST_LEADERS, MOST_BLOCKS, MOST_CORNERS, MOST_LEVELS = 18.0, (25.0, 600.0), 20.0, 4000, 80, 4000, 40


def vector_pages(drawings: DataFrame, keys: list[str]) -> DataFrame:
    """pages with more than five drawings whose box is over 1000 square points."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return drawings.groupBy(*keys).agg((F.count_if(area > 1000) > 5).alias("vector_page"))


def markup_jobs(annotations: DataFrame, job: str) -> DataFrame:
    """a job has markup when any annotation is a polygon of three vertices, or a polyline whose text holds a length."""
    polygon = (F.col("kind") == 6) & (F.size("vertices") >= 3)
    line = (F.col("kind") == 7) & (loose_feet(F.col("content")) > 0)
    return annotations.groupBy(job).agg(F.bool_or(F.coalesce(polygon | line, F.lit(False))).alias("has_markup"))


def not_sprawling(pieces: DataFrame, outline: str, width: Column, height: Column, share: float = 0.55) -> DataFrame:
    """a piece that spans more than 0.55 of the page both ways is no wall."""
    xs, ys = F.transform(outline, lambda p: p["x"]), F.transform(outline, lambda p: p["y"])
    return pieces.filter(~((F.array_max(xs) - F.array_min(xs) > share * width) & (F.array_max(ys) - F.array_min(ys) > share * height)))


def callout_blocks(blocks: DataFrame, keys: list[str], text: str, order: str, most: int = MOST_BLOCKS) -> DataFrame:
    """text blocks of 3 to 90 characters that name a material and neither noise nor something else; the first 80 of a page."""
    t = squeezed(F.col(text))
    kept = blocks.withColumn(text, t).filter(F.length(text).between(3, 90) & F.col(text).rlike(MATERIAL_WORDS) & ~F.col(text).rlike(NOISE_WORDS) & ~F.col(text).rlike(NO_CLADDING))
    return kept.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__r") <= most).drop("__r")


def light_fill(fill: Column, area: Column, page_area: Column) -> Column:
    """a light, nearly neutral grey over 0.12% of the page or more."""
    r, g, b = (F.get(fill, F.lit(k)) for k in range(3))
    return F.coalesce(r.between(0.80, 0.97) & (F.abs(r - g) < 0.04) & (F.abs(g - b) < 0.04) & (area >= 0.0012 * page_area), F.lit(False))


def clip_regions(clips: DataFrame, page_area: Column, ft_per_pt: Column) -> DataFrame:
    """clips of 40 points both ways, up to 0.55 of the page and 40 square feet at least, with area_sf."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    sf = w * h * ft_per_pt * ft_per_pt
    return clips.filter((w >= 40) & (h >= 40) & (w * h <= 0.55 * page_area) & (sf >= 40)).withColumn("area_sf", F.round(sf, 1))


def leaders(segments: DataFrame, blocks: DataFrame, keys: list[str], order: str, box: str, size: float = 100.0, most: int | None = MOST_LEADERS) -> DataFrame:
    """segments (x1, y1, x2, y2) of 25 to 600 points with an end within 20 points of a callout; the first 4000 of a page, or all."""
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    square = dx * dx + dy * dy
    own = segments.filter(square.between(LEADER[0] ** 2, LEADER[1] ** 2))
    ends = F.array(*[F.struct(F.col(f"x{k}").alias("x0"), F.col(f"y{k}").alias("y0"), F.col(f"x{k}").alias("x1"), F.col(f"y{k}").alias("y1")) for k in (1, 2)])
    probe = own.select(*keys, order, F.explode(ends).alias("__e"))
    near = box_join(probe, blocks.select(*keys, F.col(box).alias("__o")), keys, "__e", "__o", size, ANCHOR).select(*keys, order).distinct()
    kept = own.join(near, [*keys, order], "left_semi")
    if most is None:
        return kept
    return kept.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__r") <= most).drop("__r")


def straight(segments: DataFrame, least: float = LEAST_LINE, slack: float = 1.5) -> DataFrame:
    """Segments with axis (h or v), a0 and a1 along it, c across it and their length; others go."""
    dx, dy = F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))
    axis = F.when((dx >= least) & (dy <= slack), "h").when((dy >= least) & (dx <= slack), "v")
    pick = lambda h, v: F.when(F.col("axis") == "h", h).otherwise(v)
    own = segments.withColumn("axis", axis).filter("axis is not null")
    return own.withColumns({"a0": pick(F.least("x1", "x2"), F.least("y1", "y2")), "a1": pick(F.greatest("x1", "x2"), F.greatest("y1", "y2")), "c": pick((F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2), "length": pick(dx, dy)})


def crossings(lines: DataFrame, keys: list[str], order: str, slack: float = 2.0, size: float = 100.0, most: int | None = MOST_CORNERS) -> DataFrame:
    """(keys, h, v, x, y): where an upright line meets a level one within 2 points; the first 4000 of a page by line order, or all.
    lines: as of straight()."""
    h = lines.filter("axis = 'h'").select(*keys, F.col(order).alias("h"), F.col("c").alias("y"), F.struct((F.col("a0") - slack).alias("x0"), F.col("c").alias("y0"), (F.col("a1") + slack).alias("x1"), F.col("c").alias("y1")).alias("__h"))
    v = lines.filter("axis = 'v'").select(*keys, F.col(order).alias("v"), F.col("c").alias("x"), F.struct(F.col("c").alias("x0"), (F.col("a0") - slack).alias("y0"), F.col("c").alias("x1"), (F.col("a1") + slack).alias("y1")).alias("__v"))
    met = box_join(h, v, keys, "__h", "__v", size).select(*keys, "h", "v", "x", "y")
    if most is None:
        return met
    return met.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "v"))).filter(F.col("__r") <= most).drop("__r")


def level_marks(rows: DataFrame, keys: list[str], order: str, least: float = 0.55, high: float = 30.0, wide: float = 160.0, most: int = MOST_LEVELS) -> DataFrame:
    """(keys, order, y, ft, label) of read rows (x, y, text, conf) that hold a height up to 400 feet and have a label, their own or
    that of the first labelled row less than 30 points up or down and 160 across; the first 40 of a page. Rows meet by bands of y."""
    read = rows.filter(F.col("conf") >= least).withColumn("text", F.trim("text"))
    part = lambda k: F.regexp_extract("text", LEVEL_VALUE, k).try_cast("double")
    ft = part(1) + F.coalesce(part(2), F.lit(0.0)) / 12
    band = F.floor(F.col("y") / high).cast("bigint")
    values = read.filter(F.col("text").rlike(LEVEL_VALUE)).withColumn("ft", ft).filter(F.col("ft").between(0, 400))
    labels = read.filter(F.col("text").rlike(LEVEL_LABEL)).select(*keys, F.col(order).alias("__o"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("text").alias("__t"), band.alias("__b"))
    around = values.withColumn("__b", F.explode(F.array(band - 1, band, band + 1)))
    near = around.join(labels, [*keys, "__b"]).filter((F.col(order) != F.col("__o")) & (F.abs(F.col("y") - F.col("__y")) < high) & (F.abs(F.col("x") - F.col("__x")) < wide))
    first = near.groupBy(*keys, order).agg(F.min_by("__t", "__o").alias("__l"))
    label = F.when(F.col("text").rlike(LEVEL_LABEL), F.col("text")).otherwise(F.col("__l"))
    told = values.join(first, [*keys, order], "left").withColumn("label", F.left(label, F.lit(40))).filter("label is not null")
    ranked = told.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__r") <= most)
    return ranked.select(*keys, order, F.bround("y", 1).alias("y"), F.bround("ft", 2).alias("ft"), "label")
