"""Schedules and indexes read from placed words (S7-S10, A11, A14, J13, X20), and declared names (U4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import LEGEND_KEY, LOOSE_KEY, schedule_feet
from ..functions.rules import has

# A quantity, its unit, and what is measured by length and no wall.
SCHEDULE_NUMBER = r"^[\d,]+(?:\.\d+)?$"
SCHEDULE_UNIT = r"(?i)^(sf|sq|s\.?f\.?)$"
HEADER_WORDS = {"mark": ["MARK", "TYPE", "TAG", "ID", "NO"], "width": ["WIDTH", "WIDE", "'W", "W."], "height": ["HEIGHT", "HGT", "HEIG", "HIGH", "HT"], "qty": ["QTY", "QUANTITY", "COUNT"], "size": ["SIZE", "DIMENSION", "ROUGH OPENING", "R.O."]}
INDEX_HEADING = r"(SHEET\s+INDEX|DRAWING\s+INDEX|DRAWING\s+LIST|SHEET\s+LIST|LIST\s+OF\s+DRAWINGS)"
INDEX_SHEET = r"^A[A-Z]?\d{1,2}\.\d{1,2}[A-Z]?$"
LINEAR = r"(?i)\b(trim|railing|handrail|guardrail|watertable|decking|downspout|gutter|drip|flashing|coping)\b"


def rows_of_words(words: DataFrame, keys: list[str], y: str = "y", x: str = "x", text: str = "text", band: float = 4.0) -> DataFrame:
    """Words of a band of heights, left to right, as one row: (keys, row, words, line)."""
    g = words.groupBy(*keys, F.bround(F.col(y) / band).cast("int").alias("row")).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("t")))).alias("w"))
    return g.withColumn("words", F.transform("w", lambda v: v["t"])).withColumn("line", F.array_join("words", " ")).drop("w")


def material_schedule(rows: DataFrame, legend: DataFrame, keys: list[str], least: float = 50, least_rows: int = 2) -> DataFrame:
    """(keys, key, sf, material). In a row, a key, then a number as one of the next two words, then a unit; numbers of
    50 or more, the largest of each key; keys that the legend (keys, key, material) gives a wall material, two at least."""
    w = F.col("words")
    at = lambda i: F.get(w, i)

    def entry(i: Column) -> Column:
        j = F.when(at(i + 1).rlike(SCHEDULE_NUMBER), i + 1).when(at(i + 2).rlike(SCHEDULE_NUMBER), i + 2)
        sf = F.when(at(j + 1).rlike(SCHEDULE_UNIT), F.regexp_replace(at(j), ",", "").try_cast("double"))
        return F.struct(at(i).alias("key"), sf.alias("sf"))

    places = F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: at(i).rlike(LEGEND_KEY))
    each = rows.filter(F.size(w) >= 2).select(*keys, F.explode(F.transform(places, entry)).alias("e")).select(*keys, "e.*").filter(F.col("sf") >= least)
    best = each.groupBy(*keys, "key").agg(F.bround(F.max("sf"), 0).cast("bigint").alias("sf"))
    named = best.join(legend.select(*keys, "key", "material"), [*keys, "key"]).filter((F.col("material") != "") & ~F.col("material").rlike(LINEAR))
    enough = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least_rows).drop("__n")
    return named.join(enough, keys, "left_semi")


def loose_schedule(rows: DataFrame, legend: DataFrame, document: str, page: str, least: float = 50) -> DataFrame:
    """(document, key, sf, material). Each word of a row that is a loose key (with a digit or a dash) and is followed, as one of the next
    two words, by a number of `least` or more and a unit, declares an area; what the page's legend (document, page, key, material) calls a length does
    not. The largest of each key stands, with its page's material or none; one row is enough. rows: (document, page, row, words)."""
    w = F.col("words")
    at = lambda i: F.get(w, i)

    def entry(i: Column) -> Column:
        j = F.when(at(i + 1).rlike(SCHEDULE_NUMBER), i + 1).when(at(i + 2).rlike(SCHEDULE_NUMBER), i + 2)
        sf = F.when(at(j + 1).rlike(SCHEDULE_UNIT), F.regexp_replace(at(j), ",", "").try_cast("double"))
        return F.struct(at(i).alias("key"), i.alias("at"), sf.alias("sf"))

    places = F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: at(i).rlike(LOOSE_KEY) & at(i).rlike("[0-9-]"))
    each = rows.filter(F.size(w) >= 2).select(document, page, "row", F.explode(F.transform(places, entry)).alias("e")).select(document, page, "row", "e.*").filter(F.col("sf") >= least)
    named = each.join(legend.select(document, page, "key", "material"), [document, page, "key"], "left").withColumn("material", F.coalesce("material", F.lit("")))
    best = F.min_by(F.struct("sf", "material"), F.struct(-F.col("sf"), F.col(page), F.col("row"), F.col("at"), F.col("material")))
    return named.filter(~F.col("material").rlike(LINEAR)).groupBy(document, "key").agg(best.alias("b")).select(document, "key", F.bround("b.sf", 0).cast("bigint").alias("sf"), "b.material")


def opening_schedule(rows: DataFrame, keys: list[str], number: str = "row", most: float = 60.0) -> DataFrame:
    """Tables as rows of cells (keys name a table, `row` 0 is its header): (keys, row, door, mark, width_ft, height_ft, qty, area_sf).
    Columns are found by words of the header: a width and a height, or one size as 'w x h'; sides above 0 and up to 60 feet."""
    cols = F.transform("cells", lambda c: F.trim(F.upper(F.coalesce(c, F.lit("")))))

    def first(words: list[str]) -> Column:
        return F.get(F.filter(F.sequence(F.lit(0), F.size("__c") - 1), lambda i: has(F.get("__c", i), *words)), F.lit(0))

    at = {name: first(words) for name, words in HEADER_WORDS.items()}
    header = rows.filter((F.col(number) == 0) & (F.size("cells") > 0)).select(*keys, cols.alias("__c")).select(*keys, *[c.alias(f"__{n}") for n, c in at.items()], has(F.array_join("__c", " "), "DOOR").alias("door"))
    header = header.filter("__width is not null or __height is not null or __size is not null")
    own = rows.filter(F.col(number) > 0).join(header, keys)
    cell = lambda n: F.get("cells", F.col(f"__{n}"))
    both = F.col("__width").isNotNull() & F.col("__height").isNotNull()
    sides = F.split(cell("size"), "[xX×]")
    pair = F.size(sides) == 2
    side = lambda n, k: F.when(both, schedule_feet(cell(n))).when(pair, schedule_feet(F.get(sides, F.lit(k))))
    qty = F.coalesce(F.regexp_extract(cell("qty"), r"\d+", 0).try_cast("int"), F.lit(1))
    mark = F.coalesce(F.left(F.trim(F.nullif(cell("mark"), F.lit(""))), F.lit(12)), F.lit("?"))
    out = own.select(*keys, number, "door", mark.alias("mark"), side("width", 0).alias("w"), side("height", 1).alias("h"), qty.alias("qty")).filter((F.col("w") > 0) & (F.col("h") > 0) & (F.col("w") <= most) & (F.col("h") <= most))
    return out.select(*keys, number, "door", "mark", F.bround("w", 2).alias("width_ft"), F.bround("h", 2).alias("height_ft"), "qty", F.bround(F.col("w") * F.col("h") * F.col("qty"), 1).alias("area_sf"))


def sheet_index(rows: DataFrame, keys: list[str], page: str) -> DataFrame:
    """On the first five pages under an index heading, elevation sheets of the A series that are not interior."""
    heading = rows.filter(F.upper("line").rlike(INDEX_HEADING) & (F.col(page) <= 5)).select(*keys, page).distinct()
    up = F.upper("line")
    sheet = F.get(F.filter("words", lambda w: w.rlike(INDEX_SHEET)), F.lit(0))
    return rows.join(heading, [*keys, page], "left_semi").select(*keys, sheet.alias("sheet"), up.alias("title")).filter(F.col("sheet").isNotNull() & F.contains("title", F.lit("ELEVATION")) & ~F.contains("title", F.lit("INTERIOR")))


def text_export(words: DataFrame, document: str, page: str, order: str, text: str, note: str | None = None, most_pages: int = 40, most_notes: int = 60) -> DataFrame:
    """(document, page, text) of the first pages of each document. The text of a page is whole; its first notes (rows where the
    column `note` is true, empty ones apart) follow in brackets. Pages count from 1 in each document, those without words included."""
    own = words.filter((F.col(page) <= most_pages) & (F.col(text) != "")).withColumn("__n", F.lit(False) if note is None else F.coalesce(note, F.lit(False)))
    rows = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct(order, text)))), lambda s: s[text])
    g = own.groupBy(document, page).agg(rows(~F.col("__n")).alias("__t"), F.slice(rows(F.col("__n")), 1, most_notes).alias("__a"))
    marks = F.when(F.size("__a") > 0, F.concat(F.lit("\n[estimator marks/notes on page: "), F.array_join("__a", " | "), F.lit("]"))).otherwise("")
    return g.select(document, page, F.concat(F.array_join("__t", "\n"), marks).alias("text")).filter(F.trim("text") != "")


def usable_ocr(rows: DataFrame, conf: str = "conf", text: str = "text", least: float = 0.6, vocabulary: Column | None = None) -> DataFrame:
    """Rows read with confidence, of 5 to 60 characters."""
    keep = (F.col(conf) >= least) & F.length(text).between(5, 60)
    return rows.filter(keep if vocabulary is None else keep & vocabulary)
