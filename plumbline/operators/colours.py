"""Drawing colours and the names they carry (M11, J1), and codes resolved through a job's map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import canon
from ..functions.parse import CODE
from ..functions.rules import filled

# The colours that readers paint with, in hundredths; no drawing's own.
READER_COLOURS = [(35, 55, 85), (25, 75, 35), (0, 72, 85), (55, 75, 95), (85, 45, 25), (45, 65, 90), (45, 55, 90), (0, 80, 90), (35, 78, 45), (95, 45, 55)]


def quantised(colour: Column) -> Column:
    """The first three channels to sixths, half to even; null where there is no colour."""
    return F.when(F.size(colour) > 0, F.transform(F.slice(colour, 1, 3), lambda c: F.bround(c * 6) / 6))


def drawn(colour: Column) -> Column:
    """The colour is the drawing's own, and not a reader's."""
    hundredths = F.array_join(F.transform(F.slice(colour, 1, 3), lambda c: F.bround(c * 100).cast("int").cast("string")), ",")
    return F.coalesce(F.size(colour) > 0, F.lit(False)) & ~F.coalesce(hundredths.isin([",".join(map(str, c)) for c in READER_COLOURS]), F.lit(False))


def with_groups(pieces: DataFrame, keys: list[str], name: Column, colour: str, order: list[str]) -> DataFrame:
    """Pieces with material_group and material_class. A colour fill takes the name that the first named piece of its colour
    (in order, within keys) has, else its colour is its group. Names a colour by an aggregate, so a common colour combines."""
    own = pieces.withColumns({"__c": canon(F.coalesce(filled(name), F.lit(""))), "__q": F.when(drawn(F.col(colour)), quantised(F.col(colour)))})
    named = own.filter(F.col("__c.cls").isin("real", "code") & F.col("__q").isNotNull()).groupBy(*keys, "__q").agg(F.min_by("__c", F.struct(*order)).alias("__n"))
    swatch = F.concat(F.lit("Color: ("), F.array_join(F.transform("__q", lambda c: c.cast("string")), ", "), F.lit(")"))
    bare = (F.col("__c.cls") == "generic") & (F.col("__c.group") == "Color fill") & F.col("__q").isNotNull()
    given = F.coalesce("__n", F.struct(swatch.alias("group"), F.lit("code").alias("cls")))
    picked = F.when(bare, given).otherwise(F.col("__c"))
    return own.join(named, [*keys, "__q"], "left").withColumns({"material_group": picked["group"], "material_class": picked["cls"]}).select(*pieces.columns, "material_group", "material_class")


def with_codes(pieces: DataFrame, codes: DataFrame, keys: list[str], id_col: str, material: str) -> DataFrame:
    """Pieces that nothing has named yet take the name of the first code in their text that the job's map (keys, code, name) has,
    as 'name (code)'; named_by tells the code. A map that repeats a code gives its least name."""
    free = F.col("named_by").isNull() & ~F.coalesce(F.col("suggest_only"), F.lit(False))
    found = pieces.filter(free).select(*keys, id_col, F.posexplode(F.regexp_extract_all(F.upper(material), F.lit(CODE), F.lit(1))).alias("__k", "code"))
    book = codes.groupBy(*keys, "code").agg(F.min("name").alias("name"))
    first = found.join(book, [*keys, "code"]).groupBy(*keys, id_col).agg(F.min(F.struct("__k", "code", "name")).alias("__f"))
    told = F.concat(F.col("__f.name"), F.lit(" ("), F.col("__f.code"), F.lit(")"))
    out = pieces.join(first, [*keys, id_col], "left")
    return out.withColumns({material: F.coalesce(told, F.col(material)), "named_by": F.coalesce(F.concat(F.lit("codemap:"), F.col("__f.code")), "named_by")}).select(*pieces.columns)
