"""Scalar parsers: lengths, scales, areas, codes, sheet numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_match

# Patterns and tables that results must share with the reference.
FEET_INCHES = r"^(\d{1,3})'(?:\s*-?\s*(\d{1,2})(?:\s+(\d{1,2})/(\d{1,2}))?\s*\"?)?$"
ARCHITECT = r"(?i)(?<!\d )(\d+)\s*/\s*(\d+)\s*\"?\s*(?:in\.?)?\s*=\s*1\s*'"
ENGINEER = r"(?i)\b1\s*\"\s*=\s*(\d+)\s*'"
RUNGS = [0.0833, 0.1667, 0.3333, 0.6667, 1.0, 1.333, 2.0, 2.667, 4.0, 5.333, 6.0, 8.0, 10.0, 10.667, 16.0, 20.0, 21.333, 30.0, 32.0, 40.0, 48.0, 50.0, 60.0, 64.0, 100.0]
CODE = r"\b([A-Z]{1,4}-?\d{1,2}[A-Z]?)\b"
CODE_TAG = r"^([A-Z]{1,4})[-.]?(\d{1,2}[A-Z]?)$"
LEGEND_KEY = r"^[A-Z]{1,3}[-.]?\d{1,2}$"
LOOSE_KEY = r"^(?:[A-Z]{1,3}\d{0,2}[A-Z]?(?:-[A-Z]{1,4}\d{0,2}[A-Z]?)?|\d{1,2}[A-Z]?)$"
CODE_FAMILIES = {
    "FIBER CEMENT": ["FC", "FCP", "FCS", "FCL", "FCB", "FBC", "HDFC", "SFC", "FSH", "FSV", "LS"],
    "METAL PANEL": ["MP", "CMP", "LPSS", "SS", "IMP"],
    "ACM": ["ACM", "MCM"],
}
NAME_THEN_CODE = r"([A-Z][A-Z\s/&]{6,40})\s*[-–:]\s*\(?([A-Z]{1,4}-?\d{1,2}[A-Z]?)\)?"
CODE_THEN_NAME = r"\b([A-Z]{1,4}-?\d{1,2}[A-Z]?)\s*[:=–-]\s*([A-Z][A-Z\s/&]{6,40})"
SHEETS = [r"^[A-Z]{1,2}\d{1,2}\.\d{1,2}[A-Za-z]?$", r"^[A-Z]{1,2}-\d{2,3}[A-Za-z]?$", r"^[A-Z]{1,2}\d{3}[A-Za-z]?$"]


# Lengths inside other texts.
LOOSE_FEET = r"(\d+)\s*'\s*-?\s*(\d+)?"
HEIGHT_OF = r"(?i)H\s*[:=]\s*(\d+)\s*'\s*-?\s*(\d+)?"
EXPLICIT_SF = r"(?i)-?\s*([\d,]+(?:\.\d+)?)\s*sf"
SIZE_FEET, SIZE_INCHES, SIZE_BARE = r"(\d+)\s*'\s*[-\s]?\s*(\d+(?:\.\d+)?)?\s*\"?", r"(\d+(?:\.\d+)?)\s*\"", r"(\d+(?:\.\d+)?)"


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def feet_inches(text: Column) -> Column:
    """M1: 24'-0", 12'-6 1/2", 8' as feet; null for anything else."""
    part = lambda k: _number(text, FEET_INCHES, k)
    fraction = F.coalesce(F.try_divide(part(3), part(4)), F.lit(0.0))
    return F.when(text.rlike(FEET_INCHES), part(1) + (F.coalesce(part(2), F.lit(0.0)) + fraction) / 12)


def loose_feet(text: Column) -> Column:
    """M2: the first feet-inches anywhere in a text."""
    return F.when(text.rlike(LOOSE_FEET), _number(text, LOOSE_FEET, 1) + F.coalesce(_number(text, LOOSE_FEET, 2), F.lit(0.0)) / 12)


def height_of(text: Column) -> Column:
    """M2: H: 12'-6 in a subject."""
    return F.when(text.rlike(HEIGHT_OF), _number(text, HEIGHT_OF, 1) + F.coalesce(_number(text, HEIGHT_OF, 2), F.lit(0.0)) / 12)


def schedule_feet(text: Column) -> Column:
    """M2: a size of a schedule: feet and inches, or inches alone, or a bare number of feet; 0 for anything else."""
    t = F.replace(F.translate(F.trim(F.coalesce(text, F.lit(""))), "”’", "\"'"), F.lit("''"), F.lit('"'))
    part = lambda pattern, k: _number(t, pattern, k)
    feet = F.round(part(SIZE_FEET, 1) + F.coalesce(part(SIZE_FEET, 2), F.lit(0.0)) / 12, 3)
    return F.when(t.rlike(SIZE_FEET), feet).when(t.rlike(SIZE_INCHES), F.round(part(SIZE_INCHES, 1) / 12, 3)).otherwise(F.coalesce(part(SIZE_BARE, 1), F.lit(0.0)))


def explicit_sf(text: Column) -> Column:
    """M3: '1,234.5 sf'."""
    return F.regexp_replace(F.regexp_extract(text, EXPLICIT_SF, 1), ",", "").try_cast("double")


def scale_candidates(text: Column) -> Column:
    """M4: feet per inch of each printed scale; architects' fractions outrank engineers' scales."""
    t = F.translate(F.coalesce(text, F.lit("")), "’‘′”“″", "'''\"\"\"")
    t = F.regexp_replace(t, r"=\s*[Il|]\s*'", "= 1'")
    a, b = (F.regexp_extract_all(t, F.lit(ARCHITECT), F.lit(k)) for k in (1, 2))
    fractions = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.try_divide(z["b"].try_cast("double"), z["a"].try_cast("double"))), lambda v: v.isNotNull())
    whole = F.filter(F.transform(F.regexp_extract_all(t, F.lit(ENGINEER), F.lit(1)), lambda n: n.try_cast("double")), lambda v: v > 0)
    return F.when(F.size(fractions) > 0, fractions).otherwise(whole)


def scale_value(text: Column) -> Column:
    """M5: the first candidate."""
    return F.get(scale_candidates(text), F.lit(0))


def verified_scale(text: Column, verified: Column) -> Column:
    """A page's own scale, only where it was verified."""
    return F.when(F.coalesce(verified, F.lit(False)), scale_value(text))


def on_rung(ft_per_in: Column, tolerance: float = 0.03) -> Column:
    """M6: the nearest standard scale, by relative distance, is within the tolerance."""
    return F.array_min(F.array(*[F.abs(ft_per_in - r) / r for r in RUNGS])) <= tolerance


def printed_contradicts(value: Column, text: Column, tolerance: float = 0.02) -> Column:
    """scales are printed and none is the value."""
    c = scale_candidates(text)
    return (F.size(c) > 0) & ~F.exists(c, lambda x: F.abs(x / value - 1) <= tolerance)


def code_tag(word: Column) -> Column:
    """X11: struct<code, family> of a material code; null for other tags (doors, windows, details)."""
    prefix, number = F.regexp_extract(word, CODE_TAG, 1), F.regexp_extract(word, CODE_TAG, 2)
    family = first_match([(prefix.isin(codes), name) for name, codes in CODE_FAMILIES.items()], F.lit(None).cast("string"))
    return F.when(family.isNotNull(), F.struct(F.concat_ws("-", prefix, number).alias("code"), family.alias("family")))


def code_tokens(text: Column) -> Column:
    """Codes in a text, with their parts."""
    codes = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(CODE), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(codes, F.flatten(F.transform(codes, lambda c: F.split(c, "-"))))))


def code_pairs(text: Column) -> Column:
    """array<struct<code, name>>: 'NAME - CODE', then 'CODE: NAME', in order of the text."""
    pick = lambda pattern, code, name: F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(code)).alias("c"), F.regexp_extract_all(text, F.lit(pattern), F.lit(name)).alias("n")),
        lambda z: F.struct(z["c"].alias("code"), F.trim(z["n"]).alias("name")),
    )
    return F.concat(pick(NAME_THEN_CODE, 2, 1), pick(CODE_THEN_NAME, 1, 2))


def is_sheet(text: Column) -> Column:
    return text.rlike("|".join(SHEETS))


def sheet_family(sheet: Column) -> Column:
    """struct<letters, form>: dash, dot or plain."""
    pattern = r"^([A-Z]{1,2})([-.]?)\d"
    form = F.when(F.regexp_extract(sheet, pattern, 2) == "-", "dash").when(F.contains(sheet, F.lit(".")), "dot").otherwise("plain")
    return F.when(sheet.rlike(pattern), F.struct(F.regexp_extract(sheet, pattern, 1).alias("letters"), form.alias("form")))


def job_id_ok(job: Column) -> Column:
    """F23."""
    return job.rlike(r"^[A-Za-z0-9._-]{1,64}$") & ~job.rlike(r"^\.+$")


def fenced_json(text: Column, schema: str) -> Column:
    """The JSON of a reply that may wrap it in a code fence."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1), schema)
