"""Names, parsers and page texts over part, documents and orders. Sample names are dealt to rows by their key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import parse as P
from ..operators import pages, schedules
from .registry import register, table

# Names that reach each rule, dealt to parts by key, and what the rules give them, worked out by hand:
# group, class, family, scope family, category, reader.
ANSWERS = [
    ("Lap / horizontal - 4in courses", "Lap siding (horizontal)", "pattern", "Lap siding - unqualified", "unassigned", "Fiber Cement / Lap", "train"),
    ("FC-1", "FC-1", "code", "Fiber cement - unspecified", "fc", "FC-1", "train"),
    ("NO", "Unclassified — confirm", "junk", "(location/other - not a material)", "junk-name", "NO", "train"),
    ("Panel wall (drawn fill)", "Drawn wall fill (confirm)", "generic", "Panel - unqualified", "unassigned", "Metal Wall Panel", "fill"),
    ("ACM panel", "ACM / composite metal panel", "real", "ACM / composite metal panel", "acm", "ACM/Composite Panel", "train"),
    ("Fiber Cement Lap Siding", "Fiber cement lap/plank", "real", "Fiber cement - lap/plank/siding", "fc", "Fiber Cement / Lap", "train"),
    ("Hardie plank", "Fiber cement lap/plank", "real", "Fiber cement - lap/plank/siding", "fc", "Hardie plank", "train"),
    ("Wall area (AI boundary model)", "Wall flood (confirm)", "generic", "(unmapped word name)", "unassigned", "Wall area (AI boundary model)", "v13"),
    ("Wall area 3", "Wall flood (confirm)", "generic", "(unmapped word name)", "unassigned", "Wall area 3", "flood"),
    ("Wall band 2", "Wall flood (confirm)", "generic", "Trim / frieze / band", "unassigned", "Wall band 2", "band"),
    ("Hatched area", "Hatched masonry/EIFS (confirm)", "generic", "(unmapped word name)", "unassigned", "Hatched area", "hatch"),
    ("Color fill", "Color fill", "generic", "(unmapped word name)", "unassigned", "Color fill", "color"),
    ("Rendered siding", "Rendered/soffit (confirm)", "generic", "EIFS / stucco", "unassigned", "Rendered siding", "rc"),
    ("GROUP 4", "Unclassified — confirm", "junk", "(bare legend code - needs job legend)", "junk-name", "GROUP 4", "train"),
    ("T.O. BRICK", "Unclassified — confirm", "junk", "Brick / masonry", "non-bfs", "Masonry", "train"),
    ("B. PARTITIONS SHALL BE TYP", "Unclassified — confirm", "junk", "(unmapped word name)", "unassigned", "B. PARTITIONS SHALL BE TYP", "train"),
    ("Metal panel - standing seam", "Metal panel", "real", "Metal panel - corrugated/rib", "metal", "Metal Wall Panel", "train"),
    ("Brick veneer", "Brick / masonry (non-BFS)", "real", "Brick / masonry", "non-bfs", "Masonry", "train"),
    ("EIFS finish", "EIFS finish", "real", "EIFS / stucco", "non-bfs", "EIFS finish", "train"),
    ("Vinyl siding", "Vinyl siding", "real", "Vinyl siding", "vinyl", "Vinyl siding", "train"),
    ("Cedar shake", "Cedar shake", "real", "Wood / cedar siding", "shingle", "Shingle/Shake", "train"),
    ("MP-2", "MP-2", "code", "Metal panel - flat/other", "unassigned", "MP-2", "train"),
    ("EX-6B", "EX-6B", "code", "(bare legend code - needs job legend)", "unassigned", "EX-6B", "train"),
    ("12.5", "12.5", "real", "(bare number - no material)", "unassigned", "12.5", "train"),
    ("", "Unclassified — confirm", "junk", "(blank)", "junk-name", "Other", "train"),
    ("Vertical rib panel", "Vertical rib panel", "pattern", "Metal panel - corrugated/rib", "unassigned", "Metal Wall Panel", "train"),
    ("Horizontal panel", "Horizontal panel", "pattern", "Panel - unqualified", "unassigned", "Metal Wall Panel", "train"),
    ("Vertical panel", "Vertical panel", "pattern", "Panel - unqualified", "unassigned", "Metal Wall Panel", "train"),
    ("Soffit return", "Soffit return", "real", "Soffit / ceiling (other)", "soffit", "Soffit/Trim", "train"),
    ("Louver screen", "Louver screen", "real", "Louver / screen / misc", "unassigned", "Louver screen", "train"),
    ("Roof membrane", "Roof membrane", "real", "Roofing / membrane", "non-bfs", "Roof membrane", "train"),
    ("Nichiha panel", "Nichiha panel", "real", "Panel - unqualified", "nichiha", "Fiber Cement / Lap", "train"),
    ("Perforated metal", "Perforated metal", "real", "(unmapped word name)", "perforated", "Metal Wall Panel", "train"),
    ("AP-1 panel", "AP-1 panel", "real", "Panel - unqualified", "metal", "Metal Wall Panel", "train"),
    ("A-402 sheet", "A-402 sheet", "real", "(unmapped word name)", "junk-name", "A-402 sheet", "train"),
    ("North Elevation", "North Elevation", "real", "(location/other - not a material)", "unassigned", "North Elevation", "train"),
    ("AI suggestion 4", "Unclassified — confirm", "junk", "(unmapped word name)", "unassigned", "AI suggestion 4", "train"),
    ("PVC trim", "PVC trim", "real", "Vinyl siding", "unassigned", "Soffit/Trim", "train"),
    ("A very long architect name of a wall finish that runs on and on", "A very long architect name of a wall finis…", "real", "(unmapped word name)", "unassigned", "A very long architect name of a wall finish that runs on and on", "train"),
    ("=SUM(A1)", "=SUM(A1)", "real", "(unmapped word name)", "unassigned", "=SUM(A1)", "train"),
    ("Stone base", "Stone base", "real", "Brick / masonry", "non-bfs", "Stone base", "train"),
    ("Composite metal panel", "ACM / composite metal panel", "real", "ACM / composite metal panel", "acm", "ACM/Composite Panel", "train"),
    ("FCP panel smooth", "Fiber cement panel", "real", "Fiber cement - panel", "fc", "Metal Wall Panel", "train"),
    ("Shingle siding", "Shingle siding", "real", "Roofing / membrane", "shingle", "Shingle/Shake", "train"),
    ("TXOX BRICK VENEER", "Brick / masonry (non-BFS)", "real", "Brick / masonry", "non-bfs", "Masonry", "train"),
    ("Metal soffit panel", "Metal soffit panel", "real", "Metal soffit / GSM / flashing", "soffit", "Soffit/Trim", "train"),
]
NAMES = [a[0] for a in ANSWERS]
READER_SAYS = {"train": "Drawing geometry", "fill": "Drawn fill", "v13": "AI boundary model", "flood": "Structural flood", "band": "Story-band", "hatch": "Hatch reader", "color": "Drawn color", "rc": "Rendered reader"}


def name_column():
    return F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % len(NAMES)).cast("int"))



def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]"


NAME_SQL = f"{sql_list(NAMES)}[CAST(p_partkey % {len(NAMES)} AS INTEGER) + 1]"


def sql_case(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


def sql_has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_text(w)})" for w in words) + ")"


def sql_like(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {sql_text(pattern)})"


def named(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", name_column().alias("name"))


_T = f"WITH t AS (SELECT p_partkey, {NAME_SQL} AS name, upper(trim(regexp_replace({NAME_SQL}, '\\s+', ' ', 'g'))) AS u, trim(regexp_replace({NAME_SQL}, '\\s+', ' ', 'g')) AS raw FROM part) "


def sql_answers(*columns: tuple[int, str]) -> str:
    """The hand-made answers as SQL: one column each."""
    picked = ", ".join(f"CASE name {' '.join(f'WHEN {sql_text(a[0])} THEN {sql_text(a[k])}' for a in ANSWERS)} END AS {c}" for k, c in columns)
    return _T + f"SELECT p_partkey, {picked} FROM t"


@register("canon_material", sql_answers((1, "material_group"), (2, "material_class")))
def canon_material(spark, sf_dir):
    """X1, X3, X4."""
    c = N.canon(F.col("name"))
    return named(spark, sf_dir).select("p_partkey", c["group"].alias("material_group"), c["cls"].alias("material_class"))


@register("family_of", sql_answers((3, "family")))
def family_of(spark, sf_dir):
    """X2."""
    return named(spark, sf_dir).select("p_partkey", N.family_of(F.col("name")).alias("family"))


@register("scope_family", sql_answers((4, "family")))
def scope_family(spark, sf_dir):
    """X5."""
    return named(spark, sf_dir).select("p_partkey", N.scope_family(F.col("name")).alias("family"))


@register("categorize", sql_answers((5, "category")))
def categorize(spark, sf_dir):
    """X6."""
    return named(spark, sf_dir).select("p_partkey", N.categorize(F.col("name")).alias("category"))


@register("reader_class", f"SELECT *, CASE reader_class {' '.join(f'WHEN {sql_text(k)} THEN {sql_text(v)}' for k, v in READER_SAYS.items())} END AS label FROM (" + sql_answers((6, "reader_class")) + ")")
def reader_class(spark, sf_dir):
    """X7, X8, X22."""
    rows = named(spark, sf_dir).withColumn("reader_class", N.reader_class(F.col("name")))
    return rows.select("p_partkey", "reader_class", N.class_label(F.col("reader_class")).alias("label"))


_FLAG_TEXTS = [f[1][0] + " here" for f in N.FLAGS] + ["nothing to tell", "Elevation markers imply that dimension strings imply"]


@register(
    "flag_taxonomy",
    "WITH f AS (SELECT p_partkey, " + f"{sql_list(_FLAG_TEXTS)}[CAST(p_partkey % {len(_FLAG_TEXTS)} AS INTEGER) + 1] AS flag FROM part), c AS (SELECT *, " + sql_case([(sql_has("flag", t), sql_text(c)) for c, t, _, _ in N.FLAGS], "NULL") + " AS code, " + sql_case([(sql_has("flag", t), sql_text(s)) for _, t, s, _ in N.FLAGS], "NULL") + " AS severity, " + sql_case([(sql_has("flag", t), sql_text(p)) for _, t, _, p in N.FLAGS], "NULL") + " AS scope FROM f) SELECT p_partkey, flag, code, severity, scope FROM c WHERE code IS NOT NULL",
)
def flag_taxonomy(spark, sf_dir):
    """X9, U12."""
    from ..operators.reconcile import classified_flags

    flag = F.get(F.array(*[F.lit(t) for t in _FLAG_TEXTS]), (F.col("p_partkey") % len(_FLAG_TEXTS)).cast("int"))
    return classified_flags(table(spark, sf_dir, "part").select("p_partkey", flag.alias("flag")), "flag")


@register("name_cleanup", _T + "SELECT p_partkey, CASE WHEN regexp_matches(name, '^[=+\\-@]') THEN ' ' || name ELSE name END AS cell, left(trim(regexp_replace(name, '[\\\\/:*?\"<>|]+', '', 'g')), 80) AS file_name, left(u, 60) AS title FROM t")
def name_cleanup(spark, sf_dir):
    """X14, X18, X19."""
    return named(spark, sf_dir).select("p_partkey", N.safe_cell(F.col("name")).alias("cell"), N.safe_file_name(F.col("name")).alias("file_name"), N.title_text(F.col("name")).alias("title"))


_S = "WITH u AS (SELECT doc_id, upper(text) AS u FROM documents) "


@register(
    "sentinel_scan",
    _S + "SELECT doc_id, contains(u, 'MATCH LINE') OR contains(u, 'MATCHLINE') AS match_line, contains(u, 'SOFFIT') OR contains(u, 'RETURN') AS soffit, " + sql_like("u", N.REWORK) + " AS rework, " + sql_has("u", N.STRUCTURES) + " OR " + sql_like("u", r"\bBUILDING\s+([B-F])\b") + " AS structure FROM u",
)
def sentinel_scan(spark, sf_dir):
    """X16."""
    s = N.sentinels(F.col("text"))
    has = lambda k: F.array_contains("s", k)
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", has("MATCH_LINE").alias("match_line"), has("SOFFIT_RETURN").alias("soffit"), has("REWORK").alias("rework"), has("STRUCTURE_TERM").alias("structure"))


_PREFIX = ["FC", "MP", "ACM", "W", "HDFC", "SS", "LS", "D"]


@register(
    "code_tags",
    f"WITH w AS (SELECT p_partkey, {sql_list(_PREFIX)}[CAST(p_partkey % {len(_PREFIX)} AS INTEGER) + 1] AS p, CAST(p_size % 30 AS VARCHAR) AS n, CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '' END AS s FROM part), f AS (SELECT *, "
    + "CASE p WHEN 'FC' THEN 'FIBER CEMENT' WHEN 'HDFC' THEN 'FIBER CEMENT' WHEN 'LS' THEN 'FIBER CEMENT' WHEN 'MP' THEN 'METAL PANEL' WHEN 'SS' THEN 'METAL PANEL' WHEN 'ACM' THEN 'ACM' END"
    + " AS family FROM w) SELECT p_partkey, p || '-' || n AS code, family FROM f WHERE family IS NOT NULL",
)
def code_tags(spark, sf_dir):
    """X11, F34."""
    prefix = F.get(F.array(*[F.lit(p) for p in _PREFIX]), (F.col("p_partkey") % len(_PREFIX)).cast("int"))
    word = F.concat(prefix, F.when(F.col("p_partkey") % 2 == 0, "-").otherwise(""), (F.col("p_size") % 30).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", P.code_tag(word).alias("t")).filter("t is not null").select("p_partkey", "t.code", "t.family")


@register("code_tokens", "WITH t AS (SELECT p_partkey, 'Wall FC-' || CAST(p_size % 30 AS VARCHAR) || ' and MP' || CAST(p_partkey % 60 + 10 AS VARCHAR) || 'A over' AS x, p_size % 30 AS n, p_partkey % 60 + 10 AS k FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(['FC-' || n, 'FC', CAST(n AS VARCHAR), 'MP' || k || 'A'])), ',') AS tokens FROM t")
def code_tokens(spark, sf_dir):
    """X10."""
    text = F.concat(F.lit("Wall FC-"), (F.col("p_size") % 30).cast("string"), F.lit(" and MP"), (F.col("p_partkey") % 60 + 10).cast("string"), F.lit("A over"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(P.code_tokens(text), ",").alias("tokens"))


@register("codemap", "SELECT p_partkey, 'FC-' || CAST(p_size % 30 AS VARCHAR) AS code, 'FIBER CEMENT PANEL' AS name FROM part")
def codemap(spark, sf_dir):
    """X17: 'NAME - CODE' in half of the parts, 'CODE: NAME' in the others."""
    n = (F.col("p_size") % 30).cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("FIBER CEMENT PANEL - FC-"), n)).otherwise(F.concat(F.lit("FC-"), n, F.lit(" : FIBER CEMENT PANEL")))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(P.code_pairs(text), F.lit(0)).alias("c")).select("p_partkey", "c.code", "c.name")


@register("parse_feet_inches", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size + (CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE CAST(p_partkey % 12 AS DOUBLE) + CASE WHEN p_partkey % 4 = 2 THEN 1 / 2.0 ELSE 0 END END) / 12.0 END::DOUBLE AS feet FROM part")
def parse_feet_inches(spark, sf_dir):
    """M1: whole feet, feet and inches, with a fraction, and none."""
    k, inch = F.col("p_partkey") % 4, (F.col("p_partkey") % 12).cast("string")
    text = F.concat(F.col("p_size").cast("string"), F.when(k == 0, "'").when(k == 1, F.concat(F.lit("'-"), inch, F.lit('"'))).when(k == 2, F.concat(F.lit("'-"), inch, F.lit(' 1/2"'))).otherwise(" feet"))
    return table(spark, sf_dir, "part").select("p_partkey", P.feet_inches(text).alias("feet"))


@register("parse_scale", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size / 1.0 WHEN 1 THEN p_size / 3.0 WHEN 2 THEN p_size * 1.0 WHEN 3 THEN CASE WHEN p_size = 1 THEN 1.0 END END::DOUBLE AS ft_per_in FROM part")
def parse_scale(spark, sf_dir):
    """M4, M5: 1/n\", 3/n\", 1\"=n', and a mixed fraction that is none."""
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("SCALE: 1/"), n, F.lit("\" = 1'-0\""))).when(k == 1, F.concat(F.lit("3/"), n, F.lit("\" = I'-0\""))).when(k == 2, F.concat(F.lit("1\" = "), n, F.lit("'"))).otherwise(F.concat(F.lit("1 1/"), n, F.lit("\" = 1'")))
    return table(spark, sf_dir, "part").select("p_partkey", P.scale_value(text).alias("ft_per_in"))


@register("on_rung", "SELECT p_partkey, p_size IN (1, 2, 4, 6, 8, 10, 16, 20, 21, 30, 32, 39, 40, 41, 47, 48, 49, 50) AS on_rung FROM part")
def on_rung(spark, sf_dir):
    """M6."""
    return table(spark, sf_dir, "part").select("p_partkey", P.on_rung(F.col("p_size").cast("double")).alias("on_rung"))


@register("explicit_sf", "SELECT p_partkey, (p_partkey * 7 + 0.5)::DOUBLE AS sf, 'Wall' AS material FROM part")
def explicit_sf(spark, sf_dir):
    """M3, X13."""
    text = F.concat(F.lit("Wall (north) "), F.format_number(F.col("p_partkey") * 7 + 0.5, 1), F.lit(" sf"))
    return table(spark, sf_dir, "part").select("p_partkey", P.explicit_sf(text).alias("sf"), N.clean_material(F.lit("Wall (north) 120sf")).alias("material"))


@register("sheet_family", "SELECT o_orderkey, 'A' AS letters, CASE o_orderkey % 3 WHEN 0 THEN 'dash' WHEN 1 THEN 'dot' ELSE 'plain' END AS form FROM orders")
def sheet_family(spark, sf_dir):
    """X15."""
    n = (F.col("o_orderkey") % 900 + 100).cast("string")
    k = F.col("o_orderkey") % 3
    sheet = F.when(k == 0, F.concat(F.lit("A-"), n)).when(k == 1, F.concat(F.lit("A"), F.left(n, F.lit(1)), F.lit("."), F.right(n, F.lit(2)))).otherwise(F.concat(F.lit("A"), n))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.sheet_family(sheet).alias("f")).select("o_orderkey", "f.letters", "f.form")


_TITLES = ["North Elevation A", "FIRST FLOOR PLAN", "Site Plan", "Roof plan with elevation notes", "SOFFIT details", "3D VIEW massing", "Typical East elevation rendering", "Site plan with brick veneer", "General notes", "see elevation for colour"]


@register(
    "page_predicates",
    f"WITH t AS (SELECT o_orderkey, {sql_list(_TITLES)}[CAST(o_orderkey % 10 AS INTEGER) + 1] AS t FROM orders) SELECT o_orderkey, "
    + f"CASE WHEN {sql_like('lower(t)', pages.ELEVATION_TITLE)} THEN true WHEN contains(lower(t), 'roof plan') OR contains(lower(t), 'floor plan') THEN false WHEN contains(lower(t), 'elevation') OR contains(lower(t), 'return') OR contains(lower(t), 'soffit') THEN true ELSE false END AS elevation, "
    + f"{sql_has('upper(t)', pages.SITE)} AND NOT {sql_has('upper(t)', pages.WALLS)} AS site, {sql_has('upper(t)', pages.VIEWS_3D)} AND NOT {sql_like('lower(t)', pages.ELEVATION_TITLE_3D)} AS view_3d, {sql_like('upper(t)', pages.PLAN_TITLE)} AS plan FROM t",
)
def page_predicates(spark, sf_dir):
    """F4, F5, F6, F28."""
    t = F.get(F.array(*[F.lit(x) for x in _TITLES]), (F.col("o_orderkey") % 10).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    return rows.select("o_orderkey", pages.elevation_page(F.col("t"), F.lit(0), F.lit(0)).alias("elevation"), pages.site_sheet(F.col("t")).alias("site"), pages.view_3d_sheet(F.col("t")).alias("view_3d"), pages.plan_page(F.col("t")).alias("plan"))


@register("scale_guard", "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 120 ELSE p_size END AS s, p_partkey % 3 = 0 AS c, CASE p_partkey % 4 WHEN 0 THEN 'SITE PLAN' WHEN 1 THEN 'PERSPECTIVE' ELSE 'wall' END AS t FROM part) SELECT p_partkey, CASE WHEN c AND s >= 100 THEN 'drop' WHEN NOT c AND s >= 100 THEN 'demote' WHEN c AND s >= 9 AND t = 'SITE PLAN' THEN 'demote' WHEN t = 'PERSPECTIVE' THEN 'demote' ELSE 'keep' END AS action FROM s")
def scale_guard(spark, sf_dir):
    """F7."""
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, "SITE PLAN").when(k % 4 == 1, "PERSPECTIVE").otherwise("wall")
    return table(spark, sf_dir, "part").select("p_partkey", pages.scale_guard(F.when(k % 10 == 0, 120).otherwise(F.col("p_size")), k % 3 == 0, t).alias("action"))


@register("row_text", "WITH w AS (SELECT l_orderkey, CAST(round_even(l_quantity / 4.0, 0) AS INTEGER) AS r, l_partkey, l_returnflag FROM lineitem) SELECT l_orderkey, r AS \"row\", string_agg(l_returnflag || CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_partkey, l_returnflag) AS line FROM w GROUP BY 1, 2")
def row_text(spark, sf_dir):
    """Words of a band of heights as a line."""
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("y"), F.col("l_partkey").alias("x"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"))
    return schedules.rows_of_words(words, ["l_orderkey"]).select("l_orderkey", "row", "line")


@register(
    "schedule_rows",
    """
    WITH s AS (SELECT l_orderkey, l_partkey % 90 AS k, CAST(l_quantity AS BIGINT) * 10 AS sf FROM lineitem WHERE l_linenumber % 4 < 2),
         b AS (SELECT l_orderkey, k, max(sf) AS sf FROM s WHERE sf >= 50 AND k % 7 <> 0 AND k % 5 <> 0 GROUP BY 1, 2),
         e AS (SELECT l_orderkey FROM b GROUP BY 1 HAVING count(*) >= 2)
    SELECT l_orderkey, 'FC-' || k AS key, sf, 'Panel ' || k AS material FROM b WHERE l_orderkey IN (SELECT l_orderkey FROM e)""",
)
def schedule_rows(spark, sf_dir):
    """A number next to the key or one word on; others lack the unit or stand too far away. Of the legend's materials
    every fifth is measured by length, and every seventh key has none."""
    rows = table(spark, sf_dir, "lineitem")
    k, n = F.col("l_partkey") % 90, F.col("l_linenumber") % 4
    key = F.concat(F.lit("FC-"), k.cast("string"))
    sf = F.format_number((F.col("l_quantity").cast("bigint") * 10).cast("bigint"), 0)
    words = F.when(n == 0, F.array(key, sf, F.lit("SF"))).when(n == 1, F.array(F.lit("x"), key, F.lit("PANEL"), sf, F.lit("s.f."), F.lit("y"))).when(n == 2, F.array(key, F.lit("PANEL"), sf, F.lit("EA"))).otherwise(F.array(key, F.lit("A"), F.lit("B"), sf, F.lit("SF")))
    legend = rows.filter(k % 7 != 0).select("l_orderkey", key.alias("key"), F.when(k % 5 == 0, F.lit("Metal coping")).otherwise(F.concat(F.lit("Panel "), k.cast("string"))).alias("material")).distinct()
    return schedules.material_schedule(rows.select("l_orderkey", words.alias("words")), legend, ["l_orderkey"])


@register(
    "loose_schedule",
    """
    WITH r AS (SELECT l_orderkey AS d, l_linenumber % 3 AS page, l_linenumber AS line, 'FC-P' || l_partkey % 90 AS key, l_partkey % 90 AS k, CAST(l_quantity AS BIGINT) * 10 AS sf, l_linenumber % 5 AS form FROM lineitem),
         e AS (SELECT d, page, line, key, k, sf, 0 AS pos FROM r WHERE form IN (0, 1) UNION ALL SELECT d, page, line, key, k, sf, 3 FROM r WHERE form = 4 UNION ALL SELECT d, page, line, '9', NULL, 60, 0 FROM r WHERE form = 4),
         m AS (SELECT *, CASE WHEN k IS NULL OR k % 7 = 0 THEN '' ELSE 'Panel ' || k END AS material FROM e WHERE sf >= 50 AND NOT coalesce(k % 7 <> 0 AND k % 5 = 0, false))
    SELECT d AS l_orderkey, key, max(sf) AS sf, arg_min(material, (-sf, page, line, pos)) AS material FROM m GROUP BY 1, 2""",
)
def loose_schedule(spark, sf_dir):
    """Rows of five forms: a key and its number; a word between them; no unit; the number out of reach; and two keys in one row.
    Every fifth key is measured by length, and every seventh has no name."""
    rows = table(spark, sf_dir, "lineitem")
    k, n = F.col("l_partkey") % 90, F.col("l_linenumber") % 5
    key = F.concat(F.lit("FC-P"), k.cast("string"))
    sf = F.format_number((F.col("l_quantity").cast("bigint") * 10).cast("bigint"), 0)
    word = lambda *parts: F.array(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    words = F.when(n == 0, word(key, sf, "SF")).when(n == 1, word("x", key, "PANEL", sf, "s.f.", "y")).when(n == 2, word(key, "PANEL", sf, "EA")).when(n == 3, word(key, "A", "B", sf, "SF")).otherwise(word("9", "60", "sf", key, sf, "SQ"))
    page = (F.col("l_linenumber") % 3).alias("page")
    legend = rows.filter(k % 7 != 0).select("l_orderkey", page, key.alias("key"), F.when(k % 5 == 0, F.lit("Metal coping")).otherwise(F.concat(F.lit("Panel "), k.cast("string"))).alias("material")).distinct()
    return schedules.loose_schedule(rows.select("l_orderkey", page, F.col("l_linenumber").alias("row"), words.alias("words")), legend, "l_orderkey", "page")


@register(
    "opening_schedule",
    """
    WITH p AS (SELECT p_partkey, p_brand, p_size, p_partkey % 3 AS form, p_size % 20 + 1 AS w, p_partkey % 62 AS h FROM part)
    SELECT p_brand, p_partkey, form = 1 AS door, CASE WHEN form = 2 THEN '?' ELSE 'W' || p_size END AS mark, (w + 0.5)::DOUBLE AS width_ft, h::DOUBLE AS height_ft, CASE WHEN form = 0 THEN p_size % 4 + 1 ELSE 1 END AS qty,
           round((w + 0.5) * h * CASE WHEN form = 0 THEN p_size % 4 + 1 ELSE 1 END, 1)::DOUBLE AS area_sf FROM p WHERE h BETWEEN 1 AND 60""",
)
def opening_schedule(spark, sf_dir):
    """Three tables a brand: width and height with quantities, a door table in inches, and one size column without marks."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    form, w, h = k % 3, F.col("p_size") % 20 + 1, k % 62
    text = lambda c, *rest: F.concat(c.cast("string"), *map(F.lit, rest))
    cells = F.when(form == 0, F.array(F.concat(F.lit("W"), n), text(w, "'-6\""), text(h, "'-0\""), text(F.col("p_size") % 4 + 1, " EA"))).when(form == 1, F.array(text(h * 12, "\""), F.concat(F.lit(" W"), n, F.lit(" ")), text(w, "'-6\""))).otherwise(F.array(F.concat(text(w, "'-6\" x "), text(h, "'"))))
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", form.alias("form"), k.alias("row"), cells.alias("cells"))
    heads = F.when(F.col("form") == 0, F.array(*map(F.lit, ["Mark", "Width", "Hgt", "Qty"]))).when(F.col("form") == 1, F.array(*map(F.lit, ["Door height", "Tag", "Wide"]))).otherwise(F.array(F.lit("Rough opening")))
    header = part.select("p_brand", "form").distinct().select("p_brand", F.lit(0).cast("bigint").alias("p_partkey"), "form", F.lit(0).cast("bigint").alias("row"), heads.alias("cells"))
    out = schedules.opening_schedule(part.withColumns({"row": F.col("row").cast("bigint"), "p_partkey": k.cast("bigint")}).unionByName(header), ["p_brand", "form"])
    return out.select("p_brand", F.col("row").alias("p_partkey"), "door", "mark", "width_ft", "height_ft", "qty", "area_sf")


@register("text_export", "SELECT conv_id, CAST(1 AS INTEGER) AS page, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def text_export(spark, sf_dir):
    """Each conversation as a document of one page, its turns the page's text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.lit(1).alias("page"), "turn", "text")
    return schedules.text_export(rows, "conv_id", "page", "turn", "text")
