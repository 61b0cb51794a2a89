"""Operator 1: line dedup by an exact set-similarity join, in DataFrame operations alone.

A line's tokens are its distinct word shingles (five words; a shorter line is one token), so a line is removed when an
earlier line (smaller doc_id, or earlier in the document), kept or not, has a Jaccard similarity of 4/5 or more.

1. Equal lines are one class; all but its first line repeat. A line of fewer than five words has no other partner. Copies of
   a class that holds more than 1 / HOT of all lines (at most HOT classes do) fall away before tokens are made.
2. Tokens are ordered by rarity: shingles of all lines are counted in a table of fixed size, and a token ranks by the count of
   its cell against the mean, then by its hash. So the passages that many lines share come last.
3. Prefix filter: similar sets share a token of the first n - ceil(4n/5) + 1. Only those cross the network, once, as (token,
   class, length, position). A token that one class alone holds goes no further.
4. Length and positional filters: a pair needs lengths within 4/5, and its common prefix tokens with what can follow the last
   of them must reach the overlap. Each class first meets only the earliest class of each of its tokens, one row a token; only
   classes without a match so far meet all others. So a group of near copies gives rows in proportion to its size where its
   first line resembles the rest.
5. Jaccard is verified on the whole sets of the pairs that are left.

Tables between steps are deleted when the last reader is done, and shuffle files with the step that wrote them.

Nulls and edge cases: a null text stays null, with no lines; blank lines (no words) are never removed and match nothing;
rows without doc_id stay as they are; rows that repeat a doc_id take part as one document (equal places are one place),
and both return; words are split at white space and lower-cased; other columns pass through, whatever their names, but columns
named n_lines and n_removed are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop, fresh, keep, quoted, salted_join

#: Cells of the shingle counts; the table of their ranks is a literal of the plan.
CELLS = 1 << 16
#: Classes with more than this share of all lines are at most so many, and are broadcast.
HOT = 8192
SHINGLE, NUM, DEN = 5, 4, 5
#: Bits of the filter of documents whose lines are compared.
BITS = 1 << 20


def needed(n: Column) -> Column:
    return F.ceil(n * NUM / DEN).cast("int")


def _plain(line: Column) -> Column:
    """The line's words, lower-cased, one blank between them. A pattern runs only where there is something to change."""
    low = F.lower(line)
    odd = F.contains(low, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(low, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(low, "[\\x20\\x09\\x0B-\\x0D]+", " ")).otherwise(low))


def _identity(plain: Column) -> tuple[Column, Column]:
    """96 bits of a line's words, as two numbers."""
    return F.xxhash64(plain), F.hash(plain)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once a row: inside a lambda a plain column would be computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return rows.filter("doc_id is not null and text is not null")


def lines_of(texts: DataFrame) -> DataFrame:
    """(doc_id, line_no, plain) of all lines; plain is empty where there are no words."""
    rows = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", _plain(F.col("line")).alias("plain"))


def _with_hashes(lines: DataFrame, *columns: str) -> DataFrame:
    """columns and h, the hashes of the line's words, of lines with a shingle at least."""
    # a generator of one element: what follows reads the array instead of computing it again
    return lines.select(*columns, F.explode(F.array(F.transform(F.split("plain", " "), lambda w: F.xxhash64(w)))).alias("h")).filter(F.size("h") >= SHINGLE)


def _shingle(h: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)])


def _all_shingles() -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("h") - SHINGLE), lambda i: _shingle(F.col("h"), i))


def rarity(hashed: DataFrame) -> Column:
    """Literal array: rank of each cell by how many shingles of all lines fall in it, against the mean; 16 ranks double it. Ranks stand in the
    high bits, where tokens have them."""
    at = hashed.select("h", F.explode(F.sequence(F.lit(0), F.size("h") - SHINGLE)).alias("i"))
    cell = _shingle(F.col("h"), F.col("i")).bitwiseAND(F.lit(CELLS - 1)).cast("int")
    counts = at.groupBy(cell.alias("cell")).count().collect()  # at most CELLS rows
    mean = sum(r["count"] for r in counts) / CELLS
    rank = ["0"] * CELLS
    for r in counts:
        rank[r["cell"]] = str(max(0, min(255, round(64 + 16 * math.log2(r["count"] / mean)))) << 55)
    return F.split(F.lit(",".join(rank)), ",").cast("array<bigint>")


def _tokens(each: DataFrame) -> DataFrame:
    """(x, t): the distinct tokens of each line, in order."""
    return each.select("x", F.sort_array(F.array_distinct("t")).alias("t"))


def _prefix(hashed: DataFrame, rank: Column) -> DataFrame:
    """(x, token, m): the prefix of each line's tokens; m packs how many tokens the line has, and how many come before."""
    # a token is never null, so that arrays of them are told apart and sorted as plain numbers
    high = lambda v: F.coalesce(F.get(rank, v.bitwiseAND(F.lit(CELLS - 1)).cast("int")), F.lit(0).cast("bigint"))
    token = lambda v: high(v).bitwiseOR(F.shiftrightunsigned(v, 9))
    t = _tokens(hashed.select("x", F.explode(F.array(F.transform(_all_shingles(), token))).alias("t")))
    n = F.size("t")
    at = t.select("x", n.alias("n"), F.posexplode(F.slice("t", F.lit(1), n - needed(n) + 1)).alias("p", "token"))
    return at.select("x", "token", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("p")).alias("m"))


def _pairs(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Candidate (doc_id, line_no, d, l) of two tables of prefix tokens, through order, length and positional filters."""
    a, b = later.alias("a"), earlier.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    order = (F.col("b.doc_id") < F.col("a.doc_id")) | ((F.col("b.doc_id") == F.col("a.doc_id")) & (F.col("b.line_no") < F.col("a.line_no")))
    length = F.least(n, m) * DEN >= F.greatest(n, m) * NUM
    least = F.ceil((n + m) * NUM / (NUM + DEN)).cast("int")
    # with the first common token at these places, no more than this can be shared; later common tokens stand further on
    place = F.least(n - F.col("a.p"), m - F.col("b.p")) >= least
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & order & length & place).select("a.doc_id", "a.line_no", F.col("b.doc_id").alias("d"), F.col("b.line_no").alias("l"), least.alias("least"), (n - F.col("a.p")).alias("u"), (m - F.col("b.p")).alias("v"))
    # all common tokens up to the last of these are among these: they, and what can still follow in either
    both = met.groupBy("doc_id", "line_no", "d", "l").agg(F.count(F.lit(1)).alias("c"), F.max("least").alias("least"), F.min("u").alias("u"), F.min("v").alias("v"))
    return both.filter(F.col("c") + F.least("u", "v") - 1 >= F.col("least")).select("doc_id", "line_no", "d", "l")


def _bits(ids: DataFrame) -> Column:
    """Literal array of BITS bits, one set for each doc_id: a filter of fixed size that lets some others through."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    words = ids.select((place / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()  # at most BITS / 64 rows
    bits = ["0"] * (BITS // 64)
    for r in words:
        bits[r["w"]] = str(r["b"])
    return F.split(F.lit(",".join(bits)), ",").cast("array<bigint>")


def _sets(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, t) with the distinct shingles of the given lines. Texts move once, and only those in question."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    bit = F.call_function("getbit", F.get(_bits(lines.select("doc_id")), (place / 64).cast("int")), (place % 64).cast("int"))
    wanted = lines.groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted"))
    pick = lambda ls: F.transform("wanted", lambda i: F.struct(i.alias("line_no"), F.get(ls, i).alias("line")))
    at = texts.filter(bit == 1).join(wanted.hint("merge"), "doc_id").select("doc_id", F.explode(_let(F.split("text", "\n"), pick)).alias("w"))
    at = at.select("doc_id", "w.line_no", _plain(F.col("w.line")).alias("plain"))
    return _with_hashes(at, "doc_id", "line_no").select("doc_id", "line_no", F.array_distinct(_all_shingles()).alias("t"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, line_no) of pairs whose whole sets reach the similarity. A repeated id may give a place more than one text."""
    pairs = keep(pairs, "pairs")
    ends = pairs.select("doc_id", "line_no").unionByName(pairs.select(F.col("d").alias("doc_id"), F.col("l").alias("line_no"))).distinct()
    sets = keep(_sets(texts, ends), "sets")
    b = sets.select(F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.col("t").alias("s"))
    both = F.size(F.array_intersect("s", "t"))
    near = pairs.join(sets, ["doc_id", "line_no"]).join(b, ["d", "l"]).filter(both * DEN >= (F.size("s") + F.size("t") - both) * NUM)
    out = keep(near.select("doc_id", "line_no").distinct(), "near")
    drop(pairs, sets)
    return out


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, gone): the numbers of the lines to remove, of documents that have any."""
    texts = _texts(docs, id_col, text_col)
    x, x2 = _identity(F.col("plain"))
    once = lines_of(texts).select("doc_id", "line_no", F.explode(F.array("plain")).alias("plain"))  # so that the filter doesn't compute it again
    lines = keep(once.filter("plain <> ''").select("doc_id", "line_no", x.alias("x"), x2.alias("x2")), "lines")
    # the first line of each class: places as one number, so that the least combines before the shuffle
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("line_no")
    found = lines.groupBy("x", "x2").agg(F.min(place.cast("decimal(38,0)")).alias("at"), F.count(F.lit(1)).alias("c"))
    line_no = F.pmod("at", F.lit(1 << 32).cast("decimal(38,0)"))
    classes = keep(found.select("x", "x2", "c", line_no.cast("int").alias("line_no"), ((F.col("at") - line_no) / F.lit(1 << 32).cast("decimal(11,0)")).cast("bigint").alias("doc_id")), "classes")
    total = classes.agg(F.sum("c")).first()[0] or 0

    rank = rarity(_with_hashes(lines_of(texts)))
    hot = classes.filter((F.col("c") > 1) & (F.col("c") * HOT > total)).select(F.col("x").alias("hx"), F.col("doc_id").alias("hd"), F.col("line_no").alias("hl"))  # fewer than HOT rows
    copy = (F.col("x") == F.col("hx")) & ((F.col("doc_id") != F.col("hd")) | (F.col("line_no") != F.col("hl")))
    told = lines_of(texts).select("doc_id", "line_no", x.alias("x"), "plain").join(F.broadcast(hot), copy, "left_anti")
    by_token = Window.partitionBy("token")
    prefix = _prefix(_with_hashes(told, "x"), rank).withColumns({"lo": F.min("x").over(by_token), "hi": F.max("x").over(by_token)})
    shared = keep(prefix.filter("lo < hi").groupBy("token", "x").agg(F.max("m").alias("m")), "tokens")
    place = [F.shiftright("m", 32).cast("int").alias("n"), F.col("m").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("p")]
    light = keep(shared.join(classes.select("x", "doc_id", "line_no"), "x").select("token", "doc_id", "line_no", *place), "light")
    drop(shared)
    first = light.groupBy("token").agg(F.min(F.struct("doc_id", "line_no", "n", "p")).alias("f")).select("token", "f.*")
    near = _verified(_pairs(light, first), texts)
    rest = light.join(near, ["doc_id", "line_no"], "left_anti")
    more = _verified(_pairs(rest, light), texts)
    drop(light)

    heads = classes.filter("c > 1").select("x", "x2", F.col("doc_id").alias("d"), F.col("line_no").alias("l"))
    copies = salted_join(lines, heads, ["x", "x2"], "doc_id", 16).filter("doc_id <> d or line_no <> l").select("doc_id", "line_no")
    # one row a document
    gone = keep(near.unionByName(more).unionByName(copies).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")), "gone")
    drop(lines, classes, near, more)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeated lines, and columns n_lines and n_removed. A text keeps its other line breaks."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, gone = fresh(docs.columns, "key", "gone")
    found = removed_lines(docs, id_col, text_col).select(F.col("doc_id").alias(key), F.col("gone").alias(gone))
    rows = docs.join(found.hint("merge"), F.col(quoted(id_col)).cast("bigint") == F.col(key), "left")
    text, gone = F.col(quoted(text_col)).cast("string"), F.col(gone)
    lines = F.split(text, "\n")
    # a row that repeats an id may be shorter than the line numbers found
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(_let(lines, lambda ls: F.transform(left, lambda i: F.get(ls, i))), "\n")
    whole = gone.isNull() | text.isNull()
    removed = F.when(whole, 0).otherwise(F.size(lines) - F.size(left)).cast("bigint")
    n = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    columns = [(F.when(whole, text).otherwise(kept) if c == text_col else F.col(quoted(c))).alias(c) for c in own]
    return rows.select(*columns, n.alias("n_lines"), removed.alias("n_removed"))


def brute_force(texts: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str | None]]:
    """doc_id, n_lines, n_removed and text by comparing lines that share a token; for tests."""
    import re

    lines, by_token = [], {}
    for d, text in sorted({x for x in texts if x[1] is not None}):
        for k, line in enumerate(text.split("\n")):
            w = [x for x in re.split("[\x20\x09-\x0d]+", line.lower()) if x]
            if w:
                s = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} if len(w) >= SHINGLE else {tuple(w)}
                lines.append((d, k, s))
    gone: dict[int, set[int]] = {}
    for j, (d, k, s) in enumerate(lines):
        counts: dict[int, int] = {}
        for token in s:
            for i in by_token.get(token, ()):
                counts[i] = counts.get(i, 0) + 1
            by_token.setdefault(token, []).append(j)
        if any(DEN * c >= NUM * (len(s) + len(lines[i][2]) - c) for i, c in counts.items()):
            gone.setdefault(d, set()).add(k)
    out = []
    for d, text in texts:
        all_lines = [] if text is None else text.split("\n")
        g = gone.get(d, set())
        out.append((d, len(all_lines), len(g), None if text is None else "\n".join(x for k, x in enumerate(all_lines) if k not in g)))
    return out
