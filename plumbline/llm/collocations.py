"""Operator 12: collocations, as DataFrame operations over exploded n-grams.

1. Texts are cut into pieces at stops, pieces into words. Each position gives one row for each n-gram of 1 .. max_n words that starts
   there, and rows are counted by phrase and language, which travel as one text with a tab between (no word holds one). Partial sums
   come before the shuffle, so a phrase that stands everywhere costs a row a task. The longest phrases are counted apart. Phrases counted `least` times or more are written; everything below reads that table, as parts of such a phrase
   are no rarer than it is.
2. Each cut of a candidate joins the counts of what stands before and after it. A common first word makes a large key on the side
   of the candidates only (the counts hold each phrase once), which adaptive execution splits. Score: floor(scale a^2 / (l r)) in
   Decimal(38, 0), exact while scale a^2 has at most 38 digits (a up to 10^16 for a scale of 10^6); the lowest cut counts.
3. Of two phrases, one inside the other, the shorter goes where the longer has at least `share` hundredths of its count. It is enough to
   look at phrases one word longer: what stands between the two is no rarer than the longer one, and so a candidate as well.
   These are brought to one row a shorter phrase (the largest count) and anti-joined.
4. The first `top` of each language are ranked in two steps, by SALTS parts of a language and then over the parts' first ones, so that the
   last step reads at most SALTS * top rows a language, whatever the table holds.

Nulls and edge cases: a null text is empty; a null language is `und` and counts as one with it; words of one piece alone make
phrases, blanks and tabs do not count; repeated rows count each time; ids are not read; an empty table, or one without phrases, gives no rows;
other columns are ignored, whatever their names. Ties in score and count go by the UTF-8 bytes of the phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, keep, quoted

STOPS = "[.,;:!?\\x0A-\\x0D]"
BLANKS = "[\\x20\\x09]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of a language in the first step of the ranking.
SALTS = 32


def lowered(text: Column) -> Column:
    """A-Z in small letters. Texts of ASCII alone, where both are the same, take the quicker function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def ngrams(docs: DataFrame, least_n: int, max_n: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(key): a row for each n-gram of least_n .. max_n words at each place: its words, a tab, its language."""
    lang = F.concat(F.lit("\t"), F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")))
    texts = docs.select(lang.alias("lang"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    pieces = texts.select("lang", F.explode(F.split(lowered(F.col("text")), STOPS)).alias("piece"))
    words = pieces.select("lang", F.explode(F.array(F.array_remove(F.split("piece", BLANKS), ""))).alias("w"))  # a generator of one element: split once
    places = words.select("lang", "w", F.posexplode("w").alias("i", "p1"))
    each = [F.col("p1")]
    for n in range(1, max_n):
        each += [F.lit(" "), F.get(F.col("w"), F.col("i") + n)]  # null beyond the end of the piece
    grams = F.array(*[F.concat(*each[: 2 * n + 1], F.col("lang")) for n in range(least_n - 1, max_n)])
    return places.select(F.explode(grams).alias("key")).filter("key is not null")


def _cuts(candidates: DataFrame) -> DataFrame:
    """A row for each cut of a candidate: k, and the phrases before and after it."""
    each = candidates.filter("n >= 2").select("lang", "n", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    each = each.withColumn("left", F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k")))
    return each.withColumn("right", F.substr("phrase", F.char_length("left") + 2))


def score(scale: int) -> Column:
    """floor(scale a^2 / (l r)) of the columns a, l and r, in Decimal."""
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r"))
    return F.call_function("div", a * a * F.lit(scale).cast("decimal(10,0)"), l * r).cast("bigint")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000, scale: int = 1_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, words, cut, a, l, r, n, score): the first `top` phrases of each language."""
    phrase, lang = F.substring_index("key", "\t", 1), F.substr("key", F.instr("key", "\t") + 1)

    def counted(low: int, high: int) -> DataFrame:
        # where a task's counts outgrow its memory they are sorted, and most keys differ in their first bytes
        counts = ngrams(docs, low, high, text_col, lang_col).groupBy("key").agg(F.count(F.lit(1)).alias("a"))
        # words that are rarer than `least` count in n, and are kept as one row a language
        some = counts.select(phrase.alias("phrase"), lang.alias("lang"), "a").filter((F.col("a") >= least) | ~F.contains("phrase", F.lit(" ")))
        return keep(some.groupBy(F.when(F.col("a") >= least, F.col("phrase")).alias("phrase"), "lang").agg(F.sum("a").alias("a")), "phrases")

    # the longest phrases, about half of all different ones, apart from the others: their shuffle files are not there at one time
    kept = counted(1, max(1, max_n - 1))
    if max_n > 1:
        kept = kept.unionByName(counted(max_n, max_n))
    one = ~F.contains("phrase", F.lit(" "))
    totals = kept.groupBy("lang").agg(F.sum(F.when(F.coalesce(one, F.lit(True)), F.col("a"))).alias("total"))
    phrases = kept.filter("phrase is not null").withColumn("n", F.octet_length("phrase") - F.octet_length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    cuts = _cuts(phrases)
    scored = (
        cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
        .join(phrases.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
        .withColumn("score", score(scale))
    )
    lowest = scored.groupBy("lang", "phrase").agg(F.first("n").alias("words"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    first, last = F.regexp_replace("phrase", " [^ ]*$", ""), F.regexp_replace("phrase", "^[^ ]* ", "")
    longer = phrases.filter("n > 2").select("lang", F.col("a").alias("b"), F.explode(F.array(first, last)).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    covered = lowest.select("lang", "phrase", "a").join(most, ["lang", "phrase"]).filter(100 * F.col("b").cast("decimal(20,0)") >= share * F.col("a").cast("decimal(20,0)")).select("lang", "phrase")
    left = keep(lowest.join(covered, ["lang", "phrase"], "left_anti"), "scored")
    drop_order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = left.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*drop_order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*drop_order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "words", F.col("cut.k").alias("cut"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))
