"""Operator 13: a reproducible shuffle into shards, by a Feistel permutation of global row numbers; DataFrame operations alone.

Rows are numbered 0 .. n-1 in the order of their keys. A row's place is a permutation of its number: shard = place mod shards and
slot = place div shards, so shards differ by one row at most, slots have no gap, and both can be computed for any row without
looking at another; `row_at` goes back from a shard and slot to the row number. Law `rows` of the contract holds, whatever
the sizes and copies of texts are: a group of equal texts is spread like any other rows.

The network works on pairs (left, right) with left < a and right < b, a = ceil(sqrt(n)) and b = ceil(n / a): one half gets a keyed
cubic of the other modulo its own radix, turn about. Fewer than a of the a * b pairs are no row numbers; a row that lands on one walks on until
it lands on a number. WALKS more steps are enough for certain where a <= WALKS, and too few with a chance below 2^-150 a row
elsewhere (of the pairs, less than one in b is no number); such a row stops the query and asks for another seed, as no row may be lost.

Numbering: rows are dealt by ranges of their keys, written, and counted a range; a range's first number is a running sum over ranges (one
small row each, at most spark.sql.shuffle.partitions of them, which is the bound of what is broadcast). The place of the row in the
input is the last key, so that a key that holds a third of all rows is dealt to several ranges too; rows that it tells apart are alike
in all keys.

Nulls and edge cases: a null key sorts first and its row gets a place as any other; rows that are alike in all keys get places of their
own; op13 takes a null text as no bytes (size 1, CRC 0); an empty table gives no rows; columns pass through, whatever their
names, but columns named row_no, shard and slot are replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, fresh, keep

#: Prime modulus of the round function, 2^31 - 1: products of two residues fit in 64 bits. Numbers below 2^62 can be permuted.
PRIME = 2147483647
ROUNDS = 6
WALKS = 32


def round_keys(seed: int) -> list[tuple[int, int]]:
    """A shift and a factor for each round."""
    rng = random.Random(seed)
    return [(rng.randrange(PRIME), rng.randrange(1, PRIME)) for _ in range(ROUNDS)]


def radices(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permuted(number: int, n: int, seed: int, backwards: bool = False) -> int:
    """Place of a row number below n (or, backwards, the row number of a place), for one number on its own."""
    a, b = radices(n)
    order = list(enumerate(round_keys(seed)))
    while True:
        left, right = divmod(number, b)
        for k, (shift, factor) in reversed(order) if backwards else order:
            value = pow(((left if k % 2 else right) + shift) % PRIME, 3, PRIME) * factor % PRIME * (-1 if backwards else 1)
            left, right = (left, (right + value) % b) if k % 2 else ((left + value) % a, right)
        number = left * b + right
        if number < n:
            return number


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """Number of the row that stands in a slot of a shard."""
    return permuted(slot * shards + shard, n, seed, backwards=True)


def place(number: Column, n: int, seed: int) -> Column:
    """`permuted` as a column."""
    a, b = radices(n)
    keys = F.array(*[F.struct(F.lit(s).cast("bigint").alias("shift"), F.lit(f).cast("bigint").alias("factor"), F.lit(k % 2 == 1).alias("odd")) for k, (s, f) in enumerate(round_keys(seed))])

    def turn(at: Column, key: Column) -> Column:
        t = F.pmod(F.when(key.odd, at.left).otherwise(at.right) + key.shift, F.lit(PRIME))
        value = F.pmod(F.pmod(F.pmod(t * t, F.lit(PRIME)) * t, F.lit(PRIME)) * key.factor, F.lit(PRIME))
        left = F.when(key.odd, at.left).otherwise(F.pmod(at.left + value, F.lit(a)))
        return F.struct(left.alias("left"), F.when(key.odd, F.pmod(at.right + value, F.lit(b))).otherwise(at.right).alias("right"))

    def once(value: Column) -> Column:
        start = F.struct(F.call_function("div", value, F.lit(b)).cast("bigint").alias("left"), F.pmod(value, F.lit(b)).cast("bigint").alias("right"))
        return F.aggregate(keys, start, turn, lambda at: at.left * F.lit(b) + at.right)

    # one step for every number, and further ones while it lands on none
    start = F.struct(number.cast("bigint").alias("v"), F.lit(False).alias("done"))
    step = lambda at, _: F.when(at.done, at).otherwise(_landed(once(at.v), n))
    lost = F.raise_error(F.lit(f"no place in {WALKS} steps: take another seed")).cast("bigint")
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS + 1)), start, step, lambda at: F.when(at.done, at.v).otherwise(lost))


def _landed(value: Column, n: int) -> Column:
    return F.get(F.transform(F.array(value), lambda v: F.struct(v.alias("v"), (v < n).alias("done"))), F.lit(0))


def numbered(df: DataFrame, keys: list[Column], into: str) -> tuple[DataFrame, int]:
    """df with a number from 0 for each row in the order of keys, without a task that sees all rows, and the number of rows."""
    names = fresh(df.columns, *[f"k{i}" for i in range(len(keys))], "came", "stood")
    own, came, stood = names[:-2], names[-2], names[-1]
    first = df.withColumns(dict(zip(own, keys, strict=True))).drop(into)
    rows = keep(first.withColumn(came, F.monotonically_increasing_id()), "rows")  # before the ranges, which read it twice
    dealt = rows.repartitionByRange(*own, came).sortWithinPartitions(*own, came).drop(*own, came)
    dealt = keep(dealt.withColumn(stood, F.monotonically_increasing_id()), "ranges")  # number of the range, and of the row within it in the lowest 33 bits
    drop(rows)
    part, size, begin = fresh(df.columns, "part", "size", "begin")
    counts = dealt.groupBy(F.shiftrightunsigned(stood, 33).alias(part)).agg(F.count(F.lit(1)).alias(size))
    before = F.coalesce(F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.withColumn(begin, before).drop(size))
    joined = dealt.withColumn(part, F.shiftrightunsigned(stood, 33)).join(starts, part)
    return joined.withColumn(into, F.col(begin) + F.col(stood).bitwiseAND(F.lit((1 << 33) - 1))).drop(part, begin, stood), dealt.count()


def shard(df: DataFrame, keys: list[Column], shards: int, seed: int = 13) -> DataFrame:
    """df with row_no (number in the order of keys), shard and slot."""
    rows, n = numbered(df, keys, "row_no")
    at = fresh(rows.columns, "at")[0]
    placed = rows.withColumn(at, F.explode(F.array(place(F.col("row_no"), max(n, 1), seed))))  # a generator of one element: computed once
    return placed.withColumns({"shard": F.pmod(at, F.lit(shards)).cast("int"), "slot": F.call_function("div", F.col(at), F.lit(shards)).cast("bigint")}).drop(at)


def write_shards(placed: DataFrame, path: str, files: int) -> None:
    """Writes a table of `shard` as Parquet, a folder a shard; each of about `files` files holds a range of slots of a shard, in order."""
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) of documents."""
    data = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).cast("bigint").alias("text_crc32"))
