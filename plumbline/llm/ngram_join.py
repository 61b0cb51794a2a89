"""Operator 3: n-gram Jaccard join as a T-occurrence search.

Two documents of n and m distinct shingles link when their overlap reaches t (n + m) / (1 + t); so either must share at
least T = ceil(t n) of its own. DivideSkip: of a document's n inverted lists the T - 1 longest may be set aside, and a
partner must still stand in one of the others. Those short lists are merged first, over the whole corpus; the long
lists are then probed by binary search, for the documents that the short ones name.

1. Whole shingle sets, once for each distinct set; equal sets are one class: a task posts a set once, rows of one set from several
   tasks are one where they meet, and only the class's first document is compared.
2. A frequency sketch of fixed size over all shingles orders a set by rarity, so that long lists are the ones set
   aside. It only orders: any order gives the same links.
3. Short-list rows (shingle, document) meet by shingle; LEAST - 1 more lists than must be are merged, so that a partner stands
   on LEAST of them, and chance meetings of one shingle name nobody. Up to `short` rows of a shingle pair up directly, and so do longer
   lists whose sizes leave no more pairs a row than that: unlike documents that share a passage by chance, so LEAST holds for them too.
   Other lists go out as members: a task that sees more than `short` rows of one shingle marks the list as such and sends the rest past
   the shuffle by shingle, so a shingle gathers few rows a task, however common it is.
4. Whole sets of the named documents are compared: pairs one document at a time; long lists (or all that they join, where
   that sends fewer sets) in blocks of about `block` members, each within itself and with the list's first document. What links
   with that one, by whatever way, is done; only the rest of a list of several blocks meets all of it, block by block. So a
   group of near copies sends sets in proportion to its size, and a list whose members do not resemble its first document
   as the rest times the list. A block sends back a spanning forest, never its pairs.
5. Components over the links of step 4.

The short lists are merged by sorting and counting, the long ones probed by binary search (Lists.search).

Nulls and edge cases: null or wordless text has an empty set, links with nothing and is its own component; a text of
fewer than n words has one shingle, its whole sequence; rows without doc_id are left out; rows with equal doc_id are one
node (their sets unite in one class row each, and both rows return); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .components import connected_components
from .shared import drop, identified, keep, salted_join

CELLS = 1 << 18
#: Bits of the table that tells which texts move.
BITS = 1 << 24


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the offsets."""
    buf, off = K.flat(texts)
    buf = K.LOWER[buf]
    s, e, woff = K.words(buf, off, K.SPACES)
    hashes = K.word_hash(buf, s, e)
    grams = K.gram_hash(hashes, n)
    starts, per = K.gram_starts(woff, n)
    count = np.diff(woff)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.array([int(K.mix(K.gram_hash(hashes[woff[d] : woff[d + 1]], int(count[d])) + K.U(int(count[d])))[0]) for d in short], K.U)
    doc = np.concatenate([np.repeat(np.arange(len(per)), per), short])
    value = np.concatenate([grams[starts], whole])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(off)))


def needed(n: int | np.ndarray, num: int, den: int):
    """Least overlap of a set of n with any partner."""
    return (num * n + den - 1) // den


#: Occurrences on the short lists that name a candidate.
LEAST = 3


def merge_least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """With T - LEAST lists set aside (fewer for small sets), a partner stands on at least this many of the others."""
    return np.minimum(LEAST, needed(n, num, den))


def linked(common, n, m, num: int, den: int):
    """Jaccard of at least num / den, in whole numbers."""
    return den * common >= num * (n + m - common)


def signature(value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set: equal sets have equal sums."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(value ^ K.U(salt)))])
        out.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
    return out[0], out[1]


class Lists:
    """Inverted lists of a block of sets, and the DivideSkip search over them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate([np.zeros(0, K.U), *sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, tokens))
        self.owner = owner[order]
        self.tokens, first = np.unique(tokens[order], return_index=True)
        self.begin = np.append(first, len(order))

    def search(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Members of the block that link with the query set."""
        n = len(query)
        if not n or not len(self.tokens):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        least = int(needed(n, num, den))
        if len(at) < least:
            return np.zeros(0, np.int64)
        length = self.begin[at + 1] - self.begin[at]
        at = at[np.argsort(length, kind="stable")]
        cut = len(at) - (least - 1)  # the least - 1 longest lists are set aside
        short, long = at[:cut], at[cut:]
        merged = self.owner[K.ranges(self.begin[short], self.begin[short + 1] - self.begin[short])]
        common = np.bincount(merged, minlength=len(self.sizes))
        named = np.flatnonzero(common)
        m = self.sizes[named]
        named = named[(m * den >= num * n) & (n * den >= num * m)]
        common = common[named]
        if len(long) * len(named) > 4 * int((self.begin[long + 1] - self.begin[long]).sum()):  # so many that reading the lists costs less
            all_long = np.bincount(self.owner[K.ranges(self.begin[long], self.begin[long + 1] - self.begin[long])], minlength=len(self.sizes))
            common = common + all_long[named]
        else:
            for k in long:
                own = self.owner[self.begin[k] : self.begin[k + 1]]
                where = np.minimum(np.searchsorted(own, named), len(own) - 1)
                common = common + (own[where] == named)
        return named[linked(common, n, self.sizes[named], num, den)]


def forest(n: int, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges that join what was apart."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _sketch(rows: DataFrame, n: int) -> np.ndarray:
    """How many distinct sets hold a shingle of each of CELLS cells: counts over all rows, of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(CELLS, np.int64), set()
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                value, off = shingle_sets(piece.column("text"), n)
                keys = signature(value, off)[0].tolist()
                fresh = np.zeros(len(keys), bool)
                for k, key in enumerate(keys):
                    if key not in seen:
                        seen.add(key)
                        fresh[k] = True
                total += np.bincount((value[np.repeat(fresh, np.diff(off))] & K.U(CELLS - 1)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(CELLS, np.int64)
    table = rows.select("text").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    out[table["cell"].to_numpy()] = table["n"].to_numpy()
    return np.minimum(np.log2(np.maximum(out, 1)) * 4, 255).astype(np.uint8)


def similarity_classes(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, short: int = 32, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard num/den or more) for each row of docs."""
    spark = docs.sparkSession
    rows = identified(docs)
    rarity = spark.sparkContext.broadcast(_sketch(rows, n))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a document (set size and signature), and its short-list rows if its set is new to this task."""
        seen, held = set(), {}
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                value, off = shingle_sets(piece.column("text"), n)
                size, ids = np.diff(off), piece.column("doc_id").to_numpy()
                k1, k2 = signature(value, off)
                fresh = np.zeros(len(size), bool)
                for k, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                    if size[k] and key not in seen:
                        seen.add(key)
                        fresh[k] = True
                doc = np.repeat(np.arange(len(size)), size)
                rank = rarity.value[(value & K.U(CELLS - 1)).astype(np.int64)]
                order = np.lexsort((value, rank, doc))
                position = np.arange(len(value)) - off[doc]
                shorts = size - needed(size, num, den) + merge_least(size, num, den)
                use = fresh[doc] & (position < shorts[doc])
                token, owner = value[order][use], doc[use]
                # rows of one shingle beyond `short` in this piece go past the shuffle
                by = np.argsort(token, kind="stable")
                new = np.ones(len(by), bool)
                new[1:] = token[by][1:] != token[by][:-1]
                group_at = np.flatnonzero(new)
                nth = np.empty(len(by), np.int64)
                nth[by] = np.arange(len(by)) - np.repeat(group_at, np.diff(np.append(group_at, len(by))))
                counts = np.diff(np.append(group_at, len(by)))
                busy = counts > 4
                extra = np.zeros(len(token), np.int64)
                for t, c, at in zip(token[by][group_at[busy]].tolist(), counts[busy].tolist(), group_at[busy].tolist(), strict=True):
                    extra[by[at : at + c]] = held.get(t, 0)
                    held[t] = held.get(t, 0) + c
                over, last = nth + extra > short, nth + extra == short  # rows may follow the last one, so it marks its list
                m, named = len(token), k1[owner]  # a set goes by its signature
                kind = np.concatenate([np.zeros(len(size), np.int8), np.where(over, 2, 1).astype(np.int8)])
                key = np.concatenate([k1, token.view(np.int64)])
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(kind), "spread": pa.array(np.concatenate([ids, np.where(over, ids[owner], token.view(np.int64))])), "key": pa.array(key),
                    "key2": pa.array(np.concatenate([k2, last.astype(np.int64)])), "doc": pa.array(np.concatenate([ids, named])), "n": pa.array(np.concatenate([size, size[owner]]).astype(np.int32)),
                })

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Short lists as pairs (kind 1: key, doc), long ones as members (kind 2: shingle, doc), of sets; document rows (0) pass."""
        names = ("kind", "key", "key2", "doc", "n")
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            c = [batch.column(x).to_numpy() for x in names]
            passing = c[0] != 1
            if passing.any():
                yield pa.RecordBatch.from_pydict({x: pa.array(y[passing]) for x, y in zip(names, c, strict=True)})
            parts.append([y[~passing] for y in c[1:]])
        if not parts:
            return
        key, mark, doc, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((-mark, doc, size, key))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (key, size, doc)], axis=0)
        order = order[new]  # a set that several tasks posted is one row
        key, mark, doc, size = key[order], mark[order], doc[order], size[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(key)))
        group = np.repeat(np.arange(len(at)), count)
        # partners of a row: those after it in its list that are not too large
        ends = np.searchsorted((group << 32) + size, (group << 32) + np.minimum(size * den // num, (1 << 32) - 1), "right")
        partners = ends - np.arange(len(key)) - 1
        alone = (count <= short) | ((np.add.reduceat(partners, at) <= count * (short // 2)) & (np.maximum.reduceat(mark, at) == 0)) if len(at) else np.zeros(0, bool)
        partners[~np.repeat(alone, count)] = 0
        a = np.repeat(np.arange(len(key)), partners)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(partners) - partners, partners)
        ok = doc[a] != doc[b]
        a, b = a[ok], b[ok]
        a, b = np.where(doc[a] < doc[b], a, b), np.where(doc[a] < doc[b], b, a)
        least = merge_least(np.minimum(size[a], size[b]), num, den)
        pair, back, times = np.unique(np.stack([doc[a], doc[b]], 1), axis=0, return_inverse=True, return_counts=True)
        wants = np.full(len(pair), LEAST, np.int64)
        np.minimum.at(wants, back.ravel(), least)
        long = K.ranges(at[~alone], count[~alone])
        for k in range(0, len(pair), 1 << 18):
            own = slice(k, k + (1 << 18))
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(times[own]), np.int8)), "key": pa.array(pair[own, 0]), "key2": pa.array(wants[own]), "doc": pa.array(pair[own, 1]), "n": pa.array(times[own].astype(np.int32))})
        for k in range(0, len(long), 1 << 18):
            p = long[k : k + (1 << 18)]
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(p), 2, np.int8)), "key": pa.array(key[p]), "key2": pa.array(np.zeros(len(p), np.int64)), "doc": pa.array(doc[p]), "n": pa.array(size[p].astype(np.int32))})

    dealt = rows.mapInArrow(postings, "kind tinyint, spread bigint, key bigint, key2 bigint, doc bigint, n int").repartition(F.col("spread")).drop("spread")
    found = keep(dealt.mapInArrow(meet, "kind tinyint, key bigint, key2 bigint, doc bigint, n int"), "lists")
    every = found.filter("kind = 0").select("doc", "n", F.col("key").alias("k1"), F.col("key2").alias("k2"))
    # sets by their first document from here on
    reps = keep(every.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep")).select(F.col("k1").alias("set"), "rep"), "sets")
    first_of = lambda df, c: df.withColumnRenamed(c, "set").join(reps.hint("merge"), "set").drop("set").withColumnRenamed("rep", c)
    # all short lists that two documents share count together; a pair that shares a long list too is compared there anyway
    pairs = found.filter("kind = 1").groupBy(F.col("key").alias("a"), F.col("doc").alias("b")).agg(F.sum("n").alias("n"), F.min("key2").alias("least")).filter("n >= least").select("a", "b")
    pairs = keep(first_of(first_of(pairs, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    members = first_of(found.filter("kind = 2").select(F.col("key").alias("list"), F.col("doc")).distinct(), "doc").select("list", "doc").distinct()

    # Near copies share many long lists, and would send their whole sets once for each. What long lists join, directly or by way
    # of others, is compared as one group where that sends less than the lists do one by one; both compare every pair of a list.
    members = keep(members, "members")
    first = members.groupBy("list").agg(F.min("doc").alias("a"))
    joined = connected_components(members.join(first, "list").select("a", F.col("doc").alias("b")))
    of = keep(members.join(joined, F.col("doc") == F.col("id")).select("component", "list", "doc"), "joined")
    by_list = of.groupBy("component", "list").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.sum("n").alias("lists"))
    whole = of.select("component", "doc").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    at_once = by_list.join(whole, "component").select("component", (F.col("n") <= F.col("lists")).alias("at_once"))
    groups = salted_join(of, at_once, "component", "doc").select(F.when(F.col("at_once"), F.col("component")).otherwise(F.col("list")).alias("list"), "doc").distinct()

    # A work unit is one document with its partners, or a block of a group with the group's first document.
    sizes = groups.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"), F.min("doc").alias("head"))
    placed = salted_join(groups, sizes, "list", "doc").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    placed = keep(placed, "placed")
    blocks = placed.select(F.col("list").alias("u"), F.col("own").alias("i"), F.lit(0).alias("j"), "doc", F.lit(1).alias("own"))
    first = sizes.filter("blocks > 1").select(F.col("list").alias("u"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), F.col("head").alias("doc"), F.lit(0).alias("own"))
    star = pairs.select(F.col("a").alias("u"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("b").alias("doc"), F.lit(1).alias("own"))
    heads = pairs.select("a").distinct().select(F.col("a").alias("u"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("a").alias("doc"), F.lit(0).alias("own"))
    units = keep(blocks.unionByName(first).unionByName(star).unionByName(heads), "units")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's set for each unit that it is in, by few documents at a time."""
        for batch in batches:
            for piece in K.pieces(batch, "text", 256 << 10):
                value, off = shingle_sets(piece.column("text"), n)
                each = np.array([value[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], object)
                listed = piece.column("units")
                per = np.diff(listed.offsets.to_numpy())
                unit, ids, sizes = listed.flatten(), np.repeat(piece.column("doc_id").to_numpy(), per), np.repeat(each, per)
                for k in range(0, len(ids), 256):
                    yield pa.RecordBatch.from_arrays([*(x.slice(k, 256) for x in unit.flatten()), pa.array(ids[k : k + 256]), pa.array(sizes[k : k + 256], pa.binary())], names=["u", "i", "j", "own", "doc", "s"])

    def compare(pdf):
        """Stars: documents (own = 0) with their partners (1). Blocks: members (1) with each other and with the first document (0). The
        rest of a list (own = 0) with a block (1): i >= 0 and j >= 0 tell its part and the block."""
        import pandas as pd

        pdf = pdf.drop_duplicates(["u", "i", "j", "own", "doc", "s"]).sort_values(["u", "own", "doc"], kind="stable")
        docs_, values, own, u = pdf["doc"].tolist(), [np.frombuffer(s, K.U) for s in pdf["s"]], pdf["own"].to_numpy(), pdf["u"].to_numpy()
        kept: list[tuple[int, int]] = []
        if int(pdf["i"].iloc[0]) < 0:  # many documents, each with its partners
            ends = np.flatnonzero(np.append(u[1:] != u[:-1], True)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                heads = a + np.flatnonzero(own[a:b] == 0)
                index = Lists([values[k] for k in range(a + len(heads), b)])
                kept += [(int(k), int(a + len(heads) + x)) for k in heads for x in index.search(values[k], num, den)]
        else:
            right = np.flatnonzero(own == 1)
            index = Lists([values[k] for k in right])
            left = np.flatnonzero(own == 0) if bool(pdf["rest"].iloc[0]) else range(len(docs_))
            kept = forest(len(docs_), [(int(k), int(right[x])) for k in left for x in index.search(values[k], num, den)])
        return pd.DataFrame({"a": [docs_[x] for x, _ in kept], "b": [docs_[y] for _, y in kept]}, dtype="int64")

    # stars share a group, as a group costs more than a star; a block is one by itself
    many = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.when(F.col("i") < 0, F.pmod(F.xxhash64("u"), F.lit(many))).otherwise(F.col("u"))

    def compared(units: DataFrame, rest: bool) -> DataFrame:
        # The texts of the documents in question move once, and their sets go straight to the units. The ids grow with the corpus:
        # they are merged with the texts at every size, and not broadcast.
        active = units.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("u", "i", "j", "own")).alias("units"))
        # Most texts stay where they are, by a bitmap of fixed size that may let others pass, never lose one.
        cell = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
        here = units.select(cell("doc").alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
        at = F.bitmap_bit_position(cell("doc_id")).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        texts = rows.withColumn("bucket", F.bitmap_bucket_number(cell("doc_id"))).join(F.broadcast(here), "bucket").filter(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at % 8)) != 0).select("doc_id", "text")
        sets = texts.join(active.hint("merge"), "doc_id").mapInArrow(whole_sets, "u bigint, i int, j int, own int, doc bigint, s binary")
        return sets.withColumn("rest", F.lit(rest)).groupBy(group.alias("g"), "i", "j").applyInPandas(compare, "a bigint, b bigint")

    links = keep(compared(units, False), "links")
    drop(units)
    several = placed.filter("blocks > 1")
    if not several.isEmpty():
        joined_so_far = keep(connected_components(links), "parts")
        of_doc = joined_so_far.select(F.col("id").alias("doc"), F.col("component").alias("c"))
        of_head = joined_so_far.select(F.col("id").alias("head"), F.col("component").alias("h"))
        heads = several.select("list", "head").distinct().join(of_head, "head", "left").select("list", F.coalesce("h", "head").alias("h"))
        apart = salted_join(several.join(of_doc, "doc", "left"), heads, "list", "doc").filter(F.coalesce("c", "doc") != F.col("h"))
        apart = keep(apart.select("list", "doc", "blocks"), "apart")
        parts = apart.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
        left = salted_join(apart, parts, "list", "doc").select(F.col("list").alias("u"), F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "doc", F.lit(0).alias("own"))
        right = salted_join(several, parts, "list", "doc").select(F.col("list").alias("u"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("own").alias("j"), "doc", F.lit(1).alias("own"))
        rest = keep(left.unionByName(right), "rest")
        links = links.unionByName(keep(compared(rest, True), "links"))
        drop(rest, apart, joined_so_far)
    drop(members, of, placed, pairs, reps)

    # Nodes are classes of equal sets, by their smallest doc_id; empty sets are in none.
    classes = every.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    member = salted_join(every.filter("n > 0"), classes, ["k1", "k2", "n"], "doc", 8).select("doc", "rep")
    # a document that stands for its set in a task is linked to its class, and so are repeated ids
    edges = links.unionByName(member.filter("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")))
    parts = connected_components(edges)
    return (
        every.join(parts, every["doc"] == parts["id"], "left")
        .select(F.col("doc").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    )


def brute_force(texts: list[tuple[int, str | None]], n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """The same by comparing all pairs; for tests."""
    sets = []
    for _, text in texts:
        w = [x for x in _split(text or "") if x]
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = {d: d for d, _ in texts}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and den * both >= num * len(sets[x] | sets[y]):
                a, b = find(texts[x][0]), find(texts[y][0])
                root[max(a, b)] = min(a, b)
    return [(d, len(s), find(d)) for (d, _), s in zip(texts, sets, strict=True)]


def _split(text: str) -> list[str]:
    import re

    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)
