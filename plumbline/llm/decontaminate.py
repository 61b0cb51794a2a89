"""Operator 5: benchmark decontamination with a generalised suffix automaton over the words of the items.

The automaton holds every substring of every item. Training words stream through it; at each word the state and the
length of the longest suffix that occurs in an item tell which windows end there. Before that, runs of words whose
neighbouring pairs occur in no item are passed over: no window can touch them.

Nulls and edge cases: a null text has no words; items without id or words take no part; an id that comes twice owns
the windows of both texts; documents without id keep their row (id null); empty tables give no rows, and no hits; columns
pass whatever their names: where docs has one named like a result column, the result column gets an underscore in front.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import kernel as K
from .shared import fresh, keep, map_batches, quoted

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.next, self.link, self.len = window, [{}], [-1], [0]
        self.ids: dict[int, int] = {}
        owners: list[set[str]] = [set()]
        short: dict[int, list[tuple[int, str]]] = {}
        pairs: set[int] = set()
        for name, tokens in items:
            if not tokens:
                continue
            hashes = self.hashes(tokens)
            pairs.update(K.gram_hash(hashes, 2).tolist())
            last = 0
            for h in hashes.tolist():
                last = self._extend(last, self.ids.setdefault(h, len(self.ids)), owners)
                owners[last].add(name)
            if len(tokens) < window:
                short.setdefault(last, []).append((len(tokens), name))
        order = sorted(range(1, len(self.len)), key=lambda v: -self.len[v])
        for v in order:
            if self.link[v] > 0 and self.len[self.link[v]] >= window:
                owners[self.link[v]] |= owners[v]
        #: For each state the items that hold its suffix of window words, and the whole short items that are its suffixes.
        self.whole: list[tuple[tuple[int, str], ...]] = [()] * len(self.len)
        at: list[int] = [0] * len(self.len)
        for v in reversed(order):
            up = self.link[v]
            at[v] = at[up] if self.len[up] >= window else v
            self.whole[v] = self.whole[up] + tuple(short.get(v, ()))
        complete: dict[int, set[str]] = {}
        for v in order:  # a window state gathers the items of all longer states below it
            if self.len[v] >= window:
                complete.setdefault(at[v], set()).update(owners[v])
        self.items = [tuple(sorted(complete[at[v]])) if self.len[v] >= window else () for v in range(len(self.len))]
        self.least = min([window, *(n for x in short.values() for n, _ in x)]) if self.ids else 0
        self.vocabulary = np.array(sorted(self.ids), K.U)
        self.words = self._filter(self.vocabulary)
        self.pairs = self._filter(np.array(sorted(pairs), K.U))
        self.order = np.array([self.ids[h] for h in sorted(self.ids)], np.int64)

    @staticmethod
    def hashes(tokens: list[bytes]) -> np.ndarray:
        off = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        return K.word_hash(np.frombuffer(b"".join(tokens), np.uint8), off[:-1], off[1:])

    @staticmethod
    def _filter(hashes: np.ndarray) -> np.ndarray:
        bits = max(16, int(len(hashes) * 16).bit_length())
        out = np.zeros(1 << bits, bool)
        out[(hashes & K.U((1 << bits) - 1)).astype(np.int64)] = True
        return out

    def _extend(self, last: int, c: int, owners: list[set[str]]) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q, owners)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        owners.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q, owners)
        return cur

    def _clone(self, p: int, c: int, q: int, owners: list[set[str]]) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        owners.append(set())
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def candidates(self, hashes: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words (start, end), within one document, that can hold a window."""
        if not len(hashes) or not self.least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = self.words[(hashes & K.U(len(self.words) - 1)).astype(np.int64)]
        edge = np.zeros(len(hashes) + 1, bool)
        edge[woff] = True
        joined = np.zeros(len(hashes), bool)  # this word follows the one before it within an item
        pair = K.gram_hash(hashes, 2)
        joined[1:] = self.pairs[(pair & K.U(len(self.pairs) - 1)).astype(np.int64)] & known[1:] & known[:-1] & ~edge[1:-1]
        start = np.flatnonzero(known & ~joined)
        follows = np.append(joined[1:], False)
        end = np.flatnonzero(known & ~follows) + 1
        long = end - start >= self.least
        return start[long], end[long]

    def stream(self, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of all windows in a run of words, and the items that have them."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        tokens = np.where(self.vocabulary[at] == hashes, self.order[at], -1).tolist()
        v = n = 0
        spans, found = [], set()
        for i, c in enumerate(tokens):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            if n >= window:
                spans.append((i + 1 - window, i + 1))
                found.update(self.items[v])
            for k, name in self.whole[v]:
                if k <= n:
                    spans.append((i + 1 - k, i + 1))
                    found.add(name)
        return spans, found


def item_shards(benchmark: DataFrame, most_words: int = 1_000_000, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in shards of about most_words words each (one item may be longer), one shard at a time on the driver: what the
    driver and a worker hold is bounded, and documents pass the automata of a larger benchmark one after another."""
    items = benchmark.filter(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("string").alias("item_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    total = items.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 2
    shards = max(1, -(-total // most_words))
    for k in range(shards):
        part = items if shards == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        yield sorted((r["item_id"], tokens(r["text"] or "")) for r in part.toLocalIterator())


def tokens(text: str) -> list[bytes]:
    buf = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = K.words(buf, np.array([0, len(buf)]), K.NON_ALNUM)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


HITS = {"n_words": "bigint", "n_hit": "bigint", "hit_runs": "array<bigint>", "items": "array<string>"}


def _scan(shared, text_col: str, names: list[str], cut: tuple[int, float] | None = None) -> object:
    """Marks hits; with cut (max_span, max_coverage) the runs that are too long go, and so do documents that are hit too much."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Automaton = pickle.loads(shared.value)
        for batch in batches:
            for piece in K.pieces(batch, text_col):
                buf, off = K.flat(piece.column(text_col))
                buf = K.LOWER[buf]
                s, e, woff = K.words(buf, off, K.NON_ALNUM)
                hashes = K.word_hash(buf, s, e)
                runs: dict[int, list[tuple[int, int]]] = {}
                found: dict[int, set[str]] = {}
                a, b = own.candidates(hashes, woff)
                doc = np.searchsorted(woff, a, "right") - 1
                for x, y, d in zip(a.tolist(), b.tolist(), doc.tolist(), strict=True):
                    spans, items = own.stream(hashes[x:y])
                    if spans:
                        runs.setdefault(d, []).extend((x + p - int(woff[d]), x + q - int(woff[d])) for p, q in spans)
                        found.setdefault(d, set()).update(items)
                n = piece.num_rows
                hit, merged, owners = np.zeros(n, np.int64), [[]] * n, [[]] * n
                before, owned = piece.column(names[2]).to_pylist(), piece.column(names[3]).to_pylist()
                for d in {*runs, *(k for k in range(n) if before[k])}:
                    p = np.array(runs.get(d, []) + list(zip(before[d][::2], before[d][1::2], strict=True)), np.int64)
                    _, p0, p1 = K.union_runs(np.zeros(len(p), np.int64), p[:, 0], p[:, 1])
                    hit[d], merged[d] = (p1 - p0).sum(), np.stack([p0, p1], 1).ravel().tolist()
                    owners[d] = sorted(found.get(d, set()) | set(owned[d]))
                new = dict(zip(names, (pa.array(np.diff(woff)), pa.array(hit), pa.array(merged, pa.list_(pa.int64())), pa.array(owners, pa.list_(pa.string()))), strict=True))
                if cut:
                    texts = piece.column(text_col).to_pylist()
                    for d in range(n):
                        long = [(a, b) for a, b in zip(merged[d][::2], merged[d][1::2], strict=True) if b - a > cut[0]]
                        if long and texts[d] is not None:
                            texts[d] = without(texts[d], long)
                    new[text_col] = pa.array(texts, piece.schema.field(text_col).type)
                out = pa.RecordBatch.from_arrays([new.get(f.name, piece.column(k)) for k, f in enumerate(piece.schema)], names=piece.schema.names)
                yield out.filter(pa.array(hit <= cut[1] * np.diff(woff))) if cut else out

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_words: int = 1_000_000, text_col: str = "text", cut: tuple[int, float] | None = None) -> DataFrame:
    """docs with n_words, n_hit, hit_runs (word start, word end, start, end, ..) and items after its own columns.
    No shuffle: each automaton is one pass over the rows in place; between two of them the rows are written. The last one cuts (_scan)."""
    spark, names = docs.sparkSession, fresh(docs.columns, *HITS)
    empty = [F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.array().cast("array<bigint>"), F.array().cast("array<string>")]
    out = docs.withColumns(dict(zip(names, empty, strict=True)))
    if not isinstance(docs.schema[text_col].dataType, StringType):
        out = out.withColumn(text_col, F.col(quoted(text_col)).cast("string"))
    shared, shards = None, item_shards(benchmark, most_words)
    items = next(shards)
    while items is not None:
        if shared is not None:
            out = keep(out, "hits")
            shared.unpersist()
        shared, items = spark.sparkContext.broadcast(pickle.dumps(Automaton(items, window), 5)), next(shards, None)
        out = map_batches(out, _scan(shared, text_col, names, cut if items is None else None), out.schema)
    return out


def digests(found: DataFrame) -> DataFrame:
    """One row a document, as op5 returns them."""
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_span: int = 9, max_coverage: float = 0.5) -> DataFrame:
    """docs without the hit runs longer than max_span words; documents whose hit words exceed max_coverage of all go.
    A short item that a document quotes whole is a run too, but stays where it is not longer than max_span."""
    found = contamination(docs, benchmark, window, cut=(max_span, max_coverage))
    return found.select(*[F.col(quoted(c)) for c in docs.columns])


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the words of the runs and what stands between them."""
    raw = text.encode()
    buf = K.LOWER[np.frombuffer(raw, np.uint8)]
    s, e, _ = K.words(buf, np.array([0, len(buf)]), K.NON_ALNUM)
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at : s[a]])
        at = int(e[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    """op5 by comparing every window with every position; for tests."""
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        w = tuple(tokens(text or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(w[k : k + window], set()).add(str(name))
    out = []
    for doc, text in docs:
        w, hit, found = tuple(tokens(text or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if w[k : k + n] in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w[k : k + n]]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
