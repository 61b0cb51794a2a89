"""Passages that repeat across a corpus, found by content: shared by the substring operators 6 and 8.

A window of `window` units (words or bytes) always holds the same anchor wherever it stands: the k-gram of least hash in
it, the last of equals. So two equal windows have equal anchors at the same place.

1. anchors: each text gives the anchors of its windows, about one in (window - gram) / 2 units. They meet by hash, packed
   into one row for each bucket and piece of text. An anchor that a piece holds twice needs no meeting: it goes past, and
   leaves one mark, so a common anchor gives a bucket one row a piece and not one a document.
2. contexts: for anchors that stand in two places, the span of text that the anchor's windows cover. Equal contexts in
   one piece of text are judged there (all but the first repeat), so common passages shrink before they move.
3. judge: contexts meet by anchor, and an operator's own structure finds which of their windows start earlier elsewhere.
4. The windows to remove return to their documents.

Whole later copies of a text are found by its digest and skip 2 and 3. Documents move once, by doc_id; both joins read
that one exchange. Nothing is kept by the driver, and there is no cap on copies, contexts or windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import identified, salted_join

LOW = K.U(0xFFFFFFFF)


class Texts:
    """The units of a batch of texts. data[at[i]:to[j - 1]] are units i to j - 1, written in one way only."""

    def __init__(self, texts: pa.Array, by_words: bool):
        buf, off = K.flat(texts)
        self.by_words = by_words
        if by_words:
            s, e, self.off = K.words(buf, off, K.SPACES)
            size = e - s
            self.to = np.cumsum(size + 1) - 1
            self.at = self.to - size
            data = np.full(int(self.to[-1]) + 1 if len(s) else 0, 0x20, np.uint8)
            data[K.ranges(self.at, size)] = buf[K.ranges(s, size)]
            self.data = data
            unit = K.word_hash(data, self.at, self.to)
            self.base = K.WORD_P
        else:
            self.data, self.off = buf, off
            unit = buf.astype(K.U) + K.U(1)
            self.base = K.BYTE_P
        self.n = len(unit)
        self.acc = np.zeros(self.n + 1, K.U)
        np.cumsum(unit * K.powers(self.base, self.n), out=self.acc[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return K.mix((self.acc[b] - self.acc[a]) * K.powers(K.inverse(self.base), self.n + 1)[a])

    def raw(self, a: int, b: int) -> bytes:
        return self.data[self.at[a] : self.to[b - 1]].tobytes() if self.by_words else self.data[a:b].tobytes()

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """(document, anchor place, anchor hash, first window, how many windows) of each run of windows with one anchor."""
        per = np.maximum(np.diff(self.off) - window + 1, 0)
        starts = K.ranges(self.off[:-1], per)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(K.U), none, none
        place = np.arange(self.n - gram + 1)
        h = self.hash(place, place + gram)
        least = K.window_min((h & ~LOW) | (LOW - place.astype(K.U)), window - gram + 1)
        at = (LOW - (least[starts] & LOW)).astype(np.int64)
        doc = np.repeat(np.arange(len(per)), per)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        run = np.flatnonzero(new)
        return doc[run], at[run], h[at[run]], starts[run], np.diff(np.append(run, len(at)))


Judge = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def removed_windows(docs: DataFrame, window: int, gram: int, by_words: bool, judge: Judge, piece_bytes: int = 2 << 20, most_windows: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, text, tk: a hash of the text), and (doc_id, runs: array<struct<tk, start, n>>) of the starts
    of windows whose units also start earlier: in a smaller doc_id, or earlier in the same document.

    A task holds the contexts of its part of the anchors, and judges them in shards of about most_windows windows.

    judge(contexts, doc, start, n, anchor) gets contexts of whole anchors, ordered by document and start, and returns for each
    window (n of each context, in order) whether an equal window of another context starts earlier."""
    spark = docs.sparkSession
    rows = identified(docs).withColumn("tk", F.xxhash64("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch, "text", piece_bytes):
                t = Texts(piece.column("text"), by_words)
                d, at, h, _, _ = t.anchors(window, gram)
                if not len(d):
                    continue
                doc, place = piece.column("doc_id").to_numpy()[d], at - t.off[d]
                order = np.argsort(h, kind="stable")
                h, doc, place = h[order], doc[order], place[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(h)))
                single = np.repeat(count == 1, count)
                twice = first[count > 1]
                # kept here: documents and places that are known to repeat; packed by a bucket of their documents
                key = np.concatenate([h[single], h[twice], K.mix(doc[~single].astype(K.U))])
                value = np.concatenate([h[single], h[twice], h[~single]])
                of = np.concatenate([doc[single], doc[twice], doc[~single]])
                where = np.concatenate([place[single], np.full(len(twice), -1), -2 - place[~single]])
                bucket = (key % K.U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, value, of, where = bucket[order], value[order], of[order], where[order]
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(cut[1:], len(bucket))
                pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cut].astype(np.int32)), "h": pack(value), "doc": pack(of), "place": pack(where.astype(np.int64))})

    def recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = []
        for batch in batches:
            for h, doc, place in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                got.append([np.frombuffer(h, np.int64), np.frombuffer(doc, np.int64), np.frombuffer(place, np.int64)])
        if not got:
            return
        h, doc, place = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        known = place < -1
        doc0, place0 = doc[known], -2 - place[known]
        h, doc, place = h[~known], doc[~known], place[~known]
        order = np.argsort(h, kind="stable")
        h, doc, place = h[order], doc[order], place[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h)))
        marked = np.add.reduceat((place < 0).astype(np.int64), first) if len(first) else count
        use = np.repeat((count > 1) | (marked > 0), count) & (place >= 0)
        doc, place = np.concatenate([doc0, doc[use]]), np.concatenate([place0, place[use]])
        for k in range(0, len(doc), 1 << 16):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[k : k + (1 << 16)]), "place": pa.array(place[k : k + (1 << 16)].astype(np.int32))})

    places = rows.select("doc_id", "text").mapInArrow(anchors, "bucket int, h binary, doc binary, place binary").repartition(F.col("bucket")).mapInArrow(recur, "doc_id bigint, place int")

    digests = rows.filter(F.octet_length("text") >= window).select("doc_id", "tk", F.unhex(F.md5(F.col("text").cast("binary"))).alias("m"))
    firsts = digests.groupBy("m").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = salted_join(digests, firsts, "m", "doc_id").filter("doc_id > first").select("doc_id", F.lit(None).cast("int").alias("place"), "tk")
    gathered = places.withColumn("tk", F.lit(None).cast("bigint")).unionByName(copies).groupBy("doc_id").agg(F.collect_list("place").alias("places"), F.collect_set("tk").alias("copies"))
    found = rows.join(gathered, "doc_id").withColumn("copy", F.array_contains("copies", F.col("tk")))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch, "text", piece_bytes):
                t = Texts(piece.column("text"), by_words)
                d, at, h, s, n = t.anchors(window, gram)
                ids, tk, copy = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tk", "copy"))
                listed = piece.column("places")
                per = np.diff(listed.offsets.to_numpy())
                wanted = np.sort((np.repeat(np.arange(len(ids)), per) << 32) + listed.flatten().to_numpy())
                key = (d << 32) + at - t.off[d]
                use = np.zeros(len(d), bool)
                if len(wanted) and len(key):
                    use = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                use &= ~copy[d] if len(d) else use
                d, at, h, s, n = d[use], at[use], h[use], s[use], n[use]
                whole = np.flatnonzero(copy & (np.diff(t.off) >= window))
                start = s - t.off[d]
                # equal contexts in this piece: the first stays, the rest repeat
                context, doc = t.hash(s, s + n - 1 + window), ids[d]
                order = np.lexsort((start, doc, n, context, h))
                same = np.zeros(len(order), bool)
                o, p = order[1:], order[:-1]
                same[1:] = (h[o] == h[p]) & (context[o] == context[p]) & (n[o] == n[p])
                maybe = np.flatnonzero(same)
                span = lambda rows: [t.raw(a, b) for a, b in zip(s[rows].tolist(), (s[rows] + n[rows] - 1 + window).tolist(), strict=True)]  # noqa: B023, E731
                for some in np.array_split(maybe, -(-len(maybe) // 1024) or 1):
                    same[some] = [x == y for x, y in zip(span(order[some]), span(order[some - 1]), strict=True)]
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
                head = order[head]
                later = same & ((doc[order] != doc[head]) | (start[order] != start[head]))
                gone, stay = order[later], np.sort(order[~later])
                kind = np.concatenate([np.zeros(len(whole) + len(gone), np.int8), np.ones(len(stay), np.int8)])
                pick = lambda a, b: np.concatenate([a, b[gone], b[stay]])  # noqa: B023, E731
                if len(kind):
                    yield pa.RecordBatch.from_pydict({
                        "h": pa.array(np.concatenate([K.mix(ids[whole].astype(K.U)), K.mix(doc[gone].astype(K.U)), h[stay]]).view(np.int64)), "kind": pa.array(kind),
                        "doc_id": pa.array(pick(ids[whole], doc)), "tk": pa.array(pick(tk[whole], tk[d])), "start": pa.array(pick(np.zeros(len(whole), np.int64), start)), "n": pa.array(pick(np.diff(t.off)[whole] - window + 1, n)),
                        "context": pa.array([None] * (len(whole) + len(gone)) + [t.raw(a, b) for a, b in zip(s[stay].tolist(), (s + n - 1 + window)[stay].tolist(), strict=True)], pa.binary()),
                    })

    schema = "doc_id bigint, tk bigint, start bigint, n bigint"

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, texts = ("doc_id", "tk", "start", "n"), [], []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            c = [batch.column(x).to_numpy() for x in names]
            if (kind == 0).any():
                yield pa.RecordBatch.from_pydict({x: pa.array(y[kind == 0]) for x, y in zip(names, c, strict=True)})
            if (kind == 1).any():
                parts.append([y[kind == 1] for y in [*c, batch.column("h").to_numpy()]])
                texts += batch.column("context").filter(pa.array(kind == 1)).to_pylist()
        if not parts:
            return
        doc, tk, start, n, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, doc))
        doc, tk, start, n, h, texts = doc[order], tk[order], start[order], n[order], h[order], [texts[k] for k in order.tolist()]
        # equal contexts: all windows of the later ones repeat; the first goes on
        firsts: dict[tuple[int, bytes], int] = {}
        head = np.array([firsts.setdefault(key, k) for k, key in enumerate(zip(h.tolist(), texts, strict=True))], np.int64)
        del firsts
        later = (doc != doc[head]) | (start != start[head])
        yield pa.RecordBatch.from_pydict({x: pa.array(y[later]) for x, y in zip(names, (doc, tk, start, n), strict=True)})
        # an anchor that one context alone holds cannot repeat
        stay = np.flatnonzero(head == np.arange(len(head)))
        _, back, count = np.unique(h[stay], return_inverse=True, return_counts=True)
        use = stay[count[back] > 1]
        shards = max(1, -(-int(n[use].sum()) // most_windows))
        of = (K.mix(h[use].view(K.U)) % K.U(shards)).astype(np.int64)
        for shard in range(shards):
            yield from judged_shard(*(x[use[of == shard]] for x in (doc, tk, start, n, h)), texts, use[of == shard])

    def judged_shard(doc, tk, start, n, h, texts, at) -> Iterator[pa.RecordBatch]:
        if not len(doc):
            return
        gone = judge([texts[k] for k in at.tolist()], doc, start, n, h)
        row, first = np.repeat(np.arange(len(doc)), n), np.cumsum(n) - n
        at = np.flatnonzero(gone)
        if len(at):
            r, s = row[at], start[row[at]] + at - first[row[at]]
            new = np.ones(len(at), bool)
            new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
            run = np.flatnonzero(new)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[r[run]]), "tk": pa.array(tk[r[run]]), "start": pa.array(s[run]), "n": pa.array(np.diff(np.append(run, len(at))))})

    spans = found.select("doc_id", "text", "tk", "places", "copy").mapInArrow(contexts, "h bigint, kind tinyint, doc_id bigint, tk bigint, start bigint, n bigint, context binary").repartition(F.col("h")).mapInArrow(judged, schema)
    return rows, spans.groupBy("doc_id").agg(F.collect_list(F.struct("tk", "start", "n")).alias("runs"))


def removed_units(runs: list | None, tk: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans (start, end) of units that the windows of one text's runs cover."""
    own = np.array([(r["start"], r["start"] + r["n"] - 1 + window) for r in runs or () if r["tk"] == tk], np.int64).reshape(-1, 2)
    _, a, b = K.union_runs(np.zeros(len(own), np.int64), own[:, 0], own[:, 1])
    return a, b
