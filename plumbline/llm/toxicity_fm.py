"""Operator 9: toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings of 4 and 5 bytes, hashed to 2^20 buckets. Buckets that stand in LEAST or more
documents of a bounded sample of labelled documents are kept, whatever they say by themselves: over these, the machine
learns a weight for each and a vector for each, whose products weigh pairs (an insult beside a mention of a group) that no
sum of single weights can. A document's terms count once each. Texts are read whole, in the fit as in the score.

Nulls and edge cases: a null or empty text has no terms and gets the bias; null labels or ids do not train; repeated
labels count once (the largest); without both classes every score is 0.5; an empty table gives no rows; a column that has the
name of the score is replaced; a null doc_id is scored (op9 gives it a null held_out).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .quality_crf import training_rows
from .shared import map_batches

BUCKETS = 1 << 20
BEGINNINGS = (4, 5)
#: Documents of the sample that a bucket must stand in.
LEAST = 5


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and of its beginnings, and the document of each."""
    buf, off = K.flat(texts)
    buf = K.LOWER[buf]
    s, e, woff = K.words(buf, off, K.NON_ALNUM)
    doc, mask = np.repeat(np.arange(len(off) - 1), np.diff(woff)), K.U(BUCKETS - 1)
    found, docs = [K.word_hash(buf, s, e)], [doc]
    for n in BEGINNINGS:
        long = np.flatnonzero(e - s > n)
        found.append(K.mix(K.word_hash(buf, s[long], s[long] + n) ^ K.U(n)))
        docs.append(doc[long])
    return (np.concatenate(found) & mask).astype(np.int32), np.concatenate(docs)


def distinct(bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc.astype(np.int64) * BUCKETS + bucket)
    return (key % BUCKETS).astype(np.int32), key // BUCKETS


class FactorizationMachine:
    """slot: bucket -> 1 + row of weights and vectors, 0 for buckets that are too rare."""

    def __init__(self, buckets: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.buckets, self.bias, self.weights, self.vectors = buckets, bias, weights, vectors
        self.slot = np.zeros(BUCKETS, np.int32)
        self.slot[buckets] = np.arange(1, len(buckets) + 1)

    @classmethod
    def fit(cls, bucket: np.ndarray, doc: np.ndarray, y: np.ndarray, rank: int = 4, epochs: int = 10, batch: int = 64, rate: float = 0.5, vector_rate: float = 0.05, sure: float = 3.0, vector_sure: float = 2.5) -> FactorizationMachine:
        """Logistic loss, both classes weighing alike, by proximal steps (FTRL) over small batches; doc ascends. A weight stays 0, and a
        vector where it began, until its summed gradient is `sure` times what chance would give: rare terms say nothing by accident."""
        n1, n0 = int((y == 1).sum()), int((y == 0).sum())
        if not n1 or not n0:
            return cls(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, rank)))
        rng = np.random.default_rng(7)
        kept = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS) >= LEAST)
        out = cls(kept, 0.0, np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), rank)))
        at = out.slot[bucket] - 1
        at, doc = at[at >= 0], doc[at >= 0]
        begin = np.searchsorted(doc, np.arange(len(y) + 1))
        weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
        first, bias_seen = out.vectors.copy(), 1e-6
        seen_w, sum_w, seen_v, sum_v = np.zeros(len(kept)), np.zeros(len(kept)), np.full((len(kept), rank), 1e-6), np.zeros((len(kept), rank))

        def step(sums: np.ndarray, seen: np.ndarray, least: float, speed: float) -> np.ndarray:
            bound = least * np.sqrt(seen + 1)
            return np.where(np.abs(sums) <= bound, 0.0, (sums - np.sign(sums) * bound) * speed / (1 + np.sqrt(seen)))

        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                size = begin[rows + 1] - begin[rows]
                here, own = at[K.ranges(begin[rows], size)], np.repeat(np.arange(len(rows)), size)
                touched, local = np.unique(here, return_inverse=True)
                raw, sums = out._raw(here, own, len(rows))
                g = (y[rows] - 1 / (1 + np.exp(-np.clip(raw, -40, 40)))) * weight[rows]
                by = np.bincount(local, g[own], len(touched))
                seen = seen_w[touched] + by * by
                sum_w[touched] += by + (np.sqrt(seen) - np.sqrt(seen_w[touched])) / rate * out.weights[touched]
                seen_w[touched] = seen
                mine = out.vectors[touched]
                gv = np.stack([np.bincount(local, g[own] * sums[own, f], len(touched)) - by * mine[:, f] for f in range(rank)], 1)
                far = seen_v[touched] + gv * gv
                sum_v[touched] += gv + (np.sqrt(far) - np.sqrt(seen_v[touched])) / vector_rate * (mine - first[touched])
                seen_v[touched] = far
                out.weights[touched] = step(sum_w[touched], seen, sure, rate)
                out.vectors[touched] = first[touched] + step(sum_v[touched], far, vector_sure, vector_rate)
                gb = float(g.mean())
                bias_seen += gb * gb
                out.bias += 0.1 * gb / bias_seen**0.5
        return out

    def _raw(self, at: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """bias + sum of weights + half of (squared sum of vectors - sum of their squares), per document."""
        raw, rank = self.bias + np.bincount(doc, self.weights[at], n), self.vectors.shape[1]
        sums = np.stack([np.bincount(doc, self.vectors[at, f], n) for f in range(rank)], 1)
        squares = np.bincount(doc, (self.vectors[at] ** 2).sum(1), n)
        return raw + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, texts: pa.Array) -> np.ndarray:
        bucket, doc = terms(texts)
        known = self.slot[bucket] > 0
        bucket, doc = distinct(bucket[known], doc[known])
        raw, _ = self._raw(self.slot[bucket] - 1, doc, len(texts))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most_docs: int = 8000) -> FactorizationMachine:
    """Fits on at most most_docs labelled documents (a bound of the fit alone), each read whole."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                bucket, doc = distinct(*terms(piece.column("text")))
                cut = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                yield pa.RecordBatch.from_pydict({"y": piece.column("y"), "doc_id": piece.column("doc_id"), "x": pa.array([bucket[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    rows = training_rows(docs, labels, label, usable, most_docs).select("doc_id", "text", "y").mapInArrow(features, "y int, doc_id bigint, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    each = [np.frombuffer(r["x"], np.int32) for r in rows]
    doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
    return FactorizationMachine.fit(np.concatenate([np.zeros(0, np.int32), *each]), doc, np.array([r["y"] for r in rows], np.int64))


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of each whole text, in place and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.bias, model.weights, model.vectors))  # at most BUCKETS terms
    out = docs.withColumn(into, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorizationMachine(*shared.value)
        for batch in batches:
            for piece in K.pieces(batch, text_col):
                yield piece.set_column(piece.schema.get_field_index(into), into, pa.array(own.score(piece.column(text_col)), pa.float64()))

    return map_batches(out, run, out.schema)
