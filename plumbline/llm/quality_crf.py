"""Operator 4: document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are its own shape and that of the lines beside it; the chain's transition
weights tie neighbours. Forward-backward gives each line's marginal; a document's score is their mean, weighted by line
length. The model (weights, transitions and starts) is fitted by maximum likelihood on a bounded, documented sample of labelled
documents, whose lines take the document's label; texts are read whole, in the fit as in the score.

Nulls and edge cases: a null or empty text is one empty line and gets a score; rows with null labels or ids do not
train; repeated labels of an id count once (the largest); with no usable labels every score is 0.5; an empty table gives no
rows; a column that has the name of the score is replaced, all others pass by untouched; a null doc_id is scored (op4 gives it a
null held_out).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import map_batches, small_batches

_CLASS = np.zeros((256, 6), np.float32)  # letters, capitals, digits, marks that prose is full of, other marks, beyond ASCII
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)], 0] = 1
_CLASS[range(0x41, 0x5B), 1] = 1
_CLASS[range(0x30, 0x3A), 2] = 1
_CLASS[[ord(c) for c in ".,;:'\"-()"], 3] = 1
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()"], 4] = 1
_CLASS[0x80:, 5] = 1
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
OWN = 11


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x 3 OWN + 1: own, mean of the lines beside, either side's largest difference, 1), lengths, line offsets."""
    breaks = np.flatnonzero(buf == 0x0A)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
    loff = np.searchsorted(starts, off[:-1], "left")
    # an empty document begins where the next one does: count its starts one by one
    loff = np.concatenate([np.arange(len(off) - 1) + np.searchsorted(breaks, off[:-1]), [len(starts)]])
    ends = np.append(starts[1:], len(buf)).astype(np.int64)
    cut = np.ones(len(starts), np.int64)
    cut[loff[1:] - 1] = 0
    ends = np.maximum(ends - cut, starts)
    size = np.maximum(ends - starts, 1).astype(np.float32)
    shares = []
    for k in range(_CLASS.shape[1]):
        total = np.concatenate([[0], np.cumsum(_CLASS[buf, k], dtype=np.int64)])
        shares.append((total[ends] - total[starts]) / size)
    ws, we, _ = K.words(buf, off, K.SPACES)
    at = np.searchsorted(ws, starts)
    to = np.searchsorted(ws, ends)
    n = np.maximum(to - at, 1).astype(np.float32)
    length = np.concatenate([[0], np.cumsum(we - ws)])
    h = K.word_hash(buf, ws, we) if len(ws) else np.zeros(0, K.U)
    again = np.zeros(len(ws) + 1, np.int64)
    again[2 : len(ws) + 1] = np.cumsum(h[1:] == h[:-1]) if len(ws) > 1 else 0
    short = np.concatenate([[0], np.cumsum((we - ws) <= 1)])
    # `again` may count a pair across the line's start once; that is one word in a line
    own = np.stack([*shares, np.log1p(size) / 8, np.log1p(n) / 6, (length[to] - length[at]) / n / 10, (again[to] - again[at]) / n, (short[to] - short[at]) / n], 1).astype(np.float32)
    first, last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    first[loff[:-1]] = True
    last[loff[1:] - 1] = True
    prev, nxt = np.roll(own, 1, 0), np.roll(own, -1, 0)
    prev[first], nxt[last] = own[first], own[last]
    beside = (prev + nxt) / 2
    apart = np.maximum(np.abs(prev - own), np.abs(nxt - own))
    return np.concatenate([own, beside, apart, np.ones((len(own), 1), np.float32)], 1), ends - starts, loff


def marginals(emission: np.ndarray, loff: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(good) of each line; emission is the good label's score against the bad one's. Chains run side by side, longest first."""
    n = np.diff(loff)
    order = np.argsort(-n, kind="stable")
    begin, n = loff[:-1][order], n[order]
    active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")  # chains longer than t
    out_f = np.zeros((len(emission), 2))
    out_b = np.zeros((len(emission), 2))
    a = None
    for t, k in enumerate(active.tolist()):
        e = emission[begin[:k] + t]
        score = np.stack([np.zeros(k), e], 1)
        if t == 0:
            a = start + score
        else:
            a = np.logaddexp(a[:k, :1] + transition[0], a[:k, 1:] + transition[1]) + score
        out_f[begin[:k] + t] = a
    b = np.zeros((0, 2))
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        if t + 1 < len(active):
            e = emission[begin[: active[t + 1]] + t + 1]
            nxt = b + np.stack([np.zeros(len(e)), e], 1)
            b = np.logaddexp(transition[:, :1].T + nxt[:, :1], transition[:, 1:].T + nxt[:, 1:])
        b = np.concatenate([b, np.zeros((k - len(b), 2))])
        out_b[begin[:k] + t] = b
    total = out_f + out_b
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60)))


class LineCRF:
    """weights of the features, transition scores [from, to] and start scores of bad and good."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.weights, self.transition, self.start = weights, transition, start

    @classmethod
    def fit(cls, features: list[np.ndarray], labels: np.ndarray, steps: int = 250, rate: float = 0.1, ridge: float = 1e-3) -> LineCRF:
        """Gradient of the log-likelihood of label chains that hold one label all through: observed minus expected counts."""
        width = 3 * OWN + 1
        w, tr, st = np.zeros(width), np.zeros((2, 2)), np.zeros(2)
        if len(features) and 0 < labels.sum() < len(labels):
            x = np.concatenate(features).astype(np.float64)
            n = np.array([len(f) for f in features])
            loff = np.concatenate([[0], np.cumsum(n)])
            each = np.repeat(1.0 / n, n)  # documents weigh alike
            balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
            weight = each * np.repeat(balance, n) / len(n)
            y = np.repeat(labels, n).astype(np.float64)
            m, v = np.zeros(width + 5), np.zeros(width + 5)
            head = loff[:-1]
            inner = np.ones(len(x), bool)
            inner[loff[1:] - 1] = False
            pair = np.flatnonzero(inner)
            for step in range(1, steps + 1):
                e = x @ w
                p = marginals(e, loff, tr, st)
                gw = x.T @ ((y - p) * weight) - ridge * w
                # pair marginals from neighbouring marginals and the transition odds
                q = pair_marginals(p[pair], p[pair + 1], tr)
                observed = np.stack([(1 - y[pair]), 0 * y[pair], 0 * y[pair], y[pair]], 1)
                gt = (weight[pair, None] * (observed - q)).sum(0) - ridge * tr.ravel()
                gs = ((y[head] - p[head]) * weight[head]).sum() - ridge * st[1]
                g = np.concatenate([gw, gt, [gs]])
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                w, tr = w + move[:width], np.clip(tr + move[width:-1].reshape(2, 2), -4, 4)
                st = np.clip(st + np.array([-1, 1]) * move[-1], -4, 4)  # only their difference counts
        return cls(w, tr, st)

    def score(self, texts: pa.Array) -> np.ndarray:
        buf, off = K.flat(texts)
        x, size, loff = line_features(buf, off)
        p = marginals(x.astype(np.float64) @ self.weights, loff, self.transition, self.start)
        weight = size + 1.0
        return np.add.reduceat(p * weight, loff[:-1]) / np.add.reduceat(weight, loff[:-1]) if len(loff) > 1 else np.zeros(0)


def pair_marginals(p: np.ndarray, q: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Joint of two neighbours (bad-bad, bad-good, good-bad, good-good) with marginals p and q and the chain's odds ratio:
    in a chain, fixing the marginals of two neighbours leaves exactly that ratio."""
    odds = np.exp(np.clip(tr[0, 0] + tr[1, 1] - tr[0, 1] - tr[1, 0], -12, 12))
    if abs(odds - 1) < 1e-9:
        both = p * q
    else:
        s = 1 + (p + q) * (odds - 1)
        both = (s - np.sqrt(np.maximum(s * s - 4 * odds * (odds - 1) * p * q, 0))) / (2 * (odds - 1))
    return np.stack([1 - p - q + both, q - both, p - both, both], 1)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents, the first by a hash of the id."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    ids = known.groupBy("doc_id").agg(F.max("y").alias("y")).filter(usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` rows of two numbers
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most_docs: int = 3000) -> LineCRF:
    """Fits on at most most_docs labelled documents (a bound of the fit alone), each read whole."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                x, _, loff = line_features(*K.flat(piece.column("text")))
                yield pa.RecordBatch.from_pydict({"y": piece.column("y"), "doc_id": piece.column("doc_id"), "x": pa.array([x[a:b].tobytes() for a, b in zip(loff[:-1], loff[1:], strict=True)], pa.binary())})

    rows = training_rows(docs, labels, label, usable, most_docs).select("doc_id", "text", "y").mapInArrow(features, "y int, doc_id bigint, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return LineCRF.fit([np.frombuffer(r["x"], np.float32).reshape(-1, 3 * OWN + 1) for r in rows], np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: LineCRF, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of each whole text, in place and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.transition, model.start))  # a few hundred numbers
    out = docs.withColumn(into, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineCRF(*shared.value)
        for batch in batches:
            for piece in K.pieces(batch, text_col):
                found = pa.array(own.score(piece.column(text_col)), pa.float64())
                yield piece.set_column(piece.schema.get_field_index(into), into, found)

    return map_batches(out, run, out.schema)


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))
