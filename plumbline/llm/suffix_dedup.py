"""Operator 8: exact byte-substring dedup with a logarithmic family of suffix arrays.

Places whose content recurs are found by content (repeats.py) and meet by anchor, so the index is dealt to shards that hold
all that can match. In each shard documents arrive in order, in batches. A batch gets a suffix array, by prefix doubling as far
as a match must reach. Suffixes that are one in it repeat within the batch; a merge-scan of the rest against each existing
level gives the length of their longest match with earlier batches, and a match of `depth` bytes or more removes. What has no
such match becomes a level, and levels of like size merge, so a shard of n suffixes has about log(n) levels.
A level holds its text once and the places of its suffixes in order. Contexts that are equal as a whole, and whole later copies of
a text, are judged by their first one before that.

Nulls and edge cases: a null or empty text has no bytes and stays; texts under 100 bytes stay whole; rows without doc_id
are left out; rows that repeat an id and a text are the same document and both return; cuts may fall inside a
character, so the kept text is bytes; strings are judged on the input; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .repeats import Texts, removed_units, removed_windows


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first `depth` bytes: from 8 bytes by doubling, the last step overlapping."""
    n = len(text)
    padded = np.zeros(n + max(depth, 8), np.uint8)
    padded[:n] = text
    width = min(8, depth)
    words = np.ndarray(n, ">u8", padded.data, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (8 - width))
    rank = _ranks(words)
    while width < depth:
        move = min(width, depth - width)
        later = np.zeros(n, np.uint64)
        later[: max(n - move, 0)] = rank[move:] + np.uint64(1)
        rank = _ranks(rank * np.uint64(n + 2) + later)
        width += move
    return rank


class Level:
    """A text, and the places of distinct suffixes in it, in the order of their first `depth` bytes."""

    def __init__(self, text: np.ndarray, places: np.ndarray, depth: int):
        self.text, self.places, self.depth = text, places, depth

    def keys(self, at: slice | np.ndarray = slice(None)) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.text, self.depth)[self.places[at]].copy()

    def merged(self, other: Level) -> Level:
        a, b = (x.keys().view(f"S{self.depth}").ravel() for x in (self, other))
        places = np.concatenate([self.places, other.places + len(self.text)])
        return Level(np.concatenate([self.text, other.text]), places[np.argsort(np.concatenate([a, b]), kind="stable")], self.depth)

    def longest(self, keys: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """Merge-scan: the longest match, up to depth, of each of some suffixes (in order) with any of the level's: it is with
        a neighbour in the order."""
        out, flat, at = np.zeros(len(keys), np.int64), keys.view(f"S{self.depth}").ravel(), 0
        for low in range(0, len(self.places), block):
            own = self.keys(slice(max(low - 1, 0), low + block))  # one more to the left: a neighbour across the edge
            mine = own.view(f"S{self.depth}").ravel()
            to = len(flat) if low + block >= len(self.places) else int(np.searchsorted(flat, mine[-1], "right"))
            k = np.searchsorted(mine, flat[at:to])
            for near in (np.minimum(k, len(mine) - 1), np.maximum(k - 1, 0)):
                differ = own[near] != keys[at:to]
                out[at:to] = np.maximum(out[at:to], np.where(differ.any(1), differ.argmax(1), self.depth))
            at = to
        return out


class SuffixFamily:
    """Levels of suffixes, told apart by their first `depth` bytes, smaller and younger ones last."""

    def __init__(self, depth: int):
        self.depth, self.levels = depth, []

    def add(self, text: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Takes a batch in document order; which of its suffixes match an earlier batch, or earlier in this one, for depth bytes.
        owner tells equal places (document and start) apart from different ones."""
        rank = suffix_ranks(text, self.depth)[starts]
        array = np.argsort(rank, kind="stable")
        new = np.ones(len(array), bool)
        new[1:] = rank[array[1:]] != rank[array[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(array)), 0))
        gone = np.zeros(len(array), bool)
        gone[array] = ~new & (owner[array] != owner[array[head]])
        fresh = Level(text, starts[array[new]], self.depth)
        keys, match = fresh.keys(), np.zeros(int(new.sum()), np.int64)
        for level in self.levels:
            match = np.maximum(match, level.longest(keys))
        held = np.zeros(len(array), bool)
        held[new] = match >= self.depth
        gone[array] |= held[head]
        if (match < self.depth).any():
            self.levels.append(Level(text, fresh.places[match < self.depth], self.depth))
        while len(self.levels) > 1 and 2 * len(self.levels[-1].places) > len(self.levels[-2].places):
            self.levels[-2:] = [self.levels[-2].merged(self.levels[-1])]
        return gone


def family(window: int, batch: int = 1 << 16):
    def judge(contexts: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        own, gone, first = SuffixFamily(window), [], np.concatenate([[0], np.cumsum(n)])
        ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1  # batches end with a document
        at = 0
        while at < len(doc):
            k = max(np.searchsorted(first[ends], first[at] + batch, "right") - 1, np.searchsorted(ends, at, "right"))
            to = int(ends[k])
            text = np.frombuffer(b"".join(contexts[at:to]), np.uint8)
            begin = np.cumsum([0, *(len(c) for c in contexts[at : to - 1])])
            counts = n[at:to]
            row = np.repeat(np.arange(to - at), counts)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            place = start[at:to][row] + offset
            owner = K.mix(doc[at:to][row].astype(K.U)) ^ place.astype(K.U)
            gone.append(own.add(text, begin[row] + offset, owner))
            at = to
        return np.concatenate(gone)

    return judge


SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def substring_dedup(docs: DataFrame, window: int = 100, gram: int = 32, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs, and on request the kept bytes."""
    rows, runs = removed_windows(docs, window, gram, False, family(window), piece_bytes=512 << 10)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                t, out, removed, spans, kept = Texts.__new__(Texts), [], [], [], []
                t.data, t.off = K.flat(piece.column("text"))
                for d, (tk, own) in enumerate(zip(piece.column("tk").to_pylist(), piece.column("runs").to_pylist(), strict=True)):
                    lo, hi = int(t.off[d]), int(t.off[d + 1])
                    a, b = removed_units(own, tk, window) if own else (np.zeros(0, np.int64),) * 2
                    cuts = [0, *np.stack([a, b], 1).ravel().tolist(), hi - lo]
                    text = b"".join(t.data[lo + x : lo + y].tobytes() for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                    removed.append(int((b - a).sum()))
                    spans.append(len(a))
                    out.append(hashlib.sha256(text).hexdigest())
                    if with_bytes:
                        kept.append(text)
                found = {"doc_id": piece.column("doc_id"), "n_bytes": pa.array(np.diff(t.off)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(out, pa.string())}
                yield pa.RecordBatch.from_pydict(found | ({"kept": pa.array(kept, pa.binary())} if with_bytes else {}))

    return rows.join(runs, "doc_id", "left").select("doc_id", "text", "tk", "runs").mapInArrow(cut, SCHEMA + ", kept binary" * with_bytes)


def brute_force(texts: list[tuple[int, str | None]], window: int) -> list[tuple[int, int, int, int, str]]:
    """The same with a table of all windows; for tests."""
    raw = [(d, (t or "").encode()) for d, t in texts]
    earliest: dict[bytes, tuple[int, int]] = {}
    for d, b in raw:
        for k in range(len(b) - window + 1):
            key = b[k : k + window]
            if key not in earliest or (d, k) < earliest[key]:
                earliest[key] = (d, k)
    out = []
    for d, b in raw:
        mark = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - window + 1):
            if earliest[b[k : k + window]] < (d, k):
                mark[k] += 1
                mark[k + window] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        out.append((d, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0, hashlib.sha256(bytes(x for x, g in zip(b, gone.tolist(), strict=True) if not g)).hexdigest()))
    return out
