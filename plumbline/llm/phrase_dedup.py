"""Operator 6: substring dedup with automata of repeated phrases.

Recurring passages are confirmed by content (repeats.py): whatever stands around an anchor that recurs. Anchors are dealt to
shards; each shard compiles the phrases (windows) that recur in its passages into Aho-Corasick automata over word ids
(pyahocorasick), of about `most` phrases each, and streams all its passages, of all documents, through them to locate every
occurrence. A located phrase that also starts earlier (smaller doc_id, or earlier in the document) is removed. Only passages
can hold a phrase, so a document streams past the shards of its own anchors and not past all. Passages that are equal as a
whole, and whole later copies of a text, are judged by their first one before that.

Nulls and edge cases: a null or empty text has no words and stays; texts shorter than a window stay whole; rows without
doc_id are left out; rows that repeat an id and a text are the same document and both return; overlaps count; passages
are judged on the input; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .repeats import Texts, removed_units, removed_windows


def phrases(window: int, most: int = 50_000):
    def judge(contexts: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Anchors side by side, as many as hold `most` windows, share an automaton."""
        gone = np.zeros(int(n.sum()), bool)
        first = np.cumsum(n) - n
        order = np.argsort(anchor, kind="stable")  # stays ordered by document and start within an anchor
        ends = np.flatnonzero(np.append(anchor[order][1:] != anchor[order][:-1], True)) + 1
        total, at, base = np.cumsum(n[order]), 0, 0
        while at < len(order):
            k = max(np.searchsorted(total[ends - 1], base + most, "right") - 1, np.searchsorted(ends, at, "right"))
            own, at, base = order[at : ends[k]], int(ends[k]), int(total[ends[k] - 1])
            _compile_and_stream(own, contexts, doc, start, n, first, gone, window)
        return gone

    return judge


def _compile_and_stream(own, contexts, doc, start, n, first, gone, window) -> None:
    import ahocorasick

    ids: dict[bytes, int] = {}
    words = [tuple([ids.setdefault(w, len(ids) + 1) for w in contexts[k].split(b" ")]) for k in own]
    # confirm: windows whose hash comes twice
    flat = np.concatenate([np.array(w, K.U) for w in words])
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    grams = K.gram_hash(K.mix(flat), window)
    counts = n[own]
    places = K.ranges(off[:-1], counts)
    _, back, times = np.unique(grams[places], return_inverse=True, return_counts=True)
    again = times[back] > 1
    if not again.any():
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    row = np.repeat(np.arange(len(own)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    _, one = np.unique(back[again], return_index=True)
    at = np.flatnonzero(again)[one]
    for value, (r, o) in enumerate(zip(row[at].tolist(), offset[at].tolist(), strict=True)):
        automaton.add_word(words[r][o : o + window], value)
    automaton.make_automaton()
    located = [(value, r, end + 1 - window) for r, w in enumerate(words) for end, value in automaton.iter(w)]
    value, r, o = (np.array(x, np.int64) for x in zip(*located, strict=True))
    place = np.stack([doc[own][r], start[own][r] + o])
    order = np.lexsort((place[1], place[0], value))
    head = np.append(True, value[order][1:] != value[order][:-1])
    earliest = place[:, order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]]
    later = (place[:, order] != earliest).any(0)
    gone[first[own][r[order[later]]] + o[order[later]]] = True


SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 8, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs, and on request the kept words as text."""
    rows, runs = removed_windows(docs, window, gram, True, phrases(window))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                t, out, removed, kept = Texts(piece.column("text"), True), [], [], []
                for d, (tk, own) in enumerate(zip(piece.column("tk").to_pylist(), piece.column("runs").to_pylist(), strict=True)):
                    lo, hi = int(t.off[d]), int(t.off[d + 1])
                    a, b = removed_units(own, tk, window) if own else (np.zeros(0, np.int64),) * 2
                    cuts = [0, *np.stack([a, b], 1).ravel().tolist(), hi - lo]
                    text = b" ".join(t.raw(lo + x, lo + y) for x, y in zip(cuts[::2], cuts[1::2], strict=True) if y > x)
                    removed.append(int((b - a).sum()))
                    out.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept.append(text.decode())
                found = {"doc_id": piece.column("doc_id"), "n_words": pa.array(np.diff(t.off)), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(out, pa.string())}
                yield pa.RecordBatch.from_pydict(found | ({"text": pa.array(kept, pa.string())} if with_text else {}))

    return rows.join(runs, "doc_id", "left").select("doc_id", "text", "tk", "runs").mapInArrow(cut, SCHEMA + ", text string" * with_text)


def brute_force(texts: list[tuple[int, str | None]], window: int) -> list[tuple[int, int, int, str]]:
    """The same with a table of all windows; for tests."""
    import re

    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts]
    earliest: dict[tuple, tuple[int, int]] = {}
    for d, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            earliest[key] = min(earliest.get(key, (d, k)), (d, k))
    out = []
    for d, w in words:
        gone = {x for k in range(len(w) - window + 1) if earliest[tuple(w[k : k + window])] < (d, k) for x in range(k, k + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out
