"""Vectorised text kernels shared by the operators: whole Arrow batches as byte buffers, no loop per word.

Texts are UTF-8 buffers with document offsets. Separators of all word rules used here are ASCII, so words can be
cut on bytes. Hashes have 64 bits. A word of up to 16 bytes is hashed from its length and its first and last 8 bytes, which
are all of it; a longer one by polynomials over two prime fields, as powers modulo 2^64 give some long words equal hashes whatever
the base is. Hashes of a few words are polynomials of theirs. Two words are taken as equal when their hashes are; the constants are
fixed, so this holds by chance (2^-64 a pair) and not against texts that are made to collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Fixed odd multipliers of the polynomials (bytes, for anchors alone, and words) and of the mixer.
BYTE_P, WORD_P, MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and letters.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * MIX_A
    h = (h ^ (h >> U(27))) * MIX_B
    return h ^ (h >> U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        _powers[int(base)] = np.multiply.accumulate(have)
    return _powers[int(base)][:n]


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` text bytes each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cut = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def words(buf: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the word offsets of the documents."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = ~separators[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


#: Primes below 2^31 and a base for each, for words that are longer than two machine words.
FIELDS = ((2147483647, 1171250933), (2147483629, 1923405349))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # the first k of 8 bytes


def ends_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First 8 bytes of each span (fewer in a shorter one), and its last 8 (0 unless it is longer than 8), as numbers."""
    padded = np.zeros(len(buf) + 16, np.uint8)
    padded[8:-8] = buf
    at = np.ndarray((len(buf) + 9,), "<u8", padded, strides=(1,))
    size = ends - starts
    return at[starts + 8] & _KEEP[np.minimum(size, 8)], np.where(size > 8, at[ends], U(0))


def long_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of spans of any length but 0, by polynomials over two prime fields."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, U)
    first = np.cumsum(size) - size
    data = buf[ranges(starts, size)].astype(U) + U(1)
    place, out = ranges(np.zeros(len(size), np.int64), size), np.zeros(len(size), U)
    for prime, base in FIELDS:
        power = np.ones(1, U)
        while len(power) < size.max():
            power = np.concatenate([power, power * U(pow(base, len(power), prime)) % U(prime)])
        out = (out << U(32)) ^ (np.add.reduceat(data * power[place] % U(prime), first) % U(prime))
    return mix(out ^ mix(size.astype(U)))


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    head, tail = ends_of(buf, starts, ends)
    size = ends - starts
    out = mix(head ^ mix(tail + size.astype(U) * WORD_P))
    long = np.flatnonzero(size > 16)
    out[long] = long_hash(buf, starts[long], ends[long])
    return out


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, regardless of document ends."""
    if len(hashes) < n:
        return np.zeros(0, U)
    out = hashes[: len(hashes) - n + 1].copy()
    factor = U(1)
    with np.errstate(over="ignore"):
        for j in range(1, n):
            factor = factor * WORD_P
            out += hashes[j : len(hashes) - n + 1 + j] * factor
    return mix(out)


def gram_starts(woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which word positions start an n-gram within one document, and how many each document has."""
    total, per = int(woff[-1]), np.maximum(np.diff(woff) - n + 1, 0)
    ok = np.zeros(total + 1, np.int32)
    first = woff[:-1]
    np.add.at(ok, first, (per > 0).astype(np.int32))
    np.add.at(ok, first + per, -(per > 0).astype(np.int32))
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0), per


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, .. for each start and count, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - at, counts)


def window_min(values: np.ndarray, w: int, largest: bool = False) -> np.ndarray:
    """Least (or largest) of each w consecutive values, by running values within blocks of w from both sides."""
    n = len(values)
    if w <= 1 or n < w:
        return values.copy() if w <= 1 else values[:0]
    fold, fill = (np.maximum, 0) if largest else (np.minimum, np.iinfo(values.dtype).max)
    padded = np.full(-(-n // w) * w, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    left = fold.accumulate(blocks, axis=1).ravel()
    right = fold.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(right[: n - w + 1], left[w - 1 : n])


def union_runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges spans that overlap or touch, per document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.empty(len(doc), bool)
    new[0] = True
    new[1:] = doc[1:] != doc[:-1]
    group = np.cumsum(new) - 1
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span) - group * span
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)
