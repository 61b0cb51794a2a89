"""Operator 7: token ids in fixed-width bit-packed files.

A file holds the ids of a range of documents in ascending doc_id order. 64 ids of w bits are w little-endian 64-bit
words, so any group of 64 ids starts at a known word and unpacks with 2 x 64 numpy operations over all groups at once.
A footer has the byte offset of each block of BLOCK ids, and the id and length of each document:

    magic | blocks | block offsets int64 | doc ids int64 | lengths int64 | json footer | its length int32 | magic

Nulls and edge cases: a null text is empty and gives the end id alone; a row with a null doc_id names no document and is
left out; rows with equal doc_id are ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import identified, keep, shared_dir

MAGIC = b"PLMBTOK1"
GROUP = 64
#: Ids between two entries of the block offset table.
BLOCK = 64 * 1024


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids, padded to whole groups of 64, as width 64-bit words a group."""
    groups = -(-len(ids) // GROUP)
    full = np.zeros(groups * GROUP, np.uint64)
    full[: len(ids)] = ids
    columns = np.ascontiguousarray(full.reshape(groups, GROUP).T)
    out = np.zeros((width, groups), np.uint64)
    for j in range(GROUP):
        word, shift = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first n ids of packed groups."""
    raw = np.frombuffer(data, "<u8").reshape(-1, width)
    words = np.ascontiguousarray(raw.T)
    out, mask = np.empty((GROUP, len(raw)), np.uint32), np.uint64((1 << width) - 1)
    for j in range(GROUP):
        word, shift = divmod(j * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        out[j] = (value & mask).astype(np.uint32)
    return np.ascontiguousarray(out.T).ravel()[:n]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(uri))


class Writer:
    """Writes under a name of its own and takes the final name when closed, so that a retried task leaves one whole file."""

    def __init__(self, uri: str, vocabulary: int, attempt: int = 0):
        self.fs, self.path = filesystem(uri)
        self.own, self.width = f"{self.path}.{attempt}.part", bits_for(vocabulary)
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(MAGIC)
        self.at, self.n, self.rest, self.offsets, self.docs, self.lengths = len(MAGIC), 0, np.zeros(0, np.uint32), [], [], []

    def add(self, docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs.astype("<i8"))
        self.lengths.append(lengths.astype("<i8"))
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        if len(ids):
            data, size = pack(ids, self.width), BLOCK // GROUP * self.width * 8
            self.offsets += range(self.at, self.at + len(data), size)
            self.out.write(data)
            self.at += len(data)

    def close(self) -> None:
        self._blocks(self.rest)
        docs, lengths = (np.concatenate([np.zeros(0, "<i8"), *x]) for x in (self.docs, self.lengths))
        self.out.write(np.array(self.offsets, "<i8").tobytes() + docs.tobytes() + lengths.tobytes())
        footer = json.dumps({"width": self.width, "ids": self.n, "docs": len(docs), "blocks": len(self.offsets), "tables": self.at}).encode()
        self.out.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.own, self.path)


class Reader:
    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(4 + len(MAGIC), size - 4 - len(MAGIC))
        if tail[4:] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        n = int.from_bytes(tail[:4], "little")
        self.meta = m = json.loads(self.file.read_at(n, size - 4 - len(MAGIC) - n))
        tables = np.frombuffer(self.file.read_at(8 * (m["blocks"] + 2 * m["docs"]), m["tables"]), "<i8")
        self.offsets, self.docs, self.lengths = np.split(tables, [m["blocks"], m["blocks"] + m["docs"]])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end-1, reading only the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (end - 1) // BLOCK
        stop = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.meta["tables"]
        data = self.file.read_at(stop - int(self.offsets[a]), int(self.offsets[a]))
        return unpack(data, self.meta["width"], end - a * BLOCK)[start - a * BLOCK :]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """Encodes whole texts with a tokenizers file. Texts are cut before single spaces between visible characters, where a
    byte-level tokenizer that splits on white space always starts a new piece; each distinct piece is encoded once and kept. A piece is
    found by its hash and then compared (length, first and last 8 bytes, which are all of most pieces, and the rest of longer ones)."""

    SLOTS, MOST = 1 << 22, 1 << 21

    def __init__(self, path: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        #: Pieces are safe for this kind alone; any other kind encodes whole texts.
        self.cuts = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] or t["single_word"] for t in kind.get("added_tokens", []))
        self._clear()

    def _clear(self) -> None:
        self.slot_hash, self.slot_entry = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.store, self.stored = np.full(1 << 16, self.end_id, np.uint32), 1
        self.starts, self.counts, self.n = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), 1  # entry 0 is the end id
        self.sizes, self.heads, self.tails, self.long = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), {}

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        mask = np.uint64(self.SLOTS - 1)
        slot = (h & mask).astype(np.int64)
        have = self.slot_hash[slot]
        entry = np.where(have == h, self.slot_entry[slot], -1)
        left = np.flatnonzero((have != h) & (have != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            have = self.slot_hash[slot[left]]
            entry[left[have == h[left]]] = self.slot_entry[slot[left[have == h[left]]]]
            left = left[(have != h[left]) & (have != 0)]
        return entry

    def _differ(self, entry: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Places of pieces whose entry, if there is one, is of another piece."""
        size = e - s
        other = (entry >= 0) & ((self.sizes[entry] != size) | (self.heads[entry] != head) | (self.tails[entry] != tail))
        for k in np.flatnonzero((entry >= 0) & ~other & (size > 16)).tolist():
            other[k] = self.long[int(entry[k])] != buf[s[k] : e[k]].tobytes()
        return np.flatnonzero(other)

    def _learn(self, hashes: list[int], pieces: list[bytes], heads: np.ndarray, tails: np.ndarray) -> None:
        """Adds pieces; one of hash 0 gets an entry that nothing finds."""
        for h, piece, head, tail, e in zip(hashes, pieces, heads, tails, self.tokenizer.encode_batch([p.decode() for p in pieces], add_special_tokens=False), strict=True):
            ids = e.ids
            if self.n == len(self.starts):
                self.starts, self.counts, self.sizes, self.heads, self.tails = (np.concatenate([x, x]) for x in (self.starts, self.counts, self.sizes, self.heads, self.tails))
            while self.stored + len(ids) > len(self.store):
                self.store = np.concatenate([self.store, self.store])
            self.store[self.stored : self.stored + len(ids)] = ids
            self.starts[self.n], self.counts[self.n] = self.stored, len(ids)
            self.sizes[self.n], self.heads[self.n], self.tails[self.n] = len(piece), head, tail
            if len(piece) > 16:
                self.long[self.n] = piece
            if h:
                slot = h & (self.SLOTS - 1)
                while self.slot_hash[slot]:
                    slot = (slot + 1) & (self.SLOTS - 1)
                self.slot_hash[slot], self.slot_entry[slot] = h, self.n
            self.n, self.stored = self.n + 1, self.stored + len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and how many each text has."""
        buf, off = K.flat(texts)
        if not self.cuts:
            each = [np.array([*e.ids, self.end_id], np.uint32) for e in self.tokenizer.encode_batch([bytes(buf[a:b]).decode() for a, b in zip(off[:-1], off[1:], strict=True)], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
        begins = np.zeros(len(buf) + 1, bool)
        if len(buf) > 2:
            space = np.flatnonzero(buf[1:-1] == 0x20) + 1
            before, after, lead2, lead3 = buf[space - 1], buf[space + 1], buf[space - 2], buf[space - 3]  # what wraps around is cut away by the document starts
            plain = lambda x: (x > 0x20) & (x != 0x7F)
            odd = lambda x: (x == 0xC2) | ((x >= 0xE1) & (x <= 0xE3))  # noqa: E731  first bytes of all other white space
            begins[space[plain(before) & plain(after) & ~odd(after) & ~((before >= 0x80) & (odd(lead2) | odd(lead3)))]] = True
        begins[off] = True
        begins[-1] = False
        s = np.flatnonzero(begins)
        e = np.append(s[1:], len(buf))
        h, (head, tail) = K.word_hash(buf, s, e), K.ends_of(buf, s, e)
        h[h == 0] = 1
        raw = lambda at: [buf[a:b].tobytes() for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]
        if self.n > self.MOST:
            self._clear()
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            for k in range(0, len(first), 1 << 16):
                at = new[first[k : k + (1 << 16)]]
                self._learn(h[at].tolist(), raw(at), head[at], tail[at])
            entry[new] = self._find(h[new])
        other = self._differ(entry, buf, s, e, head, tail)
        if len(other):
            begin = self.n
            self._learn([0] * len(other), raw(other), head[other], tail[other])
            entry[other] = np.arange(begin, self.n)
        per = np.searchsorted(s, off)
        entry = np.insert(entry, per[1:], 0)  # the end id of each document
        counts = self.counts[entry]
        ids = self.store[K.ranges(self.starts[entry], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[per + np.arange(len(per))])


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One a worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes token files in ascending doc_id order; returns a row for each file: part int, path string, n_docs, n_ids bigint.

    Rows are dealt by ranges of doc_id, so each task writes one file and holds one slice of texts at a time. The
    returned table is written to the shared folder, and so stays true when executors are lost."""
    rows = identified(docs)
    spark = docs.sparkSession
    to = out_dir or f"{shared_dir(spark)}-tokens"
    fs, path = filesystem(to)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, context, writer, n_docs = encoder(tokenizer_path, end_id), TaskContext.get(), None, 0
        uri = f"{to}/part-{context.partitionId():06d}.tok"
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                writer = writer or Writer(uri, own.vocabulary(), context.taskAttemptId())
                ids, lengths = own.encode(piece.column("text"))
                writer.add(piece.column("doc_id").to_numpy(), lengths, ids)
                n_docs += piece.num_rows
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_ids": [writer.n]})

    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return keep(ranged.mapInArrow(write, "part int, path string, n_docs bigint, n_ids bigint"), "token-files")


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids on request."""
    # One row a file: the running sum runs over the list of files, not over documents.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a task for each file, by a number that adaptive execution leaves alone
    listed = files.withColumn("before", before).select("part", "path", "before").repartitionByRange(max(1, files.count()), "part").select("path", "before")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(path)
                cut = np.unique(np.append(np.searchsorted(file.starts, np.arange(0, file.starts[-1], 1 << 20)), len(file.docs)))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    ids, at = file.ids(int(file.starts[a]), int(file.starts[b])), (file.starts[a : b + 1] - file.starts[a]).tolist()
                    each = [ids[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                    out = {"doc_id": pa.array(file.docs[a:b]), "start": pa.array(file.starts[a:b] + base), "n_tokens": pa.array(file.lengths[a:b]), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())}
                    yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))} if with_ids else {}))

    return listed.mapInArrow(read, schema)
