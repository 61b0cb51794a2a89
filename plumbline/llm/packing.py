"""Operator 2: conflict-constrained best-fit packing.

Documents go into bins of `capacity` tokens. A bin carries a bitmap of the sources that are full in it (most_per_source
documents each) and one of the duplicate clusters it holds. Bins stand in order of what room they have left; the search
for a document starts at the tightest bin that has room and goes on to successors until one is compatible; if none is, a
bin opens. Longer documents come first. A document longer than a bin fills whole bins, and its rest is packed.

Documents are dealt at random (by a hash of their id) to shards of about `per_shard` documents, each packed by one task:
a hot source is spread over all shards, no text moves, and no task's input grows with the corpus.

Nulls and edge cases: a null or empty text is its end mark alone, one token, and no duplicate of others; a null source or
cluster conflicts with nothing; rows without doc_id are left out; rows that repeat an id are packed each; ties go by doc_id, and to the older bin; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import small_batches

SCHEMA = "doc_id bigint, piece int, first_token bigint, n_tokens bigint, bin_id string, position int, bin_tokens bigint"


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, most_per_source: int) -> list[int]:
    """Bin of each item, items as ordered."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    rooms: list[tuple[int, int]] = []  # (room left, bin), tightest first
    full: list[int] = []
    held: list[int] = []
    counts: list[dict] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        k = bisect_left(rooms, (size, -1))
        while k < len(rooms) and (full[rooms[k][1]] & s or held[rooms[k][1]] & c):
            k += 1
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(full)
            full.append(0)
            held.append(0)
            counts.append({})
        held[b] |= c
        if s:
            counts[b][source] = counts[b].get(source, 0) + 1
            if counts[b][source] >= most_per_source:
                full[b] |= s
        if room > size:
            insort(rooms, (room - size, b))
        out.append(b)
    return out


def pack(docs: DataFrame, capacity: int = 4096, most_per_source: int = 4, per_shard: int = 4096, source_col: str = "source", cluster: object = None) -> DataFrame:
    """A row for each document and bin it stands in (SCHEMA). cluster: a column; by default equal lower-cased texts."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.col(source_col).cast("string").alias("source"), (F.when(F.length(text) > 0, F.xxhash64(F.lower(text))) if cluster is None else cluster.cast("bigint")).alias("cluster"))
    shards = max(1, -(-docs.count() // per_shard))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch, "text"):
                _, _, woff = K.words(*K.flat(piece.column("text")), K.SPACES)
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n": pa.array(np.diff(woff) + 1), "source": piece.column("source"), "cluster": piece.column("cluster")})

    def pack_shard(table: pa.Table) -> pa.Table:
        # Arrow keeps a cluster with nulls a 64-bit number
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "n", "source", "cluster")])
        shard, columns = table["shard"][0].as_py(), [table[c].to_pylist() for c in ("doc_id", "n", "source", "cluster")]
        items, whole = [], []
        for doc, n, source, cluster in zip(*columns, strict=True):
            for p in range(n // capacity):
                whole.append((doc, p, p * capacity, capacity))
            if n % capacity:
                items.append((n % capacity, doc, n // capacity, source, cluster))
        items.sort(key=lambda x: (-x[0], x[1]))
        bins = best_fit([x[0] for x in items], [x[3] for x in items], [x[4] for x in items], capacity, most_per_source)
        base = len(whole)
        out = [(doc, p, at, n, f"{shard}-{k}", 0, n) for k, (doc, p, at, n) in enumerate(whole)]
        fill: dict[int, int] = {}
        place: dict[int, int] = {}
        for x, b in zip(items, bins, strict=True):
            fill[b] = fill.get(b, 0) + x[0]
        for x, b in zip(items, bins, strict=True):
            out.append((x[1], x[2], x[2] * capacity, x[0], f"{shard}-{base + b}", place.get(b, 0), fill[b]))
            place[b] = place.get(b, 0) + 1
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

    counted = rows.mapInArrow(count, "doc_id bigint, n bigint, source string, cluster bigint")
    return counted.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(pack_shard, SCHEMA)
