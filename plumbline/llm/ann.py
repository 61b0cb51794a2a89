"""Operator 10: approximate nearest neighbours with learned partitions.

A bounded, documented sample gives a neighbour graph; the graph is cut into balanced parts; a small network learns which
part a vector belongs to. Every row is indexed under its likeliest part. A query goes to as many of its most probable
parts as the sample's own queries need to reach `target` recall, and on to the next ones until these hold k others; what
stands there is ranked by exact cosine. Tables of all sizes are parted alike, of at least two parts once there are 2 * NODES
vectors. Parts are searched in blocks of bounded size, so a part of any size, or one vector's many copies, is spread over
tasks; each block sends back at most k rows a query.

Nulls and edge cases: null, zero and non-finite vectors, and those of another length than most of the sample, take no
part; rows without vec_id take no part; a row that repeats id and vector counts once; of an id with several vectors each
is searched, or searches, and its best score counts, so that no id comes twice; fewer than k candidates give all;
ties go to the smaller vec_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep


#: Nodes of the neighbour graph for each part, at least; and parts that a table gets where it has so many nodes.
NODES, FEW_PARTS = 32, 8


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def neighbours(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """k nearest others of each row of unit vectors, nearest first."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[a : a + block] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Parts of a neighbour graph of nearly equal size: grown from spread seeds, then refined by moving nodes, and
    swapping them through free room, to the part that most of their neighbours are in."""
    n = len(graph)
    most = int(np.ceil(slack * n / parts))
    both: list[list[int]] = [row.tolist() for row in graph]
    for a, row in enumerate(graph.tolist()):
        for b in row:
            both[b].append(a)
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    order = np.random.default_rng(11).permutation(n).tolist()
    at = 0
    for p in range(parts):  # breadth first until the part is full
        want, queue, head = n * (p + 1) // parts - n * p // parts, [], 0
        while size[p] < want:
            if head == len(queue):
                while at < n and part[order[at]] >= 0:
                    at += 1
                if at == n:
                    break
                part[order[at]] = p
                size[p] += 1
                queue.append(order[at])
                continue
            for b in both[queue[head]]:
                if part[b] < 0 and size[p] < want:
                    part[b] = p
                    size[p] += 1
                    queue.append(b)
            head += 1
    for _ in range(rounds):
        moved = 0
        for a in order:
            near, count = np.unique(part[both[a]], return_counts=True)
            own = count[near == part[a]].sum()
            room = (size[near] < most) & (count > own)
            if room.any():
                p = near[room][np.argmax(count[room])]
                size[part[a]] -= 1
                size[p] += 1
                part[a] = p
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """One hidden layer; probabilities of the parts."""

    def __init__(self, layers: list[np.ndarray]):
        self.layers = layers

    @classmethod
    def fit(cls, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, rate: float = 0.01) -> Router:
        rng = np.random.default_rng(5)
        d = x.shape[1]
        w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)) * np.sqrt(d) / 2, np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 256):
                rows, step = order[a : a + 256], step + 1
                xb = x[rows]
                h = np.maximum(xb @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                g = z / z.sum(1, keepdims=True)
                g[np.arange(len(rows)), part[rows]] -= 1
                g /= len(rows)
                gh = (g @ w[2].T) * (h > 0)
                for k, grad in enumerate((xb.T @ gh + 1e-5 * w[0], gh.sum(0), h.T @ g + 1e-5 * w[2], g.sum(0))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                    w[k] = w[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(w)

    def scores(self, x: np.ndarray) -> np.ndarray:
        w = self.layers
        return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


class Index:
    """router, the number of parts, and how many of them a query visits."""

    def __init__(self, router: Router | None, parts: int, probes: int, width: int):
        self.router, self.parts, self.probes, self.width = router, parts, probes, width

    @classmethod
    def fit(cls, rows: DataFrame, most: int = 8192, per_part: int = 1500, target: float = 0.94, k: int = 5) -> Index:
        """rows: (vec_id, v). Fits on the first `most` rows by a hash of their id: a bound of the fit alone."""
        total = rows.count()
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
        if not sample:
            return cls(None, 1, 1, 0)
        widths, times = np.unique([len(r["v"]) for r in sample], return_counts=True)
        width = int(widths[np.argmax(times)])
        x = np.array(sorted(r["v"] for r in sample if len(r["v"]) == width))
        x = np.unique(x / np.abs(x).max(1, keepdims=True), axis=0)  # copies tell the graph nothing
        x = unit(x)
        parts = max(1, min(max(FEW_PARTS, -(-total // per_part)), len(x) // NODES))
        if parts < 2:
            return cls(None, 1, 1, width)
        rng = np.random.default_rng(3)
        asked = rng.random(len(x)) < min(0.2, 1000 / len(x))
        train = x[~asked]
        part = balanced_parts(neighbours(train, min(10, len(train) - 1)), parts)
        router = Router.fit(train, part, parts)
        # recall of the held-out vectors' true neighbours for each number of parts
        placed = np.argmax(router.scores(x), 1)
        near = neighbours(x, min(k, len(x) - 1))[asked]
        ranked = np.argsort(-router.scores(x[asked]), 1, kind="stable")
        rank = np.empty_like(ranked)
        np.put_along_axis(rank, ranked, np.arange(parts)[None].repeat(len(ranked), 0), 1)
        needs = np.take_along_axis(rank, placed[near], 1).ravel()
        recall = np.cumsum(np.bincount(needs, minlength=parts)) / len(needs)
        return cls(router, parts, int(np.argmax(recall >= target)) + 1, width)

    def order(self, v: np.ndarray) -> np.ndarray:
        """All parts of each vector, the most probable first."""
        if self.router is None:
            return np.zeros((len(v), 1), np.int32)
        return np.argsort(-self.router.scores(unit(v / np.abs(v).max(1, keepdims=True))), 1, kind="stable").astype(np.int32)

    def visits(self, order: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
        """How many parts each query visits: `probes`, or as many as hold k ids and its own, if that is more."""
        enough = np.cumsum(held[order], 1) > k
        return np.maximum(self.probes, np.where(enough.any(1), enough.argmax(1) + 1, order.shape[1]))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(column.offsets.to_numpy())
    fit = size == width
    return column.filter(pa.array(fit)).flatten().to_numpy().reshape(-1, width) if width else np.zeros((0, 0)), fit


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", index: Index | None = None, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all rows but its own id."""
    spark = rows.sparkSession
    candidates = usable(rows, id_col, vector_col)
    index = index or Index.fit(candidates, k=k)
    shared = spark.sparkContext.broadcast(index)  # a network of bounded size
    schema = "part int, vec_id bigint, v binary"

    def placing(held: np.ndarray | None):
        """Rows by their likeliest part, or (with held: ids in each part) queries by every part that they visit."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                v, fit = _matrix(batch.column("v"), own.width)
                if len(v):
                    order = own.order(v)
                    n = np.ones(len(v), np.int64) if held is None else own.visits(order, held, k)
                    part = order[np.arange(order.shape[1])[None] < n[:, None]]
                    ids = batch.column("vec_id").to_numpy()[fit]
                    raw = np.array([x.tobytes() for x in v], object)
                    yield pa.RecordBatch.from_pydict({"part": pa.array(part), "vec_id": pa.array(np.repeat(ids, n)), "v": pa.array(np.repeat(raw, n), pa.binary())})

        return place

    indexed = keep(candidates.mapInArrow(placing(None), schema), "index")
    held = np.zeros(index.parts, np.int64)
    for r in indexed.groupBy("part").agg(F.countDistinct("vec_id").alias("n")).collect():  # at most `parts` rows
        held[r["part"]] = r["n"]
    asked = keep(usable(queries, id_col, vector_col).mapInArrow(placing(held), schema), "queries")
    # at most `parts` rows each, and parts is bounded by the sample
    blocks = {r["part"]: (max(1, -(-r["c"] // block)), max(1, -(-r["q"] // block))) for r in indexed.select("part", F.lit(1).alias("c"), F.lit(0).alias("q")).unionByName(asked.select("part", F.lit(0).alias("c"), F.lit(1).alias("q"))).groupBy("part").agg(F.sum("c").alias("c"), F.sum("q").alias("q")).collect()}
    table = spark.createDataFrame([(p, c, q) for p, (c, q) in sorted(blocks.items())], "part int, cb int, qb int")
    slot = F.xxhash64("vec_id")
    cands = indexed.join(F.broadcast(table), "part").select("part", F.pmod(slot, "cb").cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "vec_id", "v", F.lit(False).alias("ask"))
    asks = asked.join(F.broadcast(table), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("c"), F.pmod(slot, "qb").cast("int").alias("q"), "vec_id", "v", F.lit(True).alias("ask"))

    def search(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates(["vec_id", "v", "ask"]).sort_values(["ask", "vec_id"], kind="stable")
        ask, ids = pdf["ask"].to_numpy(), pdf["vec_id"].to_numpy()
        v = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(len(pdf), -1)
        own, c = ids[~ask], v[~ask]
        norm = np.sqrt((c * c).sum(1))
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        out = []
        for q, x in zip(ids[ask], v[ask], strict=True):
            s = (c @ x) / norm if len(own) else np.zeros(0)
            s[own == q] = -np.inf
            best_of = np.maximum.reduceat(s, first) if len(first) else s  # one for each id
            n = int(np.isfinite(best_of).sum())
            if not n:
                continue
            # all that could be among the best, then the exact measure: equal vectors get equal scores
            line = np.partition(best_of, len(best_of) - min(k, n))[len(best_of) - min(k, n)]
            at = np.flatnonzero(s >= line - 1e-9 * abs(line) - 1e-12)
            exact = (c[at] * x).sum(1) / (norm[at] * np.sqrt((x * x).sum()))
            best = np.lexsort((own[at], -exact))
            _, nearest_of = np.unique(own[at][best], return_index=True)
            out += [(q, own[at[b]], exact[b]) for b in best[np.sort(nearest_of)][:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = cands.unionByName(asks).groupBy("part", "c", "q").applyInPandas(search, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: list[int], vectors: np.ndarray, asked: list[int], k: int = 5) -> dict[int, list[int]]:
    """True nearest ids; for tests and for measuring recall."""
    ids_, out = np.array(ids), {}
    norm = np.sqrt((vectors**2).sum(1))
    for q in asked:
        i = int(np.flatnonzero(ids_ == q)[0])
        s = (vectors * vectors[i]).sum(1) / (norm * norm[i])
        s[i] = -np.inf
        out[q] = ids_[np.lexsort((ids_, -s))[: min(k, len(ids) - 1)]].tolist()
    return out
