"""Operator 11: whitening of embeddings by a compensated covariance.

Entries become whole numbers x (256ths). The fit list is each distinct x vector once, written to the shared folder; three passes over
it follow, of which each task returns sums alone:

1. number of vectors and sums of each dimension, exact.
2. covariance: each entry less its mean is a sum of two doubles (the mean is one as well), products of such entries are taken without
   error (two-product by halves of 26 bits) and added in double-double (two-sum). The tasks' sums, high and low parts, are merged in
   double-double again: by MERGERS tasks, then by one, which reads MERGERS rows. What the driver gets is one row of
   dimension^2 numbers.
3. the same for the whitened vectors, first their means and then their covariance, as the check that `identity_error` reports.

Eigenvectors: LAPACK's syevd (numpy's eigh: reduction to a tridiagonal matrix, then divide and conquer), followed by refinement steps in
extended precision against the high and low parts of the covariance, as close eigenvalues would else cost digits.

Nulls and edge cases: rows with a null vector, or null or non-finite entries, go; so do vectors of another length than most of the
fit list (ties: the shorter), which belong to another space; rows that repeat an id or have none return like others; entries beyond the
range of 64 bits stand at its end, and a deviation that 38 digits do not hold is null. Components without variance (eigenvalue within
rounding of 0, as for one vector, or equal ones) are not returned, so an empty table or a single distinct vector gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, quoted, small_batches

#: Tasks that merge the sums of all others, before one merges theirs.
MERGERS = 16
#: Products that are formed at a time.
BLOCK = 1 << 18


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = a * 134217729.0
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-double numbers."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the first axis, by halves."""
    while len(high) > 1:
        half = len(high) // 2
        rest = (high[2 * half :], low[2 * half :])
        high, low = add(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        high, low = np.concatenate([high, rest[0]]), np.concatenate([low, rest[1]])
    return high[0], low[0]


def _split(value: Fraction) -> tuple[float, float]:
    high = float(value)
    return high, float(value - Fraction(high))


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    v = F.transform(F.col(quoted(vector_col)), lambda c: c.cast("double"))
    # NaN is larger than infinity in Spark
    rows = df.select(F.col(quoted(id_col)).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull())
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    edge = float(1 << 63)
    whole = lambda c: F.when(c * 256 >= edge, F.lit((1 << 63) - 1)).when(c * 256 < -edge, F.lit(-(1 << 63))).otherwise(F.floor(c * 256).cast("bigint"))
    return rows.filter(usable).select("vec_id", F.transform("v", whole).alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """x of a batch as rows x dim."""
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.int64, copy=False)


def _merged(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum of the rows (high, low) of all tasks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        for batch in batches:
            for k in range(batch.num_rows):
                h, l = (batch.column(c)[k].values.to_numpy() for c in (0, 1))
                high, low = (h, l) if high is None else add(high, low, h, l)
        if high is not None:
            yield _row(high, low)

    row = parts.repartition(MERGERS).mapInArrow(merge, parts.schema).repartition(1).mapInArrow(merge, parts.schema).collect()[0]  # one row of 2 dim^2 numbers at most
    return np.array(row["high"]), np.array(row["low"])


def _row(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"high": pa.array([high], pa.list_(pa.float64())), "low": pa.array([low], pa.list_(pa.float64()))})


def _summed(fit_list: DataFrame, values: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], dim: int, products: bool) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sums over the fit list of what `values` (rows of x -> high, low parts) gives, or of its products in pairs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        for batch in batches:
            h, l = values(_matrix(batch, dim))
            i, j = np.triu_indices(h.shape[1])
            step = max(1, BLOCK // (len(i) if products else h.shape[1]))
            for at in range(0, len(h), step):
                a, b = h[at : at + step], l[at : at + step]
                if products:
                    p, e = two_product(a[:, i], a[:, j])
                    a, b = two_sum(p, e + (a[:, i] * b[:, j] + b[:, i] * a[:, j]))
                a, b = total(a, b)
                high, low = (a, b) if high is None else add(high, low, a, b)
        if high is not None:
            yield _row(high, low)

    return _merged(fit_list.mapInArrow(task, "high array<double>, low array<double>"))


@dataclass
class Whitening:
    """n vectors of the fit list, sums of each dimension, eigenvalues and components (columns) by falling eigenvalue, trace of the covariance."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n in double-double."""
        mean = np.array([_split(Fraction(s, self.n)) for s in self.sums]).reshape(-1, 2)
        xh = x.astype(np.float64)
        xl = (x - np.where(np.abs(xh) < 2.0**63, xh, 0).astype(np.int64)).astype(np.float64) if (np.abs(xh) >= 2.0**53).any() else np.zeros_like(xh)
        xl[np.abs(xh) >= 2.0**63] = 0
        s, e = two_sum(xh, -mean[:, 0])
        return two_sum(s, e + (xl - mean[:, 1]))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centred(x)
        return (high @ self.components + low @ self.components) / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact."""
        bound = self.n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums), default=0) + 1
        if bound * bound * max(1, x.shape[1]) < 1 << 63:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 10**38 else None for v in exact]


def eigen(high: np.ndarray, low: np.ndarray, steps: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of high + low: syevd, then Newton-like steps in extended precision that correct all
    vectors together (each by the others, in proportion to the residue over the gap; within a cluster only to right angles)."""
    _, x = np.linalg.eigh(high)
    a, v = high.astype(np.longdouble) + low, x[:, ::-1].astype(np.longdouble)
    for _ in range(steps):
        off = np.eye(len(a)) - v.T @ v
        s = v.T @ (a @ v)
        e = np.diag(s) / (1 - np.diag(off))
        rest = s - np.diag(e)
        near = 2 * (np.abs(rest).sum(0).max() + np.abs(e).max() * np.abs(off).sum(0).max())
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > near
        v = v + v @ np.where(apart, (s + e[None, :] * off) / np.where(apart, gap, 1), off / 2)
    v = v / np.sqrt((v * v).sum(0))
    order = np.argsort(-e, kind="stable")
    return e[order].astype(np.float64), v[:, order].astype(np.float64)


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """The whitening of valid() rows; None where no vector takes part."""
    small_batches(rows.sparkSession)
    vectors = keep(rows.select("x").distinct(), "vectors")  # equal vectors meet as partial aggregates, so copies of one cost a row a task
    sizes = vectors.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None or not sizes["dim"]:
        return None
    dim, n = sizes["dim"], sizes["n"]
    fit_list = vectors.filter(F.size("x") == dim)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)  # of 32 bits each: 2^31 vectors a task fit
        for batch in batches:
            x = _matrix(batch, dim)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dim), pa.int32()), "high": high, "low": low})

    parts = fit_list.mapInArrow(exact, "i int, high bigint, low bigint")
    sums = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in ("high", "low")]).orderBy("i").collect()  # dim rows
    model = Whitening(n, [(int(r["high"]) << 32) + int(r["low"]) for r in sums], np.zeros(0), np.zeros((dim, 0)), 0.0)
    i, j = np.triu_indices(dim)
    covariance = [np.zeros((dim, dim)), np.zeros((dim, dim))]
    for into, part in zip(covariance, _over(*_summed(fit_list, model.centred, dim, products=True), n), strict=True):
        into[i, j] = into[j, i] = part
    values, vectors_ = eigen(*covariance)
    model.trace = float(np.trace(covariance[0]) + np.trace(covariance[1]))
    kept = min(components, int((values > max(values[0], 0) * dim * np.finfo(float).eps).sum()))
    model.eigenvalues, model.components = values[:kept], vectors_[:, :kept]
    if kept:
        zero = lambda w: (w, np.zeros_like(w))
        mean = _over(*_summed(fit_list, lambda x: zero(model.whitened(x)), dim, products=False), n)[0]
        again = _over(*_summed(fit_list, lambda x: zero(model.whitened(x) - mean), dim, products=True), n)[0]
        a, b = np.triu_indices(kept)
        model.identity_error = float(np.abs(again - (a == b)).max())
    return model


def _over(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """high + low, divided by n."""
    each = [_split((Fraction(h) + Fraction(l)) / n) for h, l in zip(high.tolist(), low.tolist(), strict=True)]
    return np.array([h for h, _ in each]), np.array([l for _, l in each])


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error): a row for each vector and component."""
    rows = valid(df, id_col, vector_col)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(rows, components)
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few vectors of the dimension
    dim = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.eigenvalues)
        for batch in batches:
            x, m = _matrix(batch, dim), batch.num_rows
            deviation = pa.array(own.deviations(x), pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                "n": np.full(m * k, own.n, np.int64),
                "deviation": deviation,
                "whitened": own.whitened(x).ravel(),
                "explained": np.tile(own.eigenvalues / own.trace, m),
                "identity_error": np.full(m * k, own.identity_error),
            })

    return rows.filter(F.size("x") == dim).mapInArrow(run, schema)
