"""Greedy steps whose result depends on the order, as one fold a page (U7-U10, U13, G9, G10): area descending, id ascending.

Each runs in a pandas function over pages' boxes as they stream; pages are dealt by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _boxes(pdf) -> tuple[np.ndarray, np.ndarray]:
    b = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
    return b, (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])


def _shared(b: np.ndarray, one: np.ndarray) -> np.ndarray:
    w = np.minimum(b[:, 2], one[2]) - np.maximum(b[:, 0], one[0])
    h = np.minimum(b[:, 3], one[3]) - np.maximum(b[:, 1], one[1])
    return np.clip(w, 0, None) * np.clip(h, 0, None)


def _grouped(rows: DataFrame, keys: list[str], order: list, step, schema: str) -> DataFrame:
    """step(frame, bounds) on frames of whole groups, whose rows stand in order; a group reaches from one bound to the next. Rows are dealt and
    sorted by the keys and told apart as they stream: they are computed once, and a task holds a batch and one group, whatever the size of the table.
    A group is one page's rows, never a corpus'."""

    def bounds(frame) -> list[int]:
        own = frame[keys]
        new = (own.ne(own.shift()) & ~(own.isna() & own.shift().isna())).any(axis=1).to_numpy()
        return [0, *(np.flatnonzero(new[1:]) + 1).tolist(), len(frame)]

    def each(frames):
        import pandas as pd

        rest: list = []
        for frame in frames:
            if not len(frame):
                continue
            if rest and len(bounds(frame)) == 2 and len(bounds(pd.concat([rest[-1].iloc[-1:], frame.iloc[:1]]))) == 2:
                rest.append(frame)
                continue
            whole = pd.concat([*rest, frame], ignore_index=True)
            at = bounds(whole)
            if len(at) > 2:
                yield step(whole.iloc[: at[-2]], at[:-1])
            rest = [whole.iloc[at[-2] :]]
        if rest:
            whole = pd.concat(rest, ignore_index=True)
            yield step(whole, [0, len(whole)])

    # a number of its own, as small rows can be much work
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInPandas(each, schema)


#: Rows that a task gathers before it works on the groups that are whole: many small groups share a step.
BATCH = 100_000


def _tables(rows: DataFrame, keys: list[str], order: list, step, schema) -> DataFrame:
    """_grouped with Arrow tables, so columns of any type pass as they are: step(table, bounds) gives a table."""

    def bounds(table: pa.Table) -> list[int]:
        new = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            column = table[k].combine_chunks()
            a, b = column.slice(0, len(new)), column.slice(1)
            new |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        return [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]

    def each(batches):
        held: list[pa.Table] = []
        n, enough = 0, BATCH
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n < enough:
                continue
            whole = pa.concat_tables(held).combine_chunks()
            at = bounds(whole)
            if len(at) > 2:
                yield from step(whole.slice(0, at[-2]), at[:-1]).to_batches()
            held = [whole.slice(at[-2])]
            n = held[0].num_rows
            enough = max(BATCH, 2 * n)
        if n:
            whole = pa.concat_tables(held).combine_chunks()
            yield from step(whole, bounds(whole)).to_batches()

    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)


def _one_by_one(run):
    """A step of _grouped from one that takes the frame of a group."""

    def step(pdf, at):
        import pandas as pd

        return pd.concat([run(pdf.iloc[a:z]) for a, z in zip(at, at[1:])])

    return step


def _fold(rows: DataFrame, keys: list[str], step, extra: str = "") -> DataFrame:
    """step(boxes, areas) names the rows of a group that stay and, if there is a further column, what it holds for them."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + extra

    def run(pdf, at):
        b, a = _boxes(pdf)
        kept: list[int] = []
        more: list[int] = []
        for p, q in zip(at, at[1:]):
            own, made = step(b[p:q], a[p:q])
            kept += [p + k for k in own]
            more += made
        out = pdf.iloc[kept]
        return out.assign(**{extra.split()[1]: np.array(more, np.int32)}) if extra else out

    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return _grouped(rows, keys, [area.desc(), "id"], run, schema)


def greedy_nms(boxes: DataFrame, keys: list[str], most: float = 0.7) -> DataFrame:
    """U8: largest first; a box goes when it and a kept one cover each other by more than `most`, either way.
    Columns id, x0, y0, x1, y1."""

    def step(b, a):
        kept: list[int] = []
        for k in range(len(b)):
            s = _shared(b[kept], b[k])
            if not len(s) or not (s > most * np.minimum(a[kept], a[k])).any():
                kept.append(k)
        return kept, []

    return _fold(boxes, keys, step)


def twins_dropped(boxes: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """Of boxes of one group with an intersection over union of `least`, the first stays; keys hold the group."""

    def step(b, a):
        kept: list[int] = []
        for k in range(len(b)):
            s = _shared(b[kept], b[k])
            if not len(s) or not (s >= least * (a[kept] + a[k] - s)).any():
                kept.append(k)
        return kept, []

    return _fold(boxes, keys, step)


def outermost(boxes: DataFrame, keys: list[str], slack: float = 2.0) -> DataFrame:
    """Frames within a kept one go, and are counted by it as `nested`."""

    def step(b, a):
        kept, nested = [], []
        for k in range(len(b)):
            o = b[kept]
            at = np.flatnonzero((o[:, 0] - slack <= b[k, 0]) & (o[:, 1] - slack <= b[k, 1]) & (o[:, 2] + slack >= b[k, 2]) & (o[:, 3] + slack >= b[k, 3])) if kept else []
            if len(at):
                nested[at[0]] += 1
            else:
                kept.append(k)
                nested.append(0)
        return kept, nested

    return _fold(boxes, keys, step, ", nested int")


#: Cells of polygons' boxes that are drawn at once.
DRAWN = 1 << 20


def drawn(x: np.ndarray, y: np.ndarray, at: np.ndarray, width: int, height: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, mask) for each of several polygons, in order: the cells that it covers, within its own box. They are its inside by the
    even-odd rule, and every cell that its outline runs through. x, y are cells of corners; polygon k has those from at[k] to at[k + 1], and a page
    of width by height[k] cells. Many polygons share a step; one without corners on the page has an empty mask."""
    n = np.diff(at)
    some = np.flatnonzero(n)
    left, right, top, bottom = (np.zeros(len(n), np.int64) for _ in range(4))
    right[:] = bottom[:] = -1
    if len(some):
        first = at[:-1][some]
        left[some], top[some] = np.maximum(0, np.minimum.reduceat(x, first)), np.maximum(0, np.minimum.reduceat(y, first))
        right[some], bottom[some] = np.minimum(width - 1, np.maximum.reduceat(x, first)), np.minimum(height[some] - 1, np.maximum.reduceat(y, first))
    w, h = np.maximum(0, right - left + 1), np.maximum(0, bottom - top + 1)
    whose, to = np.repeat(np.arange(len(n)), n), np.arange(1, len(x) + 1)
    to[at[1:][some] - 1] = at[:-1][some]
    dx, dy = x[to] - x, y[to] - y
    steps = np.maximum(np.maximum(abs(dx), abs(dy)), 1)
    size = np.cumsum(h * (w + 1) + np.bincount(whose, steps, len(n)).astype(np.int64))
    begin = 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + DRAWN, "right")))
        e = np.arange(at[begin], at[end])
        offset = np.concatenate([[0], np.cumsum((h * (w + 1))[begin:end])])
        # where edges cross the middles of rows: between the first and second, third and fourth, .. of a row is inside
        low, high = np.maximum(np.minimum(y[e], y[to[e]]), top[whose[e]]), np.minimum(np.maximum(y[e], y[to[e]]) - 1, bottom[whose[e]])
        count = np.maximum(0, high - low + 1)
        c = np.repeat(e, count)
        row = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        k = whose[c]
        cross = x[c] + (row - y[c]) * dx[c] / dy[c]
        order = np.lexsort((cross, row, k))
        k, row, cross = k[order][::2], row[order][::2], cross[order]
        start = np.clip(np.ceil(cross[::2]).astype(np.int64) - left[k], 0, w[k])
        stop = np.maximum(start, np.clip(np.floor(cross[1::2]).astype(np.int64) + 1 - left[k], 0, w[k]))
        line = offset[k - begin] + (row - top[k]) * (w[k] + 1)
        cells = np.cumsum(np.bincount(line + start, minlength=offset[-1] + 1) - np.bincount(line + stop, minlength=offset[-1] + 1)) > 0
        # the outline's cells: steps along the longer side of each edge, both ends among them
        points = steps[e] + 1
        o = np.repeat(e, points)
        i = np.arange(len(o)) - np.repeat(np.cumsum(points) - points, points)
        last, k = i == steps[o], whose[o]
        ox = np.round(np.where(last, x[to[o]], i * (dx[o] / steps[o]) + x[o])).astype(np.int64) - left[k]
        oy = np.round(np.where(last, y[to[o]], i * (dy[o] / steps[o]) + y[o])).astype(np.int64) - top[k]
        on = (ox >= 0) & (ox < w[k]) & (oy >= 0) & (oy < h[k])
        cells[(offset[k - begin] + oy * (w[k] + 1) + ox)[on]] = True
        for k in range(begin, end):
            yield int(top[k]), int(left[k]), cells[offset[k - begin] : offset[k - begin + 1]].reshape(h[k], w[k] + 1)[:, :-1]
        begin = end


def filled(outline: list, width: int, height: int) -> np.ndarray:
    """The cells of a grid that a polygon covers, as `drawn` has them. outline: (x, y) in shares of the grid."""
    p = np.array([(int(x * width), int(y * height)) for x, y in outline], np.int64).reshape(-1, 2)
    out = np.zeros((height, width), bool)
    for top, left, own in drawn(p[:, 0], p[:, 1], np.array([0, len(p)]), width, np.array([height])):
        out[top : top + own.shape[0], left : left + own.shape[1]] = own
    return out


def shaved(pieces: DataFrame, keys: list[str], first: str = "Panel wall", drop: float = 0.55, low: float = 0.05, width: int = 900) -> DataFrame:
    """Pieces (id, material, points in shares of the page, area_sf, patch, aspect: height over width) claim the cells that they
    cover: filled walls first, then the largest. A piece over 55% claimed goes; one over 5% loses the claimed share of area_sf; a
    patch stays whole, as its host was shaved for it; one that covers no cell goes. Pieces are drawn many at once, each within its own box."""

    def step(table: pa.Table, at: list[int]) -> pa.Table:
        points = table["points"].combine_chunks()
        corners = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        x, y = (pc.struct_field(points.flatten(), c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            raise ValueError("a corner of a piece has no place")
        aspects = table["aspect"].to_numpy()
        heights = np.repeat([max(1, int(width * float(aspects[a]))) for a in at[:-1]], np.diff(at))
        cells = drawn((x * width).astype(np.int64), (y * np.repeat(heights, np.diff(corners))).astype(np.int64), corners, width, heights)
        area = table["area_sf"].to_numpy().tolist()
        patch = pc.fill_null(table["patch"], False).to_pylist()
        kept, areas = [], []
        for a, z in zip(at, at[1:]):
            claimed = np.zeros((heights[a], width), bool)
            for k in range(a, z):
                top, left, own = next(cells)
                there = claimed[top : top + own.shape[0], left : left + own.shape[1]]
                n = int(np.count_nonzero(own))
                share = int(np.count_nonzero(own & there)) / n if n else 1.0
                if not n or (share > drop and not patch[k]):
                    continue
                there |= own
                kept.append(k)
                areas.append(round(area[k] * (1 - share), 1) if share > low and not patch[k] else area[k])
        place = table.schema.get_field_index("area_sf")
        return table.take(pa.array(kept, pa.int64())).set_column(place, table.schema.field(place), pa.array(areas, pa.float64(), from_pandas=True).cast(table.schema.field(place).type))

    order = [~F.coalesce(F.col("material").startswith(first), F.lit(False)), F.col("area_sf").desc(), F.col("id")]
    return _tables(pieces, keys, order, step, pieces.schema)


def spread_points(points: DataFrame, keys: list[str], gap: float = 6.0, most: int = 1500) -> DataFrame:
    """In order of id, points at least `gap` (Chebyshev) from all kept ones, the first `most`. Columns id, x, y."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(pdf):
        xy, grid, kept = pdf[["x", "y"]].to_numpy(float), {}, []
        for k, (x, y) in enumerate(xy):
            cx, cy = int(x // gap), int(y // gap)
            if all(max(abs(x - u), abs(y - v)) >= gap for dx in (-1, 0, 1) for dy in (-1, 0, 1) for u, v in grid.get((cx + dx, cy + dy), ())):
                grid.setdefault((cx, cy), []).append((x, y))
                kept.append(k)
                if len(kept) == most:
                    break
        return pdf.iloc[kept]

    return _grouped(points, keys, ["id"], _one_by_one(run), schema)


def guarded_openings(openings: DataFrame, keys: list[str], area: str, wall_area: str, share: float = 0.35, most: int = 24) -> DataFrame:
    """Four or more openings of like size (0.6 to 1.6 medians, 70% of them) are a grid and deduct nothing; else
    the largest count while their sum stays within the share of the wall. Native: (keys, position, area)."""
    from ..functions.folds import budgeted, upper_median

    g = openings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(area).alias("a"), F.col("id").alias("i")))).alias("__o"), F.max(wall_area).alias("__w"))
    values = F.transform("__o", lambda o: o["a"])
    g = g.withColumn("__v", values).withColumn("__m", upper_median(F.col("__v")))
    alike = F.size(F.filter("__v", lambda v: (v >= 0.6 * F.col("__m")) & (v <= 1.6 * F.col("__m"))))
    g = g.filter(~((F.size("__v") >= 4) & (alike >= 0.7 * F.size("__v"))))
    kept = g.withColumn("__k", budgeted(F.col("__v"), share * F.col("__w"), count=most)).select(*keys, F.posexplode("__k").alias("position", area))
    return kept.select(*keys, "position", area)
