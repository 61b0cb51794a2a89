"""Trains of parallel lines as walls, and hatched areas.

A train is a cluster of parallel lines on one page. Lines are linked and clustered page by page as they stream, and what is asked of a cluster is asked of the arrays of its columns: a cluster is part of a page, so an array is
never longer than a page has lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.folds import nearest_rank, upper_median
from ..sources.folder import keep
from . import regions
from .folds import _grouped, _tables
from .spatial import box_join

# Fixed values of trains: gap and overlap that link lines, broken courses, ends, density, extent, grids, margins of the sheet, clipping.
REACH, SHARE, COURSE, DASH = 45.0, 0.5, 3.0, 18.0
END_INK, LEAST_COLUMNS = 0.4, 4
DENSE, SPARSE, TALL, EVEN = (6, 1.5, 45.0, 0.7), (4, 12.0, 48.0, 0.75), 120.0, (0.4, 2.5)
LEAST_LONG, LEAST_WIDE, GRID_SPAN, GRID_SHARE = 50.0, 30.0, 0.7, 0.5
RIGHT, FOOT, THIN, FULL, EDGE = 0.86, 0.92, 0.06, 0.7, 0.03
CLIP, LEAST_CLIPPED = 6.0, 10.0
# Fixed values of plausible seams, of outlines and of the names.
MOST_SPACING_FT, MOST_LENGTH_FT = 4.2, 45.0
STEP, SNAP, CLAMP, LEAST_RUN = 36.0, 9.0, 10.0, 4.0
# Fixed values of hatches: strokes, angles, families and their ink, grid, closing and opening, purity, area, spread, overlap.
STROKE, ANGLES, FAMILY = (7.0, 0.22), ((24.0, 66.0), (114.0, 156.0)), 8.0
FAMILY_INK, FAMILIES, LEAST_STROKES, LEAST_IN_FAMILY = 400.0, 3, 40, 25
GRID, CLOSE, OPEN, LEAST_INK, PURITY, LEAST_SF, HATCH_SPREAD, HATCH_CLAIMED = 900, 4, 2, 300.0, 0.7, 100.0, 0.55, 0.2


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """withColumns by a generator of one row: what is used several times below is computed once, and the planner does not write it out again
    in each filter."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__made")
    return df.select(*[c for c in df.columns if c not in columns], made).select("*", "__made.*").drop("__made")


def _clustered(lines: DataFrame, keys: list[str], course: tuple[float, float] | None) -> DataFrame:
    """lines (keys, c, a0, a1) with the least line (__c, __a0, __a1) of their cluster, as line_edges and components tell it. A cluster is part of a page,
    so lines are linked page by page, and no link is written: they are many times the lines."""

    def step(pdf: pd.DataFrame, at: list[int]) -> pd.DataFrame:
        v = pdf[["c", "a0", "a1"]].to_numpy(float)
        root = np.concatenate([a + _roots(v[a:z], course) for a, z in zip(at, at[1:])])
        return pdf.assign(**{f"__{c}": v[root, k] for k, c in enumerate(("c", "a0", "a1"))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields) + ", __c double, __a0 double, __a1 double"
    return _grouped(lines, keys, ["c", "a0", "a1"], step, schema)


def _roots(v: np.ndarray, course: tuple[float, float] | None, block: int = 1_000_000) -> np.ndarray:
    """The first line of the cluster of each of a page's lines, which stand in order (c, a0, a1). Links are formed in blocks."""
    c, a0, a1 = v.T
    root, n = np.arange(len(c)), len(c)
    many = np.searchsorted(c, c + REACH, "left") - np.arange(n) - 1
    i = 0
    while i < n:
        z = i + max(1, int(np.searchsorted(np.cumsum(many[i:]), block, "right")))
        p = np.repeat(np.arange(i, z), many[i:z])
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(many[i:z]) - many[i:z], many[i:z])
        over, apart = np.minimum(a1[p], a1[q]) - np.maximum(a0[p], a0[q]), c[q] - c[p]
        linked = over > SHARE * np.minimum(a1[p] - a0[p], a1[q] - a0[q])
        if course:
            linked |= (apart <= course[0]) & (over > -course[1])
        linked &= apart < REACH
        # what was joined before stays joined
        root = regions._merged(n, np.concatenate([np.arange(n), p[linked]]), np.concatenate([root, q[linked]]))
        i = z
    return root


def train_regions(lines: DataFrame, crossing: DataFrame, pages: DataFrame, keys: list[str], chain: bool = False) -> DataFrame:
    """(keys, axis, train, lines, spacing, med_len): lines is array<struct<c, a0, a1>>, train its cluster's least line.

    lines: (keys, axis, c, a0, a1), each once; crossing: (keys, axis, b0, b1, bc), long lines across that axis; pages: (keys, width, height).
    1. Lines less than 45 points apart that overlap by over half of the shorter link; with `chain` dashes of one course too. Four make a cluster.
    2. Columns at either end with little ink fall away. Four must be left, evenly spaced: six from 1.5 to 45 points apart, or tall ones from 12 to 48.
    3. Clusters that are short, narrow, in the title block or along the sheet's edge go, and grids: those that half as many lines cross in full.
    4. Lines are clipped to the 10th and 90th percentile of their ends, and four must still be longer than 10 points."""
    own = lines.select(*keys, "axis", *[F.col(c).cast("double").alias(c) for c in ("c", "a0", "a1")]).distinct()
    line = F.struct("axis", *keys, *[F.col(f"__{c}").alias(c) for c in ("c", "a0", "a1")])
    columns = _clustered(own, [*keys, "axis"], (COURSE, DASH) if chain else None).withColumn("component", line).groupBy(*keys, "axis", "component", "c").agg(F.array_sort(F.collect_list(F.struct("a0", "a1"))).alias("s"), F.sum(F.col("a1") - F.col("a0")).alias("ink"))
    g = columns.groupBy(*keys, "axis", "component").agg(F.array_sort(F.collect_list(F.struct("c", "s", "ink"))).alias("w"))
    every = lambda w, f: F.flatten(F.transform(w, lambda v: F.transform(v["s"], lambda s: f(v, s))))
    g = _once(g, length=every("w", lambda v, s: s["a1"] - s["a0"])).filter(F.size("length") >= LEAST_COLUMNS)
    g = _once(g, least=END_INK * nearest_rank(F.col("length"), 50))
    g = _once(g, ok=F.transform(F.filter("w", lambda v: v["ink"] >= F.col("least")), lambda v: v["c"])).filter(F.size("ok") > 0)
    g = _once(g, c0=F.array_min("ok"), c1=F.array_max("ok"))
    g = _once(g, w=F.filter("w", lambda v: v["c"].between(F.col("c0"), F.col("c1")))).filter(F.size("w") >= LEAST_COLUMNS)
    g = _once(g, n=F.size("w"), gaps=F.filter(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.get("w", i)["c"] - F.get("w", i - 1)["c"]), lambda d: d > 0.5)).filter(F.size("gaps") > 0)
    g = _once(g, spacing=upper_median(F.col("gaps")), tall=nearest_rank(every("w", lambda v, s: s["a1"] - s["a0"]), 50))
    g = _once(g, even=F.size(F.filter("gaps", lambda d: d.between(EVEN[0] * F.col("spacing"), EVEN[1] * F.col("spacing")))) / F.size("gaps"))
    fits = lambda k: (F.col("n") >= k[0]) & F.col("spacing").between(k[1], k[2]) & (F.col("even") >= k[3])
    g = g.filter(fits(DENSE) | (fits(SPARSE) & (F.col("tall") >= TALL)))
    starts, ends = every("w", lambda v, s: s["a0"]), every("w", lambda v, s: s["a1"])
    g = _once(g, a0=F.array_min(starts), a1=F.array_max(ends), top=nearest_rank(starts, 10) - CLIP, foot=nearest_rank(ends, 90) + CLIP)
    g = g.filter((F.col("a1") - F.col("a0") >= LEAST_LONG) & (F.col("c1") - F.col("c0") >= LEAST_WIDE)).join(pages.select(*keys, "width", "height"), keys)
    up = F.col("axis") == "v"
    x0, x1 = F.when(up, F.col("c0")).otherwise(F.col("a0")), F.when(up, F.col("c1")).otherwise(F.col("a1"))
    y0, y1 = F.when(up, F.col("a0")).otherwise(F.col("c0")), F.when(up, F.col("a1")).otherwise(F.col("c1"))
    wide, high = F.col("width"), F.col("height")
    title = ((x0 + x1) / 2 > RIGHT * wide) | ((y0 + y1) / 2 > FOOT * high)
    strip = lambda lo, hi, across, a, b, along: (hi - lo < THIN * across) & (b - a > FULL * along) & ((lo < EDGE * across) | (hi > (1 - EDGE) * across))
    g = keep(g.filter(~title & ~strip(y0, y1, high, x0, x1, wide) & ~strip(x0, x1, wide, y0, y1, high)).drop("width", "height", "gaps", "length", "ok"), "trains")
    box = lambda a0, a1, c0, c1: F.struct(a0.cast("double").alias("x0"), c0.cast("double").alias("y0"), a1.cast("double").alias("x1"), c1.cast("double").alias("y1"))
    over = crossing.select(*keys, "axis", "b0", "b1", "bc", box(F.col("bc"), F.col("bc"), F.col("b0"), F.col("b1")).alias("__x"))
    mine = g.select(*keys, "axis", "component", "n", "c0", "c1", "a0", "a1", box(F.col("a0") - 2, F.col("a1") + 2, F.col("c0"), F.col("c1")).alias("__t"))
    full = (F.col("bc") > F.col("a0") - 2) & (F.col("bc") < F.col("a1") + 2) & (F.least("b1", "c1") - F.greatest("b0", "c0") > GRID_SPAN * F.greatest(F.lit(1.0), F.col("c1") - F.col("c0")))
    grids = box_join(over, mine, [*keys, "axis"], "__x", "__t", 512.0, test=full).groupBy(*keys, "axis", "component", "n").agg(F.count(F.lit(1)).alias("crossed")).filter(F.col("crossed") >= GRID_SHARE * F.col("n"))
    g = g.join(grids.select(*keys, "axis", "component"), [*keys, "axis", "component"], "left_anti")
    clipped = every("w", lambda v, s: F.struct(v["c"].alias("c"), F.greatest(s["a0"], F.col("top")).alias("a0"), F.least(s["a1"], F.col("foot")).alias("a1")))
    g = _once(g, lines=F.filter(clipped, lambda s: s["a1"] - s["a0"] > LEAST_CLIPPED)).filter(F.size("lines") >= 4)
    return g.select(*keys, "axis", F.col("component").alias("train"), "lines", "spacing", nearest_rank(F.transform("lines", lambda s: s["a1"] - s["a0"]), 50).alias("med_len"))


def _columns(lines: Column) -> Column:
    """array<struct<c, a0, a1, h>> of lines in order: the extent of each column, and its longest line."""
    none = F.expr("cast(array() as array<struct<c:double,a0:double,a1:double,h:double>>)")
    one = lambda c, a0, a1, h: F.struct(c.alias("c"), a0.alias("a0"), a1.alias("a1"), h.alias("h"))

    def step(s: Column, v: Column) -> Column:
        last = F.element_at(s, -1)
        h = v["a1"] - v["a0"]
        same = (F.size(s) > 0) & (F.get(s, F.size(s) - 1)["c"] == v["c"])
        grown = F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(one(last["c"], F.least(last["a0"], v["a0"]), F.greatest(last["a1"], v["a1"]), F.greatest(last["h"], h))))
        return F.when(same, grown).otherwise(F.concat(s, F.array(one(v["c"], v["a0"], v["a1"], h))))

    return F.aggregate(F.array_sort(lines), none, step)


def train_area(lines: Column) -> Column:
    """Half the gaps to the columns beside, times the longest line of each column: openings between lines count nothing."""
    cols = _columns(lines)
    at = lambda w, i: F.get(w, i)["c"]
    part = lambda w, i: (F.coalesce(at(w, i) - at(w, i - 1), F.lit(0.0)) + F.coalesce(at(w, i + 1) - at(w, i), F.lit(0.0))) / 2 * F.get(w, i)["h"]
    total = lambda w: F.aggregate(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: part(w, i)), F.lit(0.0), lambda s, v: s + v)
    return F.get(F.transform(F.array(cols), total), F.lit(0))


def train_outline(axis: Column, lines: Column, snaps: Column) -> Column:
    """array<struct<x, y>>: the left and right profile of a train. Neighbouring columns whose ends stay within 36 points of the run so far make
    a run; its ends snap to the nearest of `snaps` (places along the lines) less than 9 points away, the first of equals; with three runs or more they are
    held to the 15th and 85th percentile, less than 4 points long ones going. Smoothing of small steps is left to what draws it."""
    none = F.expr("cast(array() as array<struct<c0:double,c1:double,t:double,b:double>>)")
    one = lambda c0, c1, t, b: F.struct(c0.alias("c0"), c1.alias("c1"), t.alias("t"), b.alias("b"))

    def step(s: Column, v: Column) -> Column:
        last = F.get(s, F.size(s) - 1)
        near = (F.size(s) > 0) & (F.abs(last["t"] - v["a0"]) < STEP) & (F.abs(last["b"] - v["a1"]) < STEP)
        grown = F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(one(last["c0"], v["c"], F.least(last["t"], v["a0"]), F.greatest(last["b"], v["a1"]))))
        return F.when(near, grown).otherwise(F.concat(s, F.array(one(v["c"], v["c"], v["a0"], v["a1"]))))

    def snapped(v: Column) -> Column:
        near = F.filter(F.transform(snaps, lambda c, i: F.struct(F.abs(c - v).alias("d"), i.alias("i"), c.cast("double").alias("c"))), lambda s: s["d"] < SNAP)
        return F.coalesce(F.array_min(near)["c"], v)

    runs = F.transform(F.aggregate(_columns(lines), none, step), lambda r: one(r["c0"], r["c1"], snapped(r["t"]), snapped(r["b"])))
    top, foot = (lambda w: nearest_rank(F.transform(w, lambda r: r["t"]), 15) - CLAMP), (lambda w: nearest_rank(F.transform(w, lambda r: r["b"]), 85) + CLAMP)
    held = lambda w: F.filter(F.transform(w, lambda r: one(r["c0"], r["c1"], F.greatest(r["t"], top(w)), F.least(r["b"], foot(w)))), lambda r: r["b"] - r["t"] > LEAST_RUN)
    runs = F.get(F.transform(F.array(runs), lambda w: F.when(F.size(w) >= 3, held(w)).otherwise(w)), F.lit(0))
    point = lambda c, a: F.when(axis == "v", F.struct(c.alias("x"), a.alias("y"))).otherwise(F.struct(a.alias("x"), c.alias("y")))
    there = lambda w: F.flatten(F.transform(w, lambda r: F.array(point(r["c0"], r["t"]), point(r["c1"], r["t"]))))
    back = lambda w: F.flatten(F.transform(F.reverse(w), lambda r: F.array(point(r["c1"], r["b"]), point(r["c0"], r["b"]))))
    return F.get(F.transform(F.array(runs), lambda w: F.concat(there(w), back(w))), F.lit(0))


def plausible_trains(trains: DataFrame, ft_per_pt: Column) -> DataFrame:
    """F16: trains with seams up to 4.2 feet apart and up to 45 feet long, and the material that their pattern names."""
    feet = F.col("spacing") * ft_per_pt
    up = F.when(feet >= 0.8, F.concat(F.lit("Vertical panel - "), F.format_number(feet, 1), F.lit("' seams"))).otherwise("Vertical rib panel")
    level = F.when(feet < 2, F.concat(F.lit("Lap / horizontal - "), F.format_number(F.bround(feet * 12), 0), F.lit("in courses"))).otherwise(F.concat(F.lit("Horizontal panel - "), F.format_number(feet, 1), F.lit("'")))
    kept = trains.filter((feet <= MOST_SPACING_FT) & (F.col("med_len") * ft_per_pt <= MOST_LENGTH_FT))
    return kept.withColumn("material", F.when(F.col("axis") == "v", up).otherwise(level))


def _grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """All places within `radius` of one, both ways."""
    for turned in (False, True):
        mask, own = (mask.T, mask.T) if turned else (mask, mask)
        mask = own.copy()
        for d in range(1, radius + 1):
            mask[:, d:] |= own[:, :-d]
            mask[:, :-d] |= own[:, d:]
        mask = mask.T if turned else mask
    return mask


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the runs of a mask's rows, in scan order."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, a = np.nonzero(edge == 1)
    return y, a, np.nonzero(edge == -1)[1]


def _met(y: np.ndarray, a: np.ndarray, z: np.ndarray, slack: int) -> np.ndarray:
    """The first run of the region of each run; runs of neighbouring rows meet along a side, or at a corner with a slack of 1."""
    wide = int(z.max(initial=0)) + 4
    low = np.searchsorted(y * wide + z, (y + 1) * wide + a - slack, "right")
    many = np.maximum(np.searchsorted(y * wide + a, (y + 1) * wide + z + slack, "left") - low, 0)
    p = np.repeat(np.arange(len(y)), many)
    return regions._merged(len(y), p, np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many))


def _painted(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """regions.filled on one mask: the number of each place's region, or -1, and the first places (y, x) by number."""
    y, a, z = _runs(mask)
    root = _met(y, a, z, 1)
    first, name = np.unique(root, return_inverse=True)
    out = np.full(mask.shape, -1)
    # a rim of one place around the mask is the outside: its first run is the corner's
    hy, ha, hz = _runs(~np.pad(mask, 1))
    hole = _met(hy, ha, hz, 0)
    wide = mask.shape[1] + 4
    around = name[np.searchsorted(y * wide + z, (hy[hole] - 1) * wide + ha[hole] - 1).clip(0, len(y) - 1)]
    inner = np.flatnonzero(hole != hole[0])
    for y_, a_, z_, n_ in ((y, a, z, name), (hy[inner] - 1, ha[inner] - 1, hz[inner] - 1, around[inner])):
        size = z_ - a_
        out.ravel()[np.repeat(y_ * mask.shape[1] + a_ - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(n_, size)
    return out, np.stack([y[first], a[first]], 1)


def _patches(table: pa.Table, at: list[int], keys: list[str], grid: int) -> pa.Table:
    """The regions of pages' hatches that hold enough ink of their own family: strokes and taken cells come as rows of a page."""
    stroke, family = table["stroke"].to_numpy().astype(bool), table["family"].to_numpy()
    u0, v0, u1, v1, ink, cell, most = (table[c].to_numpy() for c in ("x0", "y0", "x1", "y1", "ink", "cell", "rows"))
    group, found = [], []
    for n, (i, j) in enumerate(zip(at, at[1:], strict=False)):
        own = i + np.flatnonzero(stroke[i:j])
        if not len(own):
            continue
        rows, per = int(most[own[0]]), float(cell[own[0]])
        held = i + np.flatnonzero(~stroke[i:j])
        tx, ty = u0[held].astype(np.int64), v0[held].astype(np.int64)
        on = (tx >= 0) & (tx < grid) & (ty >= 0) & (ty < rows)
        taken = np.zeros((rows, grid), bool)
        taken[ty[on], tx[on]] = True
        mx, my = (np.minimum(np.floor((p[own] + q[own]) / 2 * per).astype(np.int64), top - 1) for p, q, top in ((u0, u1, grid), (v0, v1, rows)))
        mids = (mx >= 0) & (my >= 0)
        for f in table["strong"][int(own[0])].as_py():
            k = own[family[own] == f]
            a, b, c, d = (v[k] * per for v in (u0, v0, u1, v1))
            steps = np.maximum(np.ceil(np.maximum(np.abs(c - a), np.abs(d - b))), 1).astype(np.int64)
            part = np.arange(steps.sum() + len(steps)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
            a, b, c, d, steps = (np.repeat(v, steps + 1) for v in (a, b, c, d, steps))
            x, y = (np.floor(p + (q - p) * part / steps).astype(np.int64) for p, q in ((a, c), (b, d)))
            use = (x >= -1) & (x < grid) & (y >= -1) & (y < rows)
            spot = np.zeros((rows + 1, grid + 1), bool)
            spot[y[use] + 1, x[use] + 1] = True
            mask = spot[1:, 1:] | spot[1:, :-1] | spot[:-1, 1:] | spot[:-1, :-1]
            rim = CLOSE + OPEN
            mask = ~_grown(~_grown(np.pad(mask, rim), CLOSE), CLOSE)
            mask = _grown(~_grown(~mask, OPEN), OPEN)[rim:-rim, rim:-rim]
            if not mask.any():
                continue
            label, first = _painted(mask)
            y, x = np.nonzero(label >= 0)
            of = label[y, x]
            where = label[my[mids], mx[mids]]
            weight, mine = ink[own][mids], family[own][mids] == f
            sums = [np.bincount(where[w], weight[w], len(first)) for w in (where >= 0, (where >= 0) & mine)]
            box = [np.full(len(first), m) for m in (grid, rows, -1, -1)]
            for k, (least, v) in enumerate(((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))):
                least.at(box[k], of, v)
            good = (sums[0] >= LEAST_INK) & (sums[1] >= PURITY * sums[0])
            columns = (np.full(len(first), f), *first.T, np.bincount(of, minlength=len(first)), np.bincount(of, taken[y, x], len(first)), *box)
            found.append(np.stack(columns, 1)[good].astype(np.int64))
            group += [at[n]] * int(good.sum())
    found = np.concatenate(found) if found else np.zeros((0, 9), np.int64)
    out = table.select(keys).take(pa.array(group, pa.int64()))
    for k, name in enumerate(("family", "__ry", "__rx", "size", "taken", "x0", "y0", "x1", "y1")):
        out = out.append_column(name, pa.array(found[:, k].astype(np.int64 if name in ("size", "taken") else np.int32)))
    return out


def hatched(segments: DataFrame, taken: DataFrame, pages: DataFrame, keys: list[str], tile: int = regions.TILE, grid: int = GRID) -> DataFrame:  # noqa: ARG001 - a grid is one tile
    """(keys, family, region, size, area_sf, x0, y0, x1, y1): areas hatched by parallel slanting strokes of one angle family, in cells of a `grid` so
    many cells wide.

    A page's grid has a fixed size, however many strokes it has, and a task draws one at a time: no cell is written.
    segments: (keys, x0, y0, x1, y1) in points; taken: (keys, x, y) cells that pieces hold already; pages: (keys, width, height, ft_per_pt).
    1. Strokes from 7 points to 0.22 of the page, at 24 to 66 degrees either way, by families of 8 degrees of the half turn. A page needs 40 of
       them; a family 400 points of ink and 25 strokes, and is one of the three with most ink.
    2. The cells that a family's strokes pass, closed and opened, fall into regions (corners count), whose holes are filled.
    3. A region must measure 100 square feet, not sprawl, overlap pieces by a fifth at most, and hold 300 points of ink of which 0.7 are its family's."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    angle = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))
    s = segments.select(*keys, "x0", "y0", "x1", "y1", F.hypot(dx, dy).alias("ink"), angle.alias("angle")).join(pages.select(*keys, "width", "height", "ft_per_pt"), keys)
    s = s.filter((F.col("ink") >= STROKE[0]) & (F.col("ink") <= STROKE[1] * F.greatest("width", "height")) & (F.col("angle").between(*ANGLES[0]) | F.col("angle").between(*ANGLES[1])))
    cell = F.lit(float(grid)) / F.col("width")
    s = keep(s.withColumns({"family": F.floor(F.col("angle") / FAMILY).cast("int"), "cell": cell, "rows": F.greatest(F.lit(1), F.floor(F.lit(grid) * F.col("height") / F.col("width")).cast("int"))}), "strokes")
    enough = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_STROKES).drop("n")
    ink = s.groupBy(*keys, "family").agg(F.sum("ink").alias("ink"), F.count(F.lit(1)).alias("n")).filter(F.col("ink") > FAMILY_INK)
    # the strongest of a page's at most 12 families; one with few strokes still takes its place
    best = ink.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("ink", (-F.col("family")).alias("f"), "n")), asc=False), 1, FAMILIES).alias("b")).select(*keys, F.explode("b").alias("b")).filter(F.col("b.n") >= LEAST_IN_FAMILY).select(*keys, (-F.col("b.f")).alias("family"))
    strong = best.join(enough, keys, "left_semi").groupBy(*keys).agg(F.collect_list("family").alias("strong"))
    none = F.lit(None).cast("double")
    ends = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "ink", "cell")]
    drawn = s.join(strong, keys).select(*keys, F.lit(True).alias("stroke"), *ends, "family", "rows", "strong")
    held = taken.join(strong, keys, "left_semi").select(*keys, F.lit(False).alias("stroke"), F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"), *[none.alias(c) for c in ("x1", "y1", "ink", "cell")], *[F.lit(None).cast(k).alias(c) for c, k in (("family", "int"), ("rows", "int"), ("strong", "array<int>"))])
    schema = regions._with(s.select(*keys).schema, family=regions.INT, __ry=regions.INT, __rx=regions.INT, size=LongType(), taken=LongType(), x0=regions.INT, y0=regions.INT, x1=regions.INT, y1=regions.INT)
    share = _tables(drawn.unionByName(held), keys, [], lambda table, at: _patches(table, at, keys, grid), schema)
    share = share.withColumn("region", F.struct(F.col("__ry").alias("y"), F.col("__rx").alias("x")))
    out = share.join(pages.select(*keys, "width", "height", "ft_per_pt"), keys)
    area = F.col("size") * F.pow(F.col("width") / grid * F.col("ft_per_pt"), F.lit(2))
    sprawl = (F.col("x1") - F.col("x0") + 1 > HATCH_SPREAD * grid) & (F.col("y1") - F.col("y0") + 1 > HATCH_SPREAD * F.floor(F.lit(grid) * F.col("height") / F.col("width")))
    kept = out.withColumn("area_sf", F.round(area, 1)).filter((area >= LEAST_SF) & ~sprawl & (F.col("taken") <= HATCH_CLAIMED * F.col("size")))
    return kept.select(*keys, "family", "region", "size", "area_sf", "x0", "y0", "x1", "y1")
