"""Collocations, whitening and shards: against plain versions, and on odd tables."""

import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries as Q

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "a b c. a b c! a b\tc", "en"), (2, None, "en"), (3, "", None), (4, "A B c a b C", None), (4, "A B c a b C", None), (5, "a  b\nc a,b c", "und"),
    (None, "a b c a b c a b", "en"), (6, "é É é É é É. É é", "en"), (7, "x " * 3000 + "y", "fr"), (8, " . , ", "fr"), (9, "あ\U0001f600 ￮ あ\U0001f600 ￮", "ja"),
]


def plain_collocations(rows, max_n, least, share, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = tuple(x for x in re.split("[\x20\x09]+", piece) if x)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        own = {p: a for (x, p), a in f.items() if x == lang}
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * b >= share * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in own.items() if b >= least):
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), k, own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, _, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("max_n", "least", "share", "top"), [(3, 2, 50, 2000), (4, 2, 80, 5), (5, 3, 10, 2000), (2, 1, 50, 3)])
def test_collocations(spark, max_n, least, share, top):
    from plumbline.llm.collocations import collocations

    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string").withColumns({c: F.lit(5) for c in ("n", "a", "phrase", "score", "piece", "w", "k", "dotted.name")})
    got = collocations(docs, max_n, least, share, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain_collocations(ODD, max_n, least, share, top)


def test_collocations_of_large_counts(spark):
    """Products beyond 64 bits: the score of counts as they stand in a table of many terabytes."""
    a, l, r = 3_000_000_007, 5_000_000_029, 70_000_000_001
    row = spark.sql(f"select cast({a} as bigint) a, cast({l} as bigint) l, cast({r} as bigint) r")
    from plumbline.llm.collocations import score

    assert row.select(score(1_000_000)).first()[0] == 10**6 * a * a // (l * r)


def test_collocations_of_nothing(spark):
    from plumbline.llm.collocations import collocations

    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert collocations(empty).count() == 0
    assert collocations(spark.createDataFrame([(1, "alone. once", "en")], "doc_id bigint, text string, lang string"), least=1).count() == 0


def exact_whitening(vectors):
    """x of each row, and the covariance of the fit list in fractions."""
    xs = [tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    centred = [[Fraction(n * x[j] - sums[j], n) for j in range(dim)] for x in fit]
    return xs, fit, sums, [[sum(c[i] * c[j] for c in centred) / n for j in range(dim)] for i in range(dim)]


def same_up_to_sign(a, b):
    return min(np.abs(a - b).max(), np.abs(a + b).max())


def test_whitening_against_fractions(spark):
    """Large offsets, close eigenvalues: what plain doubles lose, the fractions keep."""
    from plumbline.llm.whitening import whiten

    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) * [3, 2.999, 1, 1, 0.2, 0.1] + [1e6, -4e5, 0, 3, 0, 0]
    rows = [(k, v.tolist(), "x") for k, v in enumerate(base)] + [(900 + k, base[0].tolist(), "x") for k in range(200)]
    odd = [(2000, None, "x"), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (2002, [float("nan")] * 6, "x"), (2003, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0], "x"), (2004, [1.0, 2.0], "x"), (2005, [], "x")]
    repeats = [(1, base[7].tolist(), "x"), (None, base[8].tolist(), "x"), (None, base[8].tolist(), "x")]
    df = spark.createDataFrame(rows + odd + repeats, "vec_id bigint, embedding array<double>, `n` string").withColumns({c: F.lit(1) for c in ("x", "v", "component", "whitened", "a.b")}).repartition(5)
    out = whiten(df, 4).collect()
    assert len(out) == 4 * (len(rows) + len(repeats))
    xs, fit, sums, cov = exact_whitening([r[1] for r in rows + repeats])
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    n, trace = len(fit), float(sum(cov[i][i] for i in range(6)))
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in xs])
    want = {}
    for (vec_id, *_), x, w in zip(rows + repeats, xs, centred @ vectors / np.sqrt(values)):
        want.setdefault((vec_id, sum((n * c - s) ** 2 for c, s in zip(x, sums))), []).append(w)
    got = {}
    for r in sorted(out, key=lambda r: r["component"]):
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
        got.setdefault((r["vec_id"], int(r["deviation"])), []).append(r["whitened"])
    assert {k: 4 * len(v) for k, v in want.items()} == {k: len(v) for k, v in got.items()}
    order = list(want)
    for c in range(4):
        assert same_up_to_sign(np.array([want[k][0][c] for k in order]), np.array([got[k][c * len(want[k])] for k in order])) < 1e-7


def test_eigen_refines_what_doubles_lose():
    """Close eigenvalues, and a low part that a double covariance cannot hold."""
    from plumbline.llm import whitening as W

    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (1.5 * np.eye(12) - 0.5 * q.T @ q)
    values = np.array([5, 5 - 1e-9, 4, 4 - 1e-12, *range(3, -5, -1)], np.longdouble)[:12] + 10
    a = (q * values) @ q.T
    high = a.astype(float)
    e, v = W.eigen(high, (a - high).astype(float))
    assert np.abs(e - np.sort(values)[::-1].astype(float)).max() < 1e-14 * 20
    for k in (0, 1):  # the gap of 1e-9 leaves plain doubles about 1e-6 of an angle
        assert same_up_to_sign(v[:, k], q[:, k].astype(float)) < 1e-8
    assert np.abs(v.T @ v - np.eye(12)).max() < 1e-14


def test_sums_without_error():
    """Sums in double-double against fractions, where doubles cancel."""
    from plumbline.llm import whitening as W

    rng = np.random.default_rng(4)
    a = rng.normal(size=(501, 3)) * 10.0 ** rng.integers(-8, 9, (501, 3))
    a = np.concatenate([a, -a * (1 - 2.0**-50)])
    high, low = W.total(*W.two_product(a, a))
    for j in range(3):
        exact = sum(Fraction(x) ** 2 for x in a[:, j].tolist())
        assert abs((Fraction(high[j]) + Fraction(low[j])) / exact - 1) < Fraction(1, 2**95)


def test_whitening_without_variance(spark):
    from plumbline.llm.whitening import whiten

    schema = "vec_id bigint, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [4.0, 8.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(1, 1), (2, 1), (3, 1)]  # one direction has variance
    far = whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["vec_id"], round(abs(r["whitened"]), 6)) for r in far) == [(1, round(1.5**0.5, 6)), (2, round(1.5**0.5, 6)), (3, 0.0)]


def test_op11_on_its_table(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    xs, fit, sums, _ = exact_whitening([r["embedding"] for r in rows])
    out = Q.op11_whitening(spark, SF).collect()
    n = len(fit)
    deviation = {r["vec_id"]: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for r, x in zip(rows, xs)}
    assert {(r["vec_id"], r["component"]) for r in out} == {(v, k) for v in deviation for k in (1, 2, 3, 4)} and len(out) == 4 * len(rows)
    assert all(r["deviation"] == deviation[r["vec_id"]] and r["n"] == n for r in out)
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    got = {(r["vec_id"], r["component"]): r for r in out}
    for k in range(1, 5):
        want = (np.array(xs, float) - np.array(sums) / n) @ vectors[:, -k] / values[-k] ** 0.5
        assert same_up_to_sign(want, np.array([got[r["vec_id"], k]["whitened"] for r in rows])) < 1e-8
        assert got[rows[0]["vec_id"], k]["explained"] == pytest.approx(values[-k] / values.sum(), rel=1e-9)
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 31, 50, 99, 100, 101, 257, 1000])
def test_permutation(spark, n):
    from plumbline.llm import sharding as S

    places = [S.permuted(k, n, 13) for k in range(n)]
    assert sorted(places) == list(range(n))
    assert [S.permuted(p, n, 13, backwards=True) for p in places] == list(range(n))
    assert [r[0] for r in spark.range(n).select(S.place(F.col("id"), n, 13)).collect()] == places
    assert S.row_at(places[-1] % 3, places[-1] // 3, n, 3, 13) == n - 1


def test_permutation_of_large_numbers(spark):
    from plumbline.llm import sharding as S

    n = 10**13 + 37
    some = [0, 1, 12345678901, n - 1]
    places = [S.permuted(k, n, 5) for k in some]
    assert [S.permuted(p, n, 5, backwards=True) for p in places] == some
    assert [r[0] for r in spark.createDataFrame([(k,) for k in some], "id bigint").select(S.place(F.col("id"), n, 5)).collect()] == places


def test_shards(spark, tmp_path):
    """Every row has a place; the places do not depend on how the table is dealt; a row's place can be computed and inverted."""
    from plumbline.llm import sharding as S

    rows = [(k // 3, "t" * (k % 5), 0) for k in range(100)] + [(7, "hot", 1)] * 90 + [(None, None, 2), (None, "", 3), (1 << 62, "x", 4), (-(1 << 62), "y", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `slot` int").withColumns({c: F.lit("mine") for c in ("k0", "came", "part", "size", "begin", "at")})
    out = S.shard(df.repartition(6), [F.col("doc_id"), F.col("text")], 8)
    got = out.collect()
    n = len(rows)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")
    numbered = sorted(got, key=lambda r: r["row_no"])
    assert [r["row_no"] for r in numbered] == list(range(n)) and list(map(key, numbered)) == sorted(map(key, numbered))
    for k in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == k)
        assert own == list(range(len(own))) and len(own) in (n // 8, n // 8 + 1)
    assert all(S.permuted(r["row_no"], n, 13) == r["slot"] * 8 + r["shard"] and S.row_at(r["shard"], r["slot"], n, 8, 13) == r["row_no"] for r in got)
    assert {r["k0"] for r in got} == {r["at"] for r in got} == {"mine"}
    lean = ["doc_id", "text", "shard", "slot"]
    again = S.shard(df.orderBy(F.desc("text")).coalesce(2), [F.col("doc_id"), F.col("text")], 8)
    assert sorted(map(repr, out.select(lean).collect())) == sorted(map(repr, again.select(lean).collect()))
    S.write_shards(out.select("row_no", "shard", "slot"), str(tmp_path / "shards"), 5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(tuple, back.select("row_no", "shard", "slot").collect())) == sorted((r["row_no"], r["shard"], r["slot"]) for r in got)
    assert S.shard(df.filter("false"), [F.col("doc_id")], 8).count() == 0


def test_op13_of_odd_texts(spark, tmp_path):
    spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é" * 5000, "x"), (3, "é" * 5000, "x"), (None, "a", "x")], "doc_id bigint, text string, size string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.op13_shards(spark, str(tmp_path)).collect()
    want = [(None, 2, zlib.crc32(b"a")), (1, 1, 0), (2, 1, 0), (3, 10001, zlib.crc32(("é" * 5000).encode())), (3, 10001, zlib.crc32(("é" * 5000).encode()))]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)} and len({r["shard"] for r in got}) == 5


def test_shards_are_native(spark):
    plan = Q.op13_shards(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
