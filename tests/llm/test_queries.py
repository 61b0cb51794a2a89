"""The registered queries of the training-data operators: against their SQL, plain versions, round trips and held-out labels."""

import random
import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    found = con.execute(Q.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(found.fetchall())


def test_op2_keeps_every_token(spark, documents):
    out = Q.op2_best_fit(spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    text = dict(documents)
    size = {d: len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) + 1 for d, t in documents}
    total, bins = {}, {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        bins.setdefault(r["bin_id"], []).append(r)
    assert total == size
    for own in bins.values():
        assert sum(r["n_tokens"] for r in own) == own[0]["bin_tokens"] <= 4096 and sorted(r["position"] for r in own) == list(range(len(own)))
        part = [r for r in own if r["n_tokens"] < 4096]
        sources, copies = [source[r["doc_id"]] for r in part if source[r["doc_id"]] is not None], [text[r["doc_id"]].lower() for r in part if text[r["doc_id"]]]
        assert all(sources.count(s) <= 4 for s in sources) and len(copies) == len(set(copies))


def test_op4_scores_by_exhaustion(spark, documents, labels):
    """Short documents against a sum over all labellings of their lines; the whole query against held-out labels."""
    from plumbline.llm import kernel as K
    from plumbline.llm import quality_crf as C

    out = {r["doc_id"]: r for r in Q.op4_quality_crf(spark, SF).collect()}
    assert set(out) == {d for d, _ in documents}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for d, r in out.items())
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = C.fit(docs, marks, "quality", C.remainder(5) != 0)
    assert model.start[1] != 0 and model.start[0] == -model.start[1]
    seen = 0
    for d, text in documents:
        x, size, _ = C.line_features(*K.flat(pa.array([text])))
        if len(x) > 9:
            continue
        e, tr, st, n = x.astype(float) @ model.weights, model.transition, model.start, len(x)
        weight = {y: np.exp(st[y[0]] + sum(e[k] * v for k, v in enumerate(y)) + sum(tr[p, q] for p, q in zip(y, y[1:]))) for y in product((0, 1), repeat=n)}
        good = [sum(w for y, w in weight.items() if y[k]) / sum(weight.values()) for k in range(n)]
        assert out[d]["score"] == pytest.approx(np.average(good, weights=size + 1.0), abs=1e-9)
        seen += 1
    assert seen > 30
    known = [(out[d]["predicted"], labels[d]["quality"]) for d in out if d in labels and labels[d]["quality"] is not None and out[d]["held_out"]]
    assert len(known) > 5 and np.mean([p == y for p, y in known]) >= 0.85


def test_op9_scores_by_pairs(spark, documents, labels):
    """Every document against the sum over all pairs of its terms."""
    from plumbline.llm import quality_crf as C
    from plumbline.llm import toxicity_fm as T

    out = {r["doc_id"]: r for r in Q.op9_toxicity(spark, SF).collect()}
    assert set(out) == {d for d, _ in documents}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for d, r in out.items())
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = T.fit(docs, marks, "toxic", C.remainder(3) != 1)
    for d, text in documents[:60]:
        bucket, _ = T.distinct(*T.terms(pa.array([text])))
        at = [model.slot[b] - 1 for b in bucket.tolist() if model.slot[b]]
        raw = model.bias + sum(model.weights[k] for k in at) + sum(float(model.vectors[a] @ model.vectors[b]) for n, a in enumerate(at[:200]) for b in at[n + 1 : 200])
        if len(at) <= 200:
            assert out[d]["score"] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-6)


def test_op7_reads_back_what_the_tokenizer_says(spark, documents):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain, expected, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for d, t in sorted(documents):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, Q.op7_token_files(spark, SF).collect())) == expected


def test_op10_prunes_and_finds(spark):
    from plumbline.llm import ann as A

    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    usable = A.usable(rows, "vec_id", "embedding")
    index = A.Index.fit(usable)
    assert 1 < index.parts and index.probes < index.parts
    have = {r["vec_id"]: r["v"] for r in usable.collect()}
    ids = sorted(have)
    expected = A.brute_force(ids, np.array([have[k] for k in ids]), [k for k in ids if k % 50 == 0])
    found = {}
    for r in Q.op10_ann(spark, SF).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(found) == set(expected) and all(len(v) == 5 == len(set(v)) for v in found.values())
    assert np.mean([len(set(found[q]) & set(e)) / 5 for q, e in expected.items()]) >= 0.9


def test_toxic_pairs_that_say_nothing_alone(spark):
    """Toxic where exactly one of two words stands: neither word tells anything by itself."""
    from plumbline.llm import toxicity_fm as T

    rnd = random.Random(6)
    filler, made = [f"word{k}" for k in range(60)], []
    for d in range(1200):
        one, other = rnd.random() < 0.5, rnd.random() < 0.5
        w = rnd.choices(filler, k=20) + ["scoundrels"] * one + ["neighbours"] * other
        rnd.shuffle(w)
        made.append((d, " ".join(w), int(one != other)))
    table = spark.createDataFrame([(d, t) for d, t, _ in made], "doc_id bigint, text string")
    marks = spark.createDataFrame([(d, y) for d, _, y in made], "doc_id bigint, toxic int")
    out = T.score(table, T.fit(table, marks, "toxic", F.col("doc_id") % 2 == 0)).join(marks, "doc_id").filter("doc_id % 2 = 1").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in out]) >= 0.9


def test_columns_of_any_name_pass(spark):
    from plumbline.llm import decontaminate, line_dedup, packing, quality_crf, toxicity_fm

    line = "one two three four five six seven eight nine ten eleven twelve"
    names = ["doc_id", "text", "source", "a.b", "__id", "__gone", "key", "gone", "n_words", "n_hit", "hit_runs", "items", "KEY"]
    rows = [(1, line, "s", 1, "x", "y", "k", "g", 9, 8, 7, "i", 5), (2, line + "\nother", "s", 2, "x", "y", "k", "g", 9, 8, 7, "i", 5), (None, line, "s", 3, None, None, None, None, None, None, None, None, None), (4, None, None, 4, "x", "y", "k", "g", 9, 8, 7, "i", 5)]
    kinds = "doc_id bigint, text string, source string, `a.b` int, __id string, __gone string, `k1` string, gone string, n_words int, n_hit int, hit_runs int, items string, `k2` int"
    docs = spark.createDataFrame(rows, kinds).toDF(*[n if n != "KEY" else "key_" for n in names])
    columns = docs.columns
    rest = lambda r: tuple(r[c] for c in columns if c != "text")
    before = {rest(r) for r in docs.collect()}

    out = line_dedup.dedup_lines(docs).collect()
    assert {rest(r) for r in out} == before and [r["text"] for r in sorted(out, key=lambda r: r["a.b"])] == [line, "other", line, None]
    assert line_dedup.dedup_lines(docs).columns == [*columns, "n_lines", "n_removed"]
    assert line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("mine"))).columns == [*columns, "n_lines", "n_removed"]
    items = spark.createDataFrame([(7, " ".join(line.split()[:10]))], "item_id bigint, text string")
    found = decontaminate.contamination(docs, items)
    assert found.columns == [*columns, "_n_words", "_n_hit", "_hit_runs", "_items"] and {rest(r) for r in found.collect()} == before
    assert {r["_n_hit"] for r in found.collect()} == {10, 0}
    clean = decontaminate.decontaminate(docs, items, max_span=9, max_coverage=1.0)
    assert clean.columns == columns and {rest(r) for r in clean.collect()} == before
    assert decontaminate.contamination(docs.withColumnRenamed("text", "body"), items, text_col="body").columns[1] == "body"
    for scored in (quality_crf.score(docs, quality_crf.LineCRF(np.zeros(3 * quality_crf.OWN + 1), np.zeros((2, 2)), np.zeros(2))), toxicity_fm.score(docs, toxicity_fm.FactorizationMachine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 4))))):
        assert {rest(r) for r in scored.collect()} == before and {r["score"] for r in scored.collect()} == {0.5}
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == {1, 2, 4}


def test_null_texts_share_bins(spark):
    from plumbline.llm import packing

    rows = [(k, None if k < 4 else "", f"s{k}") for k in range(8)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len({r["bin_id"] for r in out}) == 1 and len(out) == 8
    # clusters beside nulls stay 64-bit numbers
    big = 2**62
    rows = [(1, "a b", big), (2, "c d", big + 1), (3, "e f", None), (4, "g h", big)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, c bigint").withColumn("source", F.lit(None)), cluster=F.col("c")).collect()
    bins = {r["doc_id"]: r["bin_id"] for r in out}
    assert bins[1] == bins[2] == bins[3] != bins[4]


def test_ids_with_several_vectors(spark):
    from plumbline.llm import ann as A

    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [1.0, 0.2]), (4, [-1.0, 0.0]), (4, [-1.0, 0.1]), (5, [0.5, 0.5]), (6, [1.0, 0.0]), (7, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in A.nearest(table, table.filter("vec_id in (1, 2)"), k=4).orderBy("query_id", "rank").collect()]
    assert got == [(1, 6), (1, 2), (1, 3), (1, 5), (2, 3), (2, 1), (2, 6), (2, 5)]


def test_search_goes_on_until_k_are_found(spark):
    from plumbline.llm import ann as A

    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8))
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    index = A.Index.fit(A.usable(table, "vec_id", "embedding"), target=0.01)
    assert index.probes == 1 and index.parts == 8
    few = table.filter("vec_id % 40 = 0")  # parts hold about two each
    out = A.nearest(few, few, k=5, index=index).groupBy("query_id").count().collect()
    assert len(out) == 15 and all(r["count"] == 5 for r in out)


def test_empty_tables_of_fits(spark):
    from plumbline.llm import quality_crf, toxicity_fm

    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for module, label in ((quality_crf, "quality"), (toxicity_fm, "toxic")):
        none = module.fit(docs.limit(0), marks, label, F.lit(True))
        assert module.score(docs.limit(0), none).count() == 0
        assert {r["score"] for r in module.score(docs, none).collect()} == {0.5}


@pytest.mark.parametrize("window,gram", [(100, 32)])
def test_suffix_dedup_as_the_query_has_it(spark, documents, window, gram):
    from plumbline.llm import suffix_dedup as S

    rows = [*documents, (90001, documents[0][1]), (90002, (documents[1][1] or "")[50:]), (90003, "é" * 300), (90004, "é" * 120 + "x" * 99)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, S.substring_dedup(table, window=window, gram=gram).collect())) == sorted(S.brute_force(rows, window))


def test_suffix_match_lengths():
    from plumbline.llm.suffix_dedup import Level, suffix_ranks

    rng = np.random.default_rng(1)
    for depth in (3, 8, 20, 100):
        text = rng.integers(97, 99, 700).astype(np.uint8)
        places = np.arange(0, 500)
        rank = suffix_ranks(text, depth)[places]
        keys = [text[p : p + depth].tobytes() for p in places]
        assert np.array_equal(np.unique(rank, return_inverse=True)[1], np.unique(keys, return_inverse=True)[1])
        order = np.argsort(rank, kind="stable")
        _, first = np.unique(rank[order], return_index=True)
        own = Level(text, places[order[first]], depth)
        other = rng.integers(97, 99, 300).astype(np.uint8)
        asked = sorted({other[k : k + depth].tobytes() for k in range(200)})
        matrix = np.frombuffer(b"".join(asked), np.uint8).reshape(-1, depth)
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), depth)
        for block in (7, 1 << 15):
            assert own.longest(matrix, block).tolist() == [max(common(a, b) for b in set(keys)) for a in asked]


def test_line_dedup_of_extreme_ids_and_repeats(spark):
    """Ids at both ends, a line that repeats within the first document that has it, and one that all documents share."""
    from plumbline.llm import line_dedup as L

    rnd = random.Random(11)
    common, ids = "a line that all of the documents share word for word here", [-(2**63), -5, -1, 0, 7, 2**40, 2**63 - 1]
    rows = []
    for d in ids:
        own = [" ".join(f"w{rnd.randrange(400)}" for _ in range(12)) for _ in range(4)]
        rows.append((d, "\n".join([own[0], common, own[1], "", common.upper(), own[0] + " tail", own[2], "tiny", own[3], "\t" + common.replace(" ", "  ") + "\x0b"])))
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in out.collect()) == sorted(L.brute_force(rows))
