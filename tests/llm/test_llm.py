"""The training-data operators against brute-force versions, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sample(spark):
    """Test documents, then edge cases: nulls, empty and long texts, ties, repeated rows, low entropy."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(120).collect()]
    base, rnd = 10_000, random.Random(3)
    words = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(400))
    edge = [None, "", " \n\t ", "one two", "one two", "one two three", "a" * 700, "a" * 900, "x y " * 300, words, words + " tail", "lead " + words, words[:900] + " changed " + words[900:], rows[3][1], rows[3][1] + " more words at the end", "ligne é  è  double", "\n\nline one of text is here now\nLine One of text is here now\n\n", "<|endoftext|> a <|endoftext|>b", "tab\there 　 wide", "long " * 6000]
    rows += [(base + k, t, None, None if k % 2 else "src0", 0) for k, t in enumerate(edge)]
    rows.append(rows[5])
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return sample(spark)


@pytest.fixture(scope="module")
def docs(spark, rows):
    # a row without id, and a column whose name clashes with one that an operator makes
    return spark.createDataFrame([*rows, (None, "no id", "en", "src1", 5)], DOCS).withColumn("n", F.lit(1)).withColumn("score", F.lit("x")).withColumn("runs", F.lit(2)).repartition(3).cache()


def texts(rows):
    return [(r[0], r[1]) for r in rows]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_line_dedup(docs, rows):
    from plumbline.llm import line_dedup as L

    out = L.dedup_lines(docs.filter("doc_id is not null"))
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    same([(r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in out.collect()], L.brute_force(texts(rows)))


def test_line_dedup_is_native(docs):
    from plumbline.llm import line_dedup as L

    plan = L.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_tokens_are_plain_numbers(spark, monkeypatch):
    """op1: arrays of tokens hold no nulls by their type, so they are sorted without boxes; ranks are the tokens' high bits, 255 among them."""
    from plumbline.llm import line_dedup as L

    seen = []
    monkeypatch.setattr(L, "_tokens", lambda each, tokens=L._tokens: seen.append(each.schema["t"].dataType.containsNull) or tokens(each))
    hashed = spark.createDataFrame([(1, list(range(12)))], "x long, h array<long>")
    for rank in (0, 64, 255):
        ranks = F.split(F.lit(",".join([str(rank << 55)] * L.CELLS)), ",").cast("array<bigint>")
        rows = L._prefix(hashed, ranks).collect()
        assert [r["m"] for r in sorted(rows, key=lambda r: r["token"])] == [(8 << 32) + p for p in range(2)]
        assert {(r["token"] >> 55) & 511 for r in rows} == {rank}
    assert seen == [False] * 3


def test_line_dedup_of_near_copies(spark):
    """A group of near copies of one line, where many match each other but not the first."""
    from plumbline.llm import line_dedup as L

    rnd = random.Random(5)
    line = [f"w{rnd.randrange(5000)}" for _ in range(60)]
    rows = []
    for d in range(120):
        own = list(line)
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(60)] = f"v{rnd.randrange(9)}"
        rows.append((d, " ".join(own) + "\nonly here %d" % d))
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    same([(r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in out.collect()], L.brute_force(rows))


def test_packing(docs, rows):
    from plumbline.llm import packing as P

    out = P.pack(docs, capacity=512, most_per_source=2, per_shard=64).collect()
    size = {}
    for d, t in texts(rows):
        size.setdefault(d, len([w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]) + 1)
    total, bins = {}, {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        bins.setdefault(r["bin_id"], []).append(r)
    repeated = rows[5][0]
    assert {d: n for d, n in total.items() if d != repeated} == {d: n for d, n in size.items() if d != repeated} and total[repeated] == 2 * size[repeated]
    of = {r[0]: (r[3], (r[1] or "").lower()) for r in rows}
    for own in bins.values():
        assert sum(r["n_tokens"] for r in own) == own[0]["bin_tokens"] <= 512
        sources = [of[r["doc_id"]][0] for r in own if of[r["doc_id"]][0] is not None]
        assert all(sources.count(s) <= 2 for s in sources)
        copies = [of[r["doc_id"]][1] for r in own if r["n_tokens"] < 512 and of[r["doc_id"]][1]]
        assert len(copies) == len(set(copies))


def test_best_fit_takes_the_tightest_compatible_bin():
    from plumbline.llm.packing import best_fit

    rnd = random.Random(1)
    sizes = sorted((rnd.randrange(1, 60) for _ in range(300)), reverse=True)
    sources, clusters = [rnd.choice([None, "a", "b", "c"]) for _ in sizes], [rnd.randrange(120) for _ in sizes]
    bins = []
    for n, s, c in zip(sizes, sources, clusters):  # every bin is looked at
        fit = [(100 - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + n <= 100 and all(x[2] != c for x in b) and (s is None or sum(x[1] == s for x in b) < 2)]
        if fit:
            bins[min(fit)[1]].append((n, s, c))
        else:
            bins.append([(n, s, c)])
    found = best_fit(sizes, sources, clusters, 100, 2)
    again = [[] for _ in range(max(found) + 1)]
    for b, x in zip(found, zip(sizes, sources, clusters)):
        again[b].append(x)
    assert again == bins


@pytest.mark.parametrize("short", [2, 32])
def test_ngram_join(docs, rows, short):
    """short = 2 sends nearly all through the blocks of long lists."""
    from plumbline.llm import ngram_join as J

    expected = {d: (d, n, c) for d, n, c in J.brute_force(texts(rows), 4, 85, 100)}
    out = J.similarity_classes(docs, n=4, num=85, den=100, short=short, block=4)
    assert {r["doc_id"]: tuple(r)[:3] for r in out.collect()} == expected
    assert out.count() == len(rows)


def test_ngram_join_of_a_chain(spark):
    """Copies of copies: neighbours link, the ends do not."""
    from plumbline.llm import ngram_join as J

    rnd = random.Random(9)
    own, rows = [f"w{k}" for k in range(80)], []
    for d in range(60):
        own = list(own)
        own[rnd.randrange(80)] = f"n{d}"
        rows.append((60 - d, " ".join(own)))
    expected = sorted(J.brute_force(rows, 5, 4, 5))
    for short, block in ((32, 1024), (4, 8)):
        assert got(J.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), short=short, block=block)) == sorted(expected, key=repr)


def test_quality(spark, docs):
    from plumbline.llm import quality_crf as Q

    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int"))
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    model = Q.fit(plain, labels, "quality", Q.remainder(5) != 0)
    out = Q.score(docs, model, into="quality_score").collect()
    assert len(out) == docs.count() and all(0 <= r["quality_score"] <= 1 for r in out)
    known = Q.score(plain, model).join(labels.filter("quality is not null and doc_id is not null"), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in known]) > 0.9
    assert {r["score"] for r in Q.score(plain, Q.fit(plain, labels.limit(0), "quality", F.lit(True))).collect()} == {0.5}


def test_marginals_by_brute_force():
    from itertools import product

    from plumbline.llm.quality_crf import marginals, pair_marginals

    rng = np.random.default_rng(0)
    e, tr, st = rng.normal(size=9), rng.normal(size=(2, 2)), rng.normal(size=2)
    off = np.array([0, 4, 5, 9])
    found = marginals(e, off, tr, st)
    for a, b in zip(off[:-1], off[1:]):
        weight = {y: np.exp(st[y[0]] + sum(e[a + k] * v for k, v in enumerate(y)) + sum(tr[p, q] for p, q in zip(y, y[1:]))) for y in product((0, 1), repeat=b - a)}
        total = sum(weight.values())
        for k in range(b - a):
            assert found[a + k] == pytest.approx(sum(w for y, w in weight.items() if y[k]) / total)
        if b - a > 1:
            both = sum(w for y, w in weight.items() if y[0] and y[1]) / total
            assert pair_marginals(found[a : a + 1], found[a + 1 : a + 2], tr)[0, 3] == pytest.approx(both)


def test_decontaminate(spark, docs, rows):
    from plumbline.llm import decontaminate as D

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, "one two"), (901, None), (902, "..."), (903, rows[4][1][:400]), (903, " ".join(rows[6][1].split()[3:20])), (904, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    table = spark.createDataFrame([*items, (None, "one two three")], "item_id bigint, text string")
    expected = D.brute_force(texts(rows), items)
    assert sum(x[5] for x in expected) > 3
    for most in (1_000_000, 300):  # the second deals the items to several automata
        found = D.contamination(docs.filter("doc_id is not null"), table, most_words=most)
        same(map(tuple, D.digests(found).collect()), expected)
    clean = D.decontaminate(docs, table, max_span=0, max_coverage=1.0)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    left = [(r["doc_id"], r["text"]) for r in clean.filter("doc_id is not null").collect()]
    long = [x for x in items if len(D.tokens(x[1] or "")) >= 10]
    assert not any(x[5] for x in D.brute_force(left, long) if x[1] and x[0] in {y[0] for y in expected if y[5] and y[2] == y[1]})
    assert D.contamination(docs.limit(0), table).count() == 0 and not any(r["n_hit"] for r in D.contamination(docs, table.limit(0)).collect())


@pytest.mark.parametrize("window", [20, 9])
def test_phrase_dedup(docs, rows, window):
    from plumbline.llm import phrase_dedup as P

    out = P.substring_dedup(docs, window=window, gram=min(8, window - 2), with_text=True)
    same([tuple(r)[:4] for r in out.collect()], P.brute_force(texts(rows), window))
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in out.collect())


@pytest.mark.parametrize("window", [100, 40])
def test_suffix_dedup(docs, rows, window):
    from plumbline.llm import suffix_dedup as S

    out = S.substring_dedup(docs, window=window, gram=24)
    same(map(tuple, out.collect()), S.brute_force(texts(rows), window))


def test_suffix_family_levels():
    """Batches of any size find exactly the suffixes that stand earlier, and levels stay few."""
    from plumbline.llm.suffix_dedup import SuffixFamily

    rnd = np.random.default_rng(4)
    text = rnd.integers(97, 100, 6000).astype(np.uint8)
    family, gone, seen, at = SuffixFamily(6), [], set(), 0
    while at < 5900:
        to = min(5900, at + int(rnd.integers(1, 400)))
        starts = np.arange(at, to)
        gone += family.add(text[: to + 6], starts, starts.astype(np.uint64)).tolist()
        at = to
    for k in range(5900):
        key = text[k : k + 6].tobytes()
        assert gone[k] == (key in seen)
        seen.add(key)
    assert len(family.levels) <= 13


def test_token_files(spark, docs, rows, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from plumbline.llm import token_file as T
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, expected, start = Tokenizer.from_file(path), [], 0
    for d, t in sorted(texts(rows), key=lambda x: (x[0], x[1] or "")):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    files = T.write_tokens(docs, path, str(tmp_path / "tokens"))
    same(map(tuple, T.read_tokens(files).collect()), expected)
    reader = T.Reader(files.first()["path"])  # random access
    k = int(np.flatnonzero(reader.docs == files.select(F.lit(rows[3][0])).first()[0])[0]) if rows[3][0] in reader.docs else 0
    assert len(reader.document(k)) == reader.lengths[k]
    assert T.read_tokens(T.write_tokens(docs.limit(0), path, str(tmp_path / "none"))).count() == 0


@pytest.mark.parametrize("width", [1, 3, 11, 16, 17, 31, 32])
def test_bit_packing_round_trip(width):
    from plumbline.llm.token_file import pack, unpack

    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << width, n).astype(np.uint32)
        data = pack(ids, width)
        assert len(data) == -(-n // 64) * width * 8 and (unpack(data, width, n) == ids).all()


def test_encoder_cuts_nothing_that_matters():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from plumbline.llm.token_file import Encoder
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(2)
    plain, own = Tokenizer.from_file(path), Encoder(path)
    pieces = ["a", "Zé", " ", "  ", "\n", "\t", " ", "　", " ", "'s", "12", "!", "ñ", "日本", "<|endoftext|>", "\x1f", "\x85", "🙂", "¿", "\r\n"]
    made = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(40))) for _ in range(400)]
    ids, lengths = own.encode(pa.array(made))
    assert ids.tolist() == [i for t in made for i in [*plain.encode(t, add_special_tokens=False).ids, 0]] and lengths.sum() == len(ids)


def test_toxicity(spark, docs):
    from plumbline.llm import toxicity_fm as T

    rnd = random.Random(6)
    filler = [f"word{k}" for k in range(60)]
    made, marks = [], []
    for d in range(600):  # toxic only where both kinds stand together
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        w = rnd.choices(filler, k=20) + ["scoundrels"] * insult + ["neighbours"] * group
        rnd.shuffle(w)
        made.append((d, " ".join(w)))
        marks.append((d, int(insult and group)))
    table, labels = spark.createDataFrame(made, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = T.fit(table, labels, "toxic", F.col("doc_id") % 2 == 0)
    out = T.score(table, model).join(labels, "doc_id").filter("doc_id % 2 = 1").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in out]) > 0.98
    assert all(0 <= r["tox"] <= 1 for r in T.score(docs, model, into="tox").collect())


def test_ann(spark):
    from plumbline.llm import ann as A

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    v[100:160] = v[100]  # many copies
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    bad = [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (None, [1.0] * 16), (9150, [1.0] * 3), rows[7]]
    table = spark.createDataFrame([*rows, *bad], "vec_id bigint, embedding array<double>").withColumn("score", F.lit(0))
    index = A.Index.fit(A.usable(table, "vec_id", "embedding"), most=2000, per_part=200)
    assert index.parts > 4 and index.probes < index.parts
    found = A.nearest(table, table.filter("vec_id % 50 = 0"), index=index, block=100).collect()
    expected = A.brute_force(list(range(3000)), v, list(range(0, 3000, 50)))
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
        x, y = v[r["query_id"]], v[r["vec_id"]]
        assert r["score"] == pytest.approx((x @ y) / np.sqrt((x @ x) * (y @ y)), abs=1e-12)
    assert sum(len(set(by[q]) & set(e)) for q, e in expected.items()) >= 0.9 * 5 * len(expected) and by[100] == [101, 102, 103, 104, 105]
    few = table.filter("vec_id < 3")
    assert [(r["rank"], r["vec_id"]) for r in A.nearest(few, few.filter("vec_id = 0")).orderBy("rank").collect()][0][0] == 1 and A.nearest(few, few.filter("vec_id = 0")).count() == 2
    assert A.nearest(table.limit(0), table.limit(0)).count() == 0


def test_empty_tables(spark, docs):
    from plumbline.llm import line_dedup, ngram_join, packing, phrase_dedup, suffix_dedup

    none = docs.limit(0)
    for out in (line_dedup.dedup_lines(none), ngram_join.similarity_classes(none), packing.pack(none), phrase_dedup.substring_dedup(none), suffix_dedup.substring_dedup(none)):
        assert out.count() == 0


def test_pipeline(spark, docs, rows, tmp_path):
    """Every stage against a plain version on its own input."""
    import corpus_pipeline as C
    from plumbline.llm import decontaminate as D
    from plumbline.llm import line_dedup as L
    from plumbline.llm import ngram_join as J

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    names = DOCS.replace(" bigint", "").replace(" string", "").split(", ")
    docs.select(*names).filter("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, f) in enumerate(C.STAGES):
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        f(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        after = [(r["doc_id"], r["text"]) for r in now.collect()] if k < 4 else now.collect()
        assert k == 4 or now.columns == names
        seen.append((before, after))
    assert set(seen[0][1]) <= set(seen[0][0])
    plain = [(d, t) for d, _, gone, t in L.brute_force(seen[1][0]) if not gone or (t or "").split()]
    same(plain, seen[1][1])
    first = {d for d, _, c in J.brute_force(seen[2][0], 5, 4, 5) if d == c}
    same([x for x in seen[2][0] if x[0] in first], seen[2][1])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d: (n, h) for d, n, h, *_ in D.brute_force(seen[3][0], items)}
    assert {d for d, _ in seen[3][1]} == {d for d, (n, h) in hit.items() if h <= 0.5 * n}
    assert all(t == dict(seen[3][0])[d] for d, t in seen[3][1] if not hit[d][1])
    assert {r["doc_id"] for r in seen[4][1]} == {d for d, _ in seen[4][0]}
    same(map(tuple, C.run(spark, str(tmp_path)).collect()), map(tuple, seen[4][1]))


def test_lists_of_documents_of_other_sizes_name_nobody(spark, monkeypatch):
    """A passage that documents of all sizes share by chance makes no group of them; near copies among them are still found."""
    from plumbline.llm import ngram_join

    seen = {}

    def counted(df, name="table", old=ngram_join.keep):
        out = old(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "keep", counted)
    rng = random.Random(3)
    passages = [" ".join(f"p{c}w{i}" for i in range(80)) for c in range(16)]
    rows = [(k, " ".join(rng.sample(passages, (1, 2, 3, 5, 8, 13)[k % 6]))) for k in range(60)]
    rows += [(60, rows[11][1] + " more"), (61, rows[4][1] + " end"), (62, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = sorted(map(tuple, ngram_join.similarity_classes(docs, n=4, num=85, den=100, short=8).collect()))
    assert got == sorted(ngram_join.brute_force(rows, 4, 85, 100))
    of = {d: c for d, _, c in got}
    assert (of[60], of[61], of[62]) == (of[11], of[4], of[5])
    assert seen["members"] < 1000  # those of lists that mostly hold documents of like size; 2270 when all long lists were groups


def test_equal_sets_of_several_tasks_are_compared_once(spark, monkeypatch):
    """Copies that lie in different tasks stand for one set: they name no pairs, and their texts do not move. Near copies among them are found."""
    from plumbline.llm import ngram_join

    seen = {}

    def counted(df, name="table", old=ngram_join.keep):
        out = old(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "keep", counted)
    rng = random.Random(4)
    texts = [" ".join(f"d{k}w{rng.randrange(10**6)}" for _ in range(60)) for k in range(5)]
    rows = [(100 * c + k, t.upper() if c % 2 else t) for c in range(12) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12, "doc_id")
    for short in (32, 4):
        got = sorted(map(tuple, ngram_join.similarity_classes(docs, n=4, num=85, den=100, short=short).collect()))
        assert got == sorted(ngram_join.brute_force(rows, 4, 85, 100))
        assert seen["units"] == 0
    rows += [(100 * c + 7, texts[0] + " more") for c in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12, "doc_id")
    got = sorted(map(tuple, ngram_join.similarity_classes(docs, n=4, num=85, den=100).collect()))
    assert got == sorted(ngram_join.brute_force(rows, 4, 85, 100))
    assert {c for d, _, c in got if d % 100 in (0, 7)} == {0} and seen["units"] == 2
