"""Words and texts that hashes by powers modulo 2^64 take for equal, training on whole texts, and odd tables in the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import kernel as K

SF = "/root/testdata/sf0.001"


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


PAIR = thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))


def test_word_hashes_tell_words_apart():
    rnd = random.Random(1)
    words = {*PAIR, *("x" * k for k in range(1, 70)), *("".join(rnd.choice("abé\U0001f600") for _ in range(rnd.randrange(1, 40))) for _ in range(3000))}
    buf, off = K.flat(pa.array(["lead in ", *sorted(words), " and out"]))
    h = K.word_hash(buf, off[1:-2], off[2:-1])
    assert len(np.unique(h)) == len(words)
    # where a word stands does not matter
    again, at = K.flat(pa.array(sorted(words)[::-1]))
    assert (K.word_hash(again, at[:-1], at[1:]) == h[::-1]).all()
    assert len(K.word_hash(buf, off[:0], off[:0])) == 0


@pytest.fixture(scope="module")
def docs(spark):
    a, b = PAIR
    rows = [(1, f"{a} two three four five"), (2, f"{b} two three four five"), (3, a), (4, b), (5, f"{a} " * 30), (6, f"{b} " * 30), (7, a * 3), (8, b * 3)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


def test_op3_links_no_such_texts(docs):
    from plumbline.llm import ngram_join as J

    rows, df = docs
    assert sorted(map(tuple, J.similarity_classes(df, n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id").collect())) == sorted(J.brute_force(rows, 4, 85, 100))
    assert {r["component_id"] for r in J.similarity_classes(df, n=4, num=85, den=100).collect()} == set(range(1, 9))


def test_op5_finds_the_item_that_stands_there(spark, docs):
    from plumbline.llm import decontaminate as D

    rows, df = docs
    items = [("x", PAIR[0]), ("y", f"{PAIR[1]} two three four five")]
    out = D.digests(D.contamination(df, spark.createDataFrame(items, "item_id string, text string"))).collect()
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in out} == {1: (1, 1), 2: (5, 1), 3: (1, 1), 4: (0, 0), 5: (30, 1), 6: (0, 0), 7: (0, 0), 8: (0, 0)}
    assert {r["items_sha256"] for r in out if r["doc_id"] == 2} == {hashlib.sha256(b"y").hexdigest()}


def test_op6_and_op8_keep_the_other_text(docs):
    from plumbline.llm import phrase_dedup as P
    from plumbline.llm import suffix_dedup as S

    rows, df = docs
    got = {r["doc_id"]: r["n_removed"] for r in P.substring_dedup(df).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 29, 6: 29, 7: 0, 8: 0}  # only the repeats within 5 and within 6
    plain = {}
    seen = set()
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        plain[d] = int(gone.sum())
    assert {r["doc_id"]: r["n_removed"] for r in S.substring_dedup(df).collect()} == plain


def test_op7_writes_the_ids_of_each_text(docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from plumbline.llm import token_file as T

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    own = T.Encoder(path)
    texts = [t for _, t in docs[0]] + ["short words here", "a word of-more-than-sixteen-bytes", "a word of-more-than-sixteen-bytez"]
    # pieces whose hashes collide, whatever the reason, are told apart
    real, K.word_hash = K.word_hash, lambda buf, s, e: real(buf, s, e) % K.U(3) + K.U(1)
    try:
        ids, n = T.Encoder(path).encode(pa.array(texts))
    finally:
        K.word_hash = real
    for got, count in ((ids, n), own.encode(pa.array(texts)), own.encode(pa.array(texts))):
        want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert got.tolist() == sum(want, []) and count.tolist() == list(map(len, want))


def test_op9_trains_on_whole_texts(spark):
    """Texts of 2600 different words whose only telling word is hashed late: a fit on a part of the terms would miss it."""
    from pyspark.sql import functions as F

    from plumbline.llm import toxicity_fm as T

    words = [f"w{k}" for k in range(2600)]
    hashed = {w: int(K.mix(T.terms(pa.array([w]))[0][:1].astype(K.U))[0]) for w in (f"tell{k}" for k in range(400))}
    late = max(hashed, key=hashed.get)
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.sample(words, 2600)) + (f" {late}" if k % 2 else ""), k % 2) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = T.fit(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int"), "toxic", F.lit(True))
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    assert min(got[k] for k, _, y in rows if y) > 0.5 > max(got[k] for k, _, y in rows if not y)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and repeated ids, columns named like those the stages make, and an empty table; rejected documents go by their score."""
    from pyspark.sql import functions as F

    import corpus_pipeline as C
    from plumbline.llm import quality_crf as Q

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("doc_id < 60")
    odd = some.unionByName(some.filter("doc_id % 7 = 0")).unionByName(some.filter("doc_id % 9 = 0").withColumn("doc_id", F.lit(None).cast("bigint")))
    odd = odd.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in ("__id", "__score", "other", "score", "n_lines", "component_id")})
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = Q.fit(now, spark.read.parquet(f"{SF}/labels.parquet"), "quality", Q.remainder(5) != 0)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in Q.score(now, model, into="quality_score").filter("quality_score >= 0.3").collect())
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert now.columns == odd.columns
        rows = now.collect()
        assert rows and all(r[c] == (None if r["doc_id"] is None else f"{c} of {r['doc_id']}") for r in rows for c in ("__id", "__score", "other", "score", "component_id"))
        if not k:
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in rows) == want and len(want) < odd.count()
    assert C.STAGES[-1][1](spark, now, str(tmp_path)).count()
    (tmp_path / "none").mkdir()
    for t in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert C.run(spark, str(tmp_path / "none")).count() == 0
    assert zlib.crc32(b"") == 0
