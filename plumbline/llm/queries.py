"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, decontaminate, line_dedup, ngram_join, packing, phrase_dedup, quality_crf, sharding, suffix_dedup, token_file, toxicity_fm, whitening
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality_crf.remainder(5) == 0
    model = quality_crf.fit(docs, labels, "quality", ~held_out)
    return quality_crf.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digests(decontaminate.contamination(docs.select("doc_id", "text"), benchmark))


def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_file.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read_tokens(files)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality_crf.remainder(3) == 1
    model = toxicity_fm.fit(docs, labels, "toxic", ~held_out)
    return toxicity_fm.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.collocations(docs, max_n=3, least=10, share=50, top=2000).drop("words", "cut")


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.measured(table(spark, sf_dir, "documents"))
    placed = sharding.shard(docs, [F.col(c) for c in docs.columns], shards=8, seed=13)
    return placed.select(*docs.columns, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_ALL = (
    op1_line_dedup, op2_best_fit, op3_ngram_join, op4_quality_crf, op5_decontaminate, op6_phrase_dedup, op7_token_files, op8_suffix_dedup,
    op9_toxicity, op10_ann, op11_whitening, op12_collocations, op13_shards,
)
QUERIES = {f.__name__: f for f in _ALL}
