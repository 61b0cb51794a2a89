"""The training-data pipeline over `documents`: quality, line dedup, near duplicates, decontamination, packing.

Each stage gets the documents that its predecessor kept, read from Parquet, and returns those that it keeps with the
columns of documents (n_chars follows the text); the last returns the packed bins. Rows without doc_id pass the first four
stages where nothing tells against them, and are not packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, line_dedup, ngram_join, packing, quality_crf
from plumbline.llm.shared import fresh, keep

QUALITY = 0.3
#: No SQL expresses the fitted classifier; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below QUALITY go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_crf.fit(docs, labels, "quality", quality_crf.remainder(5) != 0)
    score = fresh(docs.columns, "score")[0]
    return quality_crf.score(docs, model, into=score).filter(F.col(score) >= QUALITY).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of a line go, near copies too; a document that loses all its words goes with them."""
    words = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    out = line_dedup.dedup_lines(docs).filter((F.col("n_removed") == 0) | words)
    return _like(docs, out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, Jaccard of 0.8), the document with the smallest id stays."""
    classes = ngram_join.similarity_classes(docs, n=5, num=4, den=5)
    other = fresh(docs.columns, "other")[0]
    later = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(later, F.col("doc_id").cast("bigint") == F.col(other), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words or more that stand in a benchmark item go; so do documents that are mostly such passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _like(docs, decontaminate.decontaminate(docs, items, window=10, max_span=9, max_coverage=0.5))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontaminate", benchmark), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
