"""Tables of the domain: schemas, readers and writers (D1-D16, S12-S19, S25, S26, W1 upsert)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
SCHEMAS = {
    "jobs": "job_id string, proj_name string, status string, phase string, page_count int, created_ms bigint",
    "sheet_pages": "job_id string, page int, width double, height double, text string, content_md5 string, scale_ft_in double, scale_confirmed boolean, source string, sheet_ref string",
    "words": "job_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string",
    "blocks": "job_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string",
    "segments": "job_id string, page int, seq int, x1 double, y1 double, x2 double, y2 double, width double, gray double",
    "rects": "job_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double",
    "annotations": f"job_id string, page int, seq int, kind int, vertices array<{POINT}>, content string, subject string, fill array<double>, stroke array<double>",
    "ocr_rows": "job_id string, page int, crop int, seq int, text string, conf double, x double, y double",
    "pieces": f"job_id string, page int, piece_id int, points array<{POINT}>, holes array<array<{POINT}>>, area_sf double, material string, category string, fill_color array<double>, reader_class string, material_group string, material_class string, source string, suggest_only boolean, out_of_scope boolean, sf_exact boolean, openings_sf double, n_openings int",
    "linear_items": "job_id string, page int, seq int, material string, lf double",
    "corrections": f"ts_ms bigint, job_id string, source string, page int, hatches array<struct<signature:string,category:string,materialName:string,materialId:string>>, shapes array<struct<points:array<{POINT}>,area_sf:double>>, takeoff_total double",
    "overrides_net": "ts_ms bigint, job_id string, page int, zone_key string, net double, reset boolean, by string",
    "overrides_scope": "ts_ms bigint, job_id string, kind string, key string, in_scope boolean, reset boolean",
    "overrides_name": "ts_ms bigint, job_id string, group string, name string, reset boolean",
    "material_ledger": "ts bigint, jobId string, projName string, group string, readAs string, readerClass string, materialClass string, name string",
    "gold_walls": f"job_id string, page int, seq int, points array<{POINT}>, sf double, mat string",
    "runs": "id bigint, project_name string, firm string, pages int, elevations int, total_sf decimal(18,2), scale_source string, created_at timestamp",
    "hatch_library": "firm string, signature string, category string, material_name string, material_id string, hits int, updated_at timestamp",
}


def read(spark: SparkSession, path: str, name: str, form: str = "parquet") -> DataFrame:
    """A table with its fixed schema; rows that do not parse are nulls, files that are absent are empty."""
    reader = spark.read.schema(SCHEMAS[name]).option("mode", "PERMISSIVE").option("ignoreMissingFiles", True)
    try:
        return reader.format(form).load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def replace_jobs(rows: DataFrame, path: str) -> None:
    """The jobs of these rows take the place of what was there; other jobs stay."""
    rows.write.partitionBy("job_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """S14."""
    rows.write.mode("append").json(path)


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document each, with the file it came from."""
    return spark.read.schema(SCHEMAS["corrections"]).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.input_file_name())


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, hits: str = "hits") -> DataFrame:
    """New rows replace old ones of the same key and count one hit more."""
    both = old.withColumn("__h", F.col(hits)).unionByName(new.withColumn("__h", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in old.columns if c not in (*keys, hits)]
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"), F.sum("__h").cast("int").alias(hits))
    return g.select(*keys, "__r.*", hits).select(*old.columns)


def decoded(payload: str) -> object:
    """Bytes of a base64 payload, with or without a data prefix."""
    return F.unbase64(F.regexp_replace(payload, r"^data:[^,]*,", ""))


def pinned(jobs: DataFrame, manifest: DataFrame, width: int = 44) -> DataFrame:
    """Jobs of a manifest, by the first 44 characters; a prefix that comes twice counts once."""
    m = manifest.groupBy(F.left("job_prefix", F.lit(width)).alias("__k")).agg(F.min_by(F.struct("file", "pages"), "file").alias("__m"))
    return jobs.join(m, F.left("job_id", F.lit(width)) == F.col("__k")).select(*jobs.columns, "__m.file", "__m.pages")


def best_files(files: DataFrame, job: str, name: str, size: str, words: list[str], most: int = 8) -> DataFrame:
    """Eight candidates a job, by words in the name, then size."""
    from ..operators.rollup import top_per_group

    score = sum((F.when(F.contains(F.lower(name), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return top_per_group(files.withColumn("score", score), [job], [F.desc("score"), F.desc(size), F.col(name)], most)
