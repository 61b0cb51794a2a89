"""Drawings as sources (S1-S6, S11, S27, K6-K8): uploads, annotations, and hooks for decoders and models.

A decoder or model is a plain function; it runs once a batch in mapInPandas, so this module needs none of them installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import points_to_sf, shoelace
from ..functions.naming import categorize, clean_material
from ..functions.parse import explicit_sf, height_of, loose_feet

UPLOAD_BYTES = 200 << 20
#: Named readers: bytes and a page to rows. A module adds its own.
READERS: dict[str, Callable] = {}


def uploads(spark: SparkSession, path: str, most: int = UPLOAD_BYTES) -> DataFrame:
    """Files of at most 200 MiB; the size filter reaches the source, so larger files are not read."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= most)


def primitives(files: DataFrame, reader: str | Callable, schema: str) -> DataFrame:
    """Rows of a decoder for each file. reader(path, content) yields dicts of the schema."""
    decode = READERS[reader] if isinstance(reader, str) else reader
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(decode(path, bytes(content)))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def marked_polygons(annotations: DataFrame, scale: Column) -> DataFrame:
    """Polygons of three vertices or more; a printed area is exact, else the outline at the page's scale."""
    p = annotations.filter((F.col("kind") == 6) & (F.size("vertices") >= 3))
    printed = explicit_sf(F.col("content"))
    return p.withColumn("area_sf", F.round(F.coalesce(printed, points_to_sf(shoelace(F.col("vertices")), scale)), 1)).withColumn("sf_exact", printed.isNotNull()).withColumn("material", clean_material(F.col("subject"))).withColumn("category", categorize(F.col("subject")))


def marked_lines(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polylines with a length: an area where one is printed or a height is given, else a linear row."""
    feet, high = loose_feet(F.col("content")), height_of(F.col("subject"))
    rows = annotations.filter((F.col("kind") == 7) & feet.isNotNull()).withColumn("lf", feet).withColumn("area_sf", F.coalesce(explicit_sf(F.col("content")), F.round(feet * high, 1))).withColumn("material", clean_material(F.col("subject")))
    return rows.filter("area_sf is not null"), rows.filter("area_sf is null").select("job_id", "page", "seq", "material", "lf")


def gold_polygons(annotations: DataFrame, scale: Column) -> DataFrame:
    """Marked polygons of 40 to 60000 square feet, each outline once, named ones first."""
    from ..operators.reconcile import outline_key
    from ..operators.windows import first_per_key

    g = marked_polygons(annotations, scale).filter(F.col("area_sf").between(40, 60000)).withColumn("__k", outline_key(F.col("vertices"))).withColumn("__u", (F.col("material") == "Unlabeled").cast("int"))
    return first_per_key(g, ["job_id", "page", "__k"], ["__u", "seq"]).drop("__k", "__u")


def model_rows(rows: DataFrame, load: Callable, infer: Callable, schema: str) -> DataFrame:
    """load() gives the model once a worker, or None where its file is absent; then there are no rows, and callers
    fall back. infer(model, pdf) gives a pandas table of the schema."""

    def run(batches: Iterator) -> Iterator:
        model = load()
        for pdf in batches:
            if model is not None and len(pdf):
                yield infer(model, pdf)

    return rows.mapInPandas(run, schema)


def page_budget(pages: DataFrame, doc: str, order: list[Column], most: int = 8) -> DataFrame:
    """The pages of a document that a costly model may read."""
    from ..operators.rollup import top_per_group

    return top_per_group(pages, [doc], order, most, "budget_rank")


def with_fallback(found: Column, fallback: Column) -> Column:
    """K8: a model that gave nothing leaves the measured value."""
    return F.coalesce(found, fallback)
