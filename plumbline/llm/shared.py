"""Session helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, which spark.checkpoint.dir names. Where it is unset, a local
    session (tests) gets a folder of its own; a cluster is refused, as its machines would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a table to the shared folder and reads it back: a lineage cut that survives a lost executor.
    The shuffle files that only this write needs go when it is done."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}-{name}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From here on whole texts reach Python workers in batches of about 4 MB, however many rows that is, unless the session has a
    limit of its own: an executor holds a batch twice or more for each of its tasks."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(4 << 20))


def drop(*kept: DataFrame) -> None:
    """Deletes tables of keep() that nothing reads any more. Only space is at stake: a store that Arrow does not know keeps them."""
    for df in kept:
        for file in df.inputFiles()[:1]:
            try:
                fs, path = pafs.FileSystem.from_uri(file.rsplit("/", 1)[0])
                fs.delete_dir(path)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
                return


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, changed until none is among the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id bigint, text string, ...) of the rows that have an id: a row without one names no document."""
    small_batches(docs.sparkSession)
    cols = [F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    return docs.filter(F.col(f"`{id_col}`").isNotNull()).select(*cols, *[F.col(f"`{c}`") for c in more])


def salted_join(rows: DataFrame, small: DataFrame, key: str | list[str], salt_on: str, salts: int = 32) -> DataFrame:
    """rows joined with a table of one row a key; a key's rows are dealt to several tasks by the column salt_on."""
    keys = [key] if isinstance(key, str) else key
    salt = fresh([*rows.columns, *small.columns], "salt")[0]
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int")).join(copies, [*keys, salt]).drop(salt)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow for columns of any name: names with dots travel as plain ones and come back."""
    small_batches(df.sparkSession)
    if all(c.isidentifier() for c in df.columns):
        return df.mapInArrow(function, schema)
    own, out = df.columns, schema.fieldNames()
    plain = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(b.rename_columns(own) for b in batches):
            yield batch.rename_columns(plain.fieldNames())

    return df.toDF(*[f"c{k}" for k in range(len(own))]).mapInArrow(run, plain).toDF(*out)
