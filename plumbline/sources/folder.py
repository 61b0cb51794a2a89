"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it is unset, a local session (tests) gets a folder of its own;
    a cluster is refused, as its machines would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a lineage cut that survives a lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(*tables: DataFrame) -> None:
    """Deletes the files of kept tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            drop_path(file.rsplit("/", 1)[0])


def drop_path(path: str) -> None:
    """Deletes a folder, if it is there. Only space is at stake: a store that Arrow does not know keeps it."""
    try:
        fs, at = pafs.FileSystem.from_uri(path)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir(at)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return
