"""What corrections teach (A17-A19, R1, R2, R8): promoted pairs, recall, counts, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import family_of
from ..functions.rules import filled
from .windows import best_by_hits, latest_per_key


def promoted_pairs(ledger: DataFrame, group: str, name: str, job: str, least: int = 3) -> DataFrame:
    """(group, name) confirmed on three independent jobs; suggestions only."""
    own = ledger.filter(filled(F.col(group)).isNotNull() & filled(F.trim(name)).isNotNull() & F.col(job).isNotNull())
    return own.groupBy(group, F.trim(name).alias("name")).agg(F.countDistinct(job).alias("n_jobs")).filter(F.col("n_jobs") >= least).withColumn("family", family_of(F.col(group)))


def recall_latest(log: DataFrame, signature: str, order: list[str]) -> DataFrame:
    """The last label of each signature."""
    return latest_per_key(log, [signature], order)


def recall_most_used(library: DataFrame, firm: str, signature: str, label: str) -> DataFrame:
    """Of the firm's and the global labels, the one with most hits of each signature."""
    return best_by_hits(library.filter(F.col("firm").isin(firm, "global")), signature, label)


def since(log: DataFrame, ts: str, cursor: object) -> DataFrame:
    """S25, R2."""
    return log.filter(F.col(ts) > F.lit(cursor))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row a table."""
    out = None
    for name, t in tables.items():
        row = t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
