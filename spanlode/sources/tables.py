"""The tables of a code index and how they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "projects source_files index_runs definitions usages memories memory_symbols memory_chunks documents eval_items known_files "
    "region nation customer supplier part orders lineitem events embeddings"
).split()


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table, unchanged. Column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def once(df: DataFrame, *key: str) -> DataFrame:
    """Full copies of a row collapse; rows that share the key but differ keep the one that sorts last.

    Partial aggregation runs before the shuffle and the key is unique but for copies, so no group is large.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    return df.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*")


def files_in_index(spark: SparkSession, root: str) -> DataFrame:
    """(file_id, project_id, path) of files that are not removed, one row each."""
    rows = read(spark, root, "source_files").where(F.col("removed_at").isNull())
    return rows.select("file_id", "project_id", "path").distinct()
