"""Directories of source files and notes as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlode.functions import kinds

#: Directories that are never entered; so is any whose name begins with a dot.
PRUNED = ".git node_modules .venv venv .env vendor target build dist .idea .vscode __pycache__ .mypy_cache".split()


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, lang, sha256, size_bytes, modified, content) of the files below ``root`` in a known language.

    The listing is distributed where it is large; content is read by the tasks that use it. Pruned directories and
    unknown extensions are filtered on the path before content is touched. Paths are relative to the root.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rows = files.withColumn("path", F.substring(plain, len(base) + 2, 1_000_000))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    clean = ~F.exists(folders, lambda s: s.isin(PRUNED) | (s.startswith(".") & (s != ".")))
    known = rows.withColumn("lang", kinds.language(F.col("path"))).where(clean & F.col("lang").isNotNull())
    return known.select("path", "lang", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


def note_tree(spark: SparkSession, root: str) -> DataFrame:
    """(name, markdown) of the markdown files below ``root``, whatever the case of their extension."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(base)
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.select(F.substring(plain, len(base) + 2, 1_000_000).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("markdown"))
