"""Source files that do not parse in the language of their extension."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlode.llm import lexers
from spanlode.sources.tables import once

#: Extension, language.
EXTENSIONS = {
    "go": "go", "java": "java", "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
}


def language_of(path: Column) -> Column:
    """The language of a path's extension, null if there is none or it isn't known."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def parsed(files: DataFrame) -> DataFrame:
    """(file_id, language, dialects): which dialects of its language accept each file; none means it does not parse.

    ``files`` has file_id, path and content. Every row is parsed where it is read, nothing is exchanged, so copies and
    hot projects make no difference; files of unknown extension give no row, a null content counts as empty and an
    empty file is valid. A redelivered row gives the same row again.
    """
    elements = F.lower("path").rlike(r"\.[jt]sx$")
    rows = files.select("file_id", language_of(F.col("path")).alias("language"), "content", elements.alias("elements")).where(F.col("language").isNotNull())
    schema = "file_id long, language string, dialects array<string>"
    out = pa.schema([("file_id", pa.int64()), ("language", pa.string()), ("dialects", pa.list_(pa.string()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, contents = batch.column(1).to_pylist(), batch.column(2)
            found = [lexers.dialects(name, c.as_py() or b"", e) for name, c, e in zip(languages, contents, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(found, pa.list_(pa.string()))], schema=out)

    return rows.mapInArrow(work, schema)


def rates(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Per project and language the files, those that don't parse and their share, next to what the project's index
    runs report: the sum of ``errors`` over its runs, each once, and how many runs report none."""
    state = parsed(files).select("file_id", "language", (F.size("dialects") == 0).alias("broken")).distinct()
    where = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max("project_id").alias("project_id"))
    per = state.join(where, "file_id").groupBy("project_id", "language").agg(F.count("*").alias("n_files"), F.sum(F.col("broken").cast("int")).alias("n_broken"))
    told = once(runs.select("run_id", "project_id", "errors"), "run_id").groupBy("project_id")
    told = told.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("reported_errors"), F.sum(F.col("errors").isNull().cast("int")).alias("silent_runs"))
    out = per.join(told, "project_id", "left")
    return out.select("project_id", "language", "n_files", "n_broken", F.round(F.col("n_broken") / F.col("n_files"), 4).alias("share_broken"), "reported_errors", "silent_runs")
