"""Source code as text: numbered lines of definitions with their documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlode.operators.navigation import definitions_once

BIN = 64


def _numbered():
    return F.array_join(F.transform("l", lambda x: F.format_string("%6d| %s", x["line_no"], x["line"])), "\n")


def _with_lines(spans: DataFrame, source_lines: DataFrame) -> DataFrame:
    """Adds ``l``, the lines of each distinct (file_id, start_line, end_line) in order; spans without lines go."""
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))))
    numbered = source_lines.select("file_id", "line_no", "line", F.floor(F.col("line_no") / BIN).alias("bin"))
    met = binned.join(numbered, ["file_id", "bin"]).where(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    return met.groupBy("file_id", "start_line", "end_line").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))  # the lines of one span


def _cut(code, most: int | None):
    if most is None:
        return code
    return F.when(F.length(code) > most, F.concat(F.substring(code, 1, most), F.lit("\n... truncated"))).otherwise(code)


def window_code(windows: DataFrame, source_lines: DataFrame, most: int | None = None) -> DataFrame:
    """(file_id, first_line, code): the numbered lines of each window that its file still has, with a header. With
    ``most`` the code is cut there and marked, as a display would."""
    spans = windows.select("file_id", F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line")).distinct()
    code = F.concat(F.format_string("--- %d-%d ---\n", "start_line", "end_line"), _numbered())
    return _with_lines(spans, source_lines).select("file_id", F.col("start_line").alias("first_line"), _cut(code, most).alias("code"))


def definition_code(definitions: DataFrame, source_lines: DataFrame, docs: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(def_id, code): a header and the numbered lines of each definition that its file still has, whole; with ``most``
    cut at that many characters and marked.

    ``docs`` (file_id, line_no, doc_line) says where the documentation above a line begins; the lines shown, and those
    named in the header, then begin there. Distinct spans of a file meet its lines by bins, so definitions that share a
    span are rendered once. A group holds the lines of one span. Definitions without lines in their file give no row.
    """
    d = definitions_once(definitions).where(F.col("start_line").isNotNull()).withColumn("end_line", F.greatest("start_line", "end_line"))
    if docs is not None:
        above = docs.groupBy("file_id", F.col("line_no").alias("start_line")).agg(F.min("doc_line").cast("int").alias("doc_line"))
        d = d.join(above, ["file_id", "start_line"], "left").withColumn("start_line", F.coalesce("doc_line", "start_line"))
    out = d.join(_with_lines(d.select("file_id", "start_line", "end_line").distinct(), source_lines), ["file_id", "start_line", "end_line"])
    head = F.format_string("--- %s:%d-%d (%s %s) ---", "path", "start_line", "end_line", "name", "kind")
    return out.select("def_id", _cut(F.concat(head, F.lit("\n"), _numbered()), most).alias("code"))
