"""The foreign keys of the index and note tables, for ``orphans``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlode.functions.paths import resolved
from spanlode.operators.orphans import Reference, orphans
from spanlode.sources.tables import files_in_index, read


def latest_notes(spark: SparkSession, root: str) -> DataFrame:
    """One row per memory_id, the latest revision by ``updated_at``; ties go to the greatest other values."""
    rows = read(spark, root, "memories").where(F.col("memory_id").isNotNull())
    cols = ["project_id", "memory_uid", "scope", "file_path", "status", "file_status", "updated_at"]
    rest = [c for c in cols if c != "updated_at"]
    return rows.groupBy("memory_id").agg(F.max(F.struct("updated_at", *rest)).alias("_r")).select("memory_id", "_r.*")


def latest_symbols(spark: SparkSession, root: str) -> DataFrame:
    """One row per memory_symbol_id, the one resolved last."""
    rows = read(spark, root, "memory_symbols").where(F.col("memory_symbol_id").isNotNull())
    return rows.groupBy("memory_symbol_id").agg(F.max(F.struct("last_resolved_at", "memory_id", "language", "name", "status")).alias("_r")).select("memory_symbol_id", "_r.*")


def _language(c: str):
    return F.lower(F.trim(F.col(c)))


NOTES = ("memories", "memory_symbols")


def references(spark: SparkSession, root: str, whole: bool = True) -> list[Reference]:
    """The foreign keys of the notes: file-scoped notes to files, note symbols to notes and to definitions, definitions
    to files. With ``whole`` also those of the rest: usages and note chunks, and files, runs and notes up to projects.

    A removed file is no target, so its definitions and usages are orphans, and a symbol all of whose definitions are
    orphans is one in turn."""
    files = files_in_index(spark, root)
    notes = latest_notes(spark, root)
    symbols = latest_symbols(spark, root)
    bound = notes.where((F.col("scope") == "file") & (F.col("file_path") != "")).select(F.col("memory_id").alias("ref_id"), "project_id", resolved(F.col("file_path")).alias("file"))
    paths = files.select("project_id", resolved(F.col("path")).alias("file"), F.col("file_id").alias("ref_id"))
    noted = symbols.select(F.col("memory_symbol_id").alias("ref_id"), "memory_id", "name", _language("language").alias("language"))
    of_note = notes.select("memory_id", F.col("memory_id").alias("ref_id"))
    placed = noted.join(notes.select("memory_id", "project_id"), "memory_id")  # memory_id is unique in notes
    defined = read(spark, root, "definitions").where(F.col("def_id").isNotNull()).select(F.col("def_id").alias("ref_id"), "project_id", "file_id", "name", _language("lang").alias("language")).distinct()
    known = defined.where(F.col("name").isNotNull() & F.col("language").isNotNull())
    of_file = files.select("file_id", F.col("file_id").alias("ref_id")).distinct()
    out = [
        Reference("memories", bound, paths, {"project_id": "project_id", "file": "file"}, parent="source_files", name="file of note"),
        Reference("memory_symbols", noted, of_note, {"memory_id": "memory_id"}, parent="memories", name="note of symbol"),
        Reference("definitions", defined, of_file, {"file_id": "file_id"}, parent="source_files", name="file of definition"),
        Reference("memory_symbols", placed, known, {"project_id": "project_id", "name": "name", "language": "language"}, parent="definitions", name="definition of symbol"),
    ]
    if not whole:
        return out
    chunks = read(spark, root, "memory_chunks").select("memory_uid", "chunk_ordinal").where(F.col("memory_uid").isNotNull()).distinct()
    chunk_rows = chunks.select(chunk_id().alias("ref_id"), "memory_uid")
    by_uid = notes.where(F.col("memory_uid").isNotNull()).select("memory_uid", F.col("memory_id").alias("ref_id"))
    used = read(spark, root, "usages").where(F.col("usage_id").isNotNull()).select(F.col("usage_id").alias("ref_id"), "file_id").distinct()
    held = read(spark, root, "source_files").where(F.col("file_id").isNotNull()).select(F.col("file_id").alias("ref_id"), "project_id", "run_id").distinct()
    runs = read(spark, root, "index_runs").where(F.col("run_id").isNotNull()).select("run_id", "project_id", F.col("run_id").alias("ref_id")).distinct()
    projects = read(spark, root, "projects").select("project_id").distinct()
    return out + [
        Reference("memory_chunks", chunk_rows, by_uid, {"memory_uid": "memory_uid"}, parent="memories", name="note of chunk"),
        Reference("usages", used, of_file, {"file_id": "file_id"}, parent="source_files", name="file of usage"),
        Reference("source_files", held, runs, {"run_id": "run_id"}, parent="index_runs", name="run of file"),
        Reference("source_files", held, projects, {"project_id": "project_id"}, name="project of file"),
        Reference("index_runs", runs, projects, {"project_id": "project_id"}, name="project of run"),
        Reference("memories", notes.select(F.col("memory_id").alias("ref_id"), "project_id"), projects, {"project_id": "project_id"}, name="project of note"),
    ]


def chunk_id():
    """One number for a chunk's key."""
    return F.xxhash64("memory_uid", "chunk_ordinal")


def index_orphans(spark: SparkSession, root: str, whole: bool = True) -> DataFrame:
    """``orphans`` over the index: (tbl, ref_id, reason, orphan). Only notes of scope ``file`` with a path refer to a file."""
    return orphans(references(spark, root, whole))


def orphan_report(spark: SparkSession, root: str) -> DataFrame:
    """Per table and month (null where the time is null): rows, orphans direct and inherited only, and what the status
    claims, for every table that refers to another one.

    ``claimed_deleted`` counts rows whose file_status or status says deleted, files with ``removed_at``, ``wrong_active``
    orphans that don't say so, ``wrong_deleted`` rows that say so although no reference of theirs is missing. Rows of
    definitions, usages and runs claim nothing. The month is that of updated_at, last_resolved_at, indexed_at or finished_at.
    """
    kinds = index_orphans(spark, root).groupBy("tbl", "ref_id").agg(F.max(F.when(F.col("orphan") == "direct", 1).otherwise(0)).alias("direct"))
    month = lambda c: F.date_format(F.col(c), "yyyy-MM").alias("month")
    latest = lambda table, key, at, gone: read(spark, root, table).where(F.col(key).isNotNull()).groupBy(F.lit(table).alias("tbl"), F.col(key).alias("ref_id")).agg(F.max(at).alias("at"), F.max(gone).alias("gone")).select("tbl", "ref_id", month("at"), "gone")
    never = F.lit(False)
    chunks = read(spark, root, "memory_chunks").where(F.col("memory_uid").isNotNull()).groupBy("memory_uid", "chunk_ordinal").agg(F.max(F.struct("indexed_at", "file_status")).alias("r"))
    parts = [
        latest_notes(spark, root).select(F.lit("memories").alias("tbl"), F.col("memory_id").alias("ref_id"), month("updated_at"), (F.col("file_status") == "deleted").alias("gone")),
        latest_symbols(spark, root).select(F.lit("memory_symbols").alias("tbl"), F.col("memory_symbol_id").alias("ref_id"), month("last_resolved_at"), (F.col("status") == "deleted").alias("gone")),
        chunks.select(F.lit("memory_chunks").alias("tbl"), chunk_id().alias("ref_id"), month("r.indexed_at"), (F.col("r.file_status") == "deleted").alias("gone")),
        latest("definitions", "def_id", "indexed_at", never), latest("usages", "usage_id", "indexed_at", never), latest("index_runs", "run_id", "finished_at", never),
        latest("source_files", "file_id", "indexed_at", F.col("removed_at").isNotNull()),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.join(kinds, ["tbl", "ref_id"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    return rows.groupBy("tbl", "month").agg(
        F.count("*").alias("n_rows"),
        count(F.col("direct") == 1, "direct_orphans"),
        count(F.col("direct") == 0, "inherited_orphans"),
        count(F.col("gone"), "claimed_deleted"),
        count(F.col("direct").isNotNull() & ~F.col("gone"), "wrong_active"),
        count(F.col("direct").isNull() & F.col("gone"), "wrong_deleted"),
    )
