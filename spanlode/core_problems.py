"""Queries of the core problems and, where there is one, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlode.operators.hot_keys import key_figures
from spanlode.operators.index_references import NOTES, chunk_id, index_orphans, orphan_report
from spanlode.sources.tables import read

HOT_SHARE = 0.02
LINES = {"first_line": 0.0, "median_line": 0.5, "p90_line": 0.9, "p99_line": 0.99}
TABLES = {"definitions": "def_id", "usages": "usage_id"}


def name_figures(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Per name of one table: distinct rows, files and languages and exact quantiles of the line they start on."""
    return key_figures(read(spark, root, table), "name", TABLES[table], "start_line", {"file_id": "n_files", "lang": "n_langs"}, LINES)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Names that hold at least 2 % of a table's distinct ids."""
    parts = []
    for table in TABLES:
        figures = name_figures(spark, root, table)
        total = figures.agg(F.sum("n_rows")).scalar()
        hot = figures.where(F.col("n_rows") >= F.lit(HOT_SHARE) * total)
        parts.append(hot.select(F.lit(table).alias("tbl"), "name"))
    return parts[0].unionByName(parts[1]).distinct()


def p1_name_figures(spark: SparkSession, root: str) -> DataFrame:
    """Every name of either table with the figures of both, and usages per definition."""
    sides = {}
    for table, prefix in (("definitions", "def"), ("usages", "use")):
        f = name_figures(spark, root, table)
        sides[prefix] = f.select(F.col("name").alias(f"{prefix}_name"), *[F.col(c).alias(f"{prefix}_{c.removeprefix('n_')}") for c in f.columns if c != "name"])
    both = sides["def"].join(sides["use"], F.col("def_name").eqNullSafe(F.col("use_name")), "full_outer")
    counts = [c for c in both.columns if c.endswith(("_rows", "_files", "_langs"))]
    lines = [c for c in both.columns if c.endswith("_line")]
    out = both.select(F.coalesce("def_name", "use_name").alias("name"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *lines)
    return out.withColumn("usages_per_definition", F.when(F.col("def_rows") > 0, F.round(F.col("use_rows") / F.col("def_rows"), 4)))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Notes and note symbols whose own target is missing; a definition is missing too where the cascade has made all
    definitions of the name orphans of removed files."""
    found = index_orphans(spark, root, whole=False).where(F.col("tbl").isin(*NOTES) & ((F.col("orphan") == "direct") | (F.col("reason") == "definition of symbol")))
    return found.select("tbl", "ref_id").distinct()


def p3_orphans(spark: SparkSession, root: str) -> DataFrame:
    """Every orphan with its reason, direct or inherited; ``ref`` is its id, of a chunk its uid and ordinal."""
    found = index_orphans(spark, root)
    chunks = read(spark, root, "memory_chunks").select("memory_uid", "chunk_ordinal").distinct()
    names = chunks.select(F.lit("memory_chunks").alias("tbl"), chunk_id().alias("ref_id"), F.concat_ws("#", "memory_uid", "chunk_ordinal").alias("key"))
    return found.join(names, ["tbl", "ref_id"], "left").select("tbl", F.coalesce("key", F.col("ref_id").cast("string")).alias("ref"), "reason", "orphan")


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphans per table and month against what the status columns claim."""
    return orphan_report(spark, root)


QUERIES = {"p1_found": p1_found, "p1_name_figures": p1_name_figures, "p3_found": p3_found, "p3_orphans": p3_orphans, "p3_report": p3_report}

_FIGURES = """
 SELECT name, count(*) AS {p}_rows, count(DISTINCT file_id) AS {p}_files, count(DISTINCT lang) AS {p}_langs,
   quantile_disc(start_line::BIGINT, 0.0) AS {p}_first_line, quantile_disc(start_line::BIGINT, 0.5) AS {p}_median_line,
   quantile_disc(start_line::BIGINT, 0.9) AS {p}_p90_line, quantile_disc(start_line::BIGINT, 0.99) AS {p}_p99_line
 FROM (SELECT {id}, name, max(file_id) AS file_id, max(lang) AS lang, max(start_line) AS start_line FROM {t} WHERE {id} IS NOT NULL GROUP BY ALL) GROUP BY name"""

_CLEAN = "list_reduce(list_prepend([], list_transform(list_filter(string_split({p}, '/'), lambda s: s NOT IN ('', '.')), lambda s: [s])), lambda a, s: CASE WHEN s[1] = '..' THEN a[:-2] ELSE a || s END)"

_ORPHANS = f"""
 live AS (SELECT DISTINCT file_id, project_id, path FROM source_files WHERE removed_at IS NULL),
 notes AS (SELECT memory_id, arg_max(project_id, updated_at) AS project_id, arg_max(scope, updated_at) AS scope, arg_max(file_path, updated_at) AS file_path,
   arg_max(memory_uid, updated_at) AS memory_uid FROM memories GROUP BY memory_id),
 syms AS (SELECT DISTINCT memory_symbol_id, memory_id, name, lower(trim(language)) AS language FROM memory_symbols),
 defs AS (SELECT DISTINCT d.project_id, d.name, lower(trim(d.lang)) AS language, d.file_id IN (SELECT file_id FROM live) AS stands FROM definitions d),
 lost AS (SELECT memory_id, memory_uid FROM notes n WHERE scope = 'file' AND file_path <> '' AND NOT EXISTS (
   SELECT 1 FROM live f WHERE f.project_id = n.project_id AND f.path = array_to_string({_CLEAN.format(p="n.file_path")}, '/'))),
 named AS (SELECT s.*, n.project_id, EXISTS (SELECT 1 FROM defs d WHERE d.project_id = n.project_id AND d.name = s.name AND d.language = s.language) AS known,
   EXISTS (SELECT 1 FROM defs d WHERE d.project_id = n.project_id AND d.name = s.name AND d.language = s.language AND stands) AS stands FROM syms s JOIN notes n USING (memory_id)),
 found AS (
   SELECT 'memories' AS tbl, memory_id AS ref_id, 'file of note' AS reason, 'direct' AS orphan FROM lost
   UNION SELECT 'memory_symbols', memory_symbol_id, 'note of symbol', 'direct' FROM syms ANTI JOIN notes USING (memory_id)
   UNION SELECT 'memory_symbols', memory_symbol_id, 'note of symbol', 'inherited' FROM syms SEMI JOIN lost USING (memory_id)
   UNION SELECT 'memory_symbols', memory_symbol_id, 'definition of symbol', CASE WHEN known THEN 'inherited' ELSE 'direct' END FROM named WHERE NOT stands
   UNION SELECT 'definitions', def_id, 'file of definition', 'direct' FROM definitions ANTI JOIN live USING (file_id)
   UNION SELECT 'usages', usage_id, 'file of usage', 'direct' FROM usages ANTI JOIN live USING (file_id)
   UNION SELECT 'source_files', file_id, 'run of file', 'direct' FROM source_files ANTI JOIN index_runs USING (run_id)
   UNION SELECT 'source_files', file_id, 'project of file', 'direct' FROM source_files ANTI JOIN projects USING (project_id)
   UNION SELECT 'index_runs', run_id, 'project of run', 'direct' FROM index_runs ANTI JOIN projects USING (project_id)
   UNION SELECT 'memories', memory_id, 'project of note', 'direct' FROM notes ANTI JOIN projects USING (project_id)),
 chunks AS (SELECT memory_uid, chunk_ordinal, max(indexed_at) AS at_time, arg_max(file_status, indexed_at) AS file_status FROM memory_chunks GROUP BY ALL),
 lost_chunks AS (SELECT memory_uid, chunk_ordinal, CASE WHEN memory_uid NOT IN (SELECT memory_uid FROM notes) THEN 'direct' WHEN memory_uid IN (SELECT memory_uid FROM lost) THEN 'inherited' END AS orphan FROM chunks)"""

_REPORT = f"""WITH {_ORPHANS}, worst AS (SELECT tbl, ref_id, max(CASE WHEN orphan = 'direct' THEN 1 ELSE 0 END) AS direct FROM found GROUP BY ALL),
 held AS (SELECT 'memories' AS tbl, memory_id AS ref_id, max(updated_at) AS t, arg_max(file_status, updated_at) = 'deleted' AS gone FROM memories GROUP BY 2
  UNION ALL SELECT 'memory_symbols', memory_symbol_id, max(last_resolved_at), coalesce(arg_max(coalesce(status, ''), coalesce(last_resolved_at, TIMESTAMPTZ '0001-01-01 00:00:00+00')), '') = 'deleted' FROM memory_symbols GROUP BY 2
  UNION ALL SELECT 'definitions', def_id, max(indexed_at), false FROM definitions GROUP BY 2 UNION ALL SELECT 'usages', usage_id, max(indexed_at), false FROM usages GROUP BY 2
  UNION ALL SELECT 'index_runs', run_id, max(finished_at), false FROM index_runs GROUP BY 2 UNION ALL SELECT 'source_files', file_id, max(indexed_at), bool_or(removed_at IS NOT NULL) FROM source_files GROUP BY 2),
 told AS (SELECT r.tbl, r.t, coalesce(gone, false) AS gone, direct FROM held r LEFT JOIN worst w ON w.tbl = r.tbl AND w.ref_id = r.ref_id
  UNION ALL SELECT 'memory_chunks', at_time, coalesce(file_status = 'deleted', false), CASE orphan WHEN 'direct' THEN 1 WHEN 'inherited' THEN 0 END FROM chunks JOIN lost_chunks USING (memory_uid, chunk_ordinal))
 SELECT tbl, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_rows, count(*) FILTER (direct = 1) AS direct_orphans, count(*) FILTER (direct = 0) AS inherited_orphans, count(*) FILTER (gone) AS claimed_deleted,
  count(*) FILTER (direct IS NOT NULL AND NOT gone) AS wrong_active, count(*) FILTER (direct IS NULL AND gone) AS wrong_deleted FROM told GROUP BY 1, 2"""

SQL = {
    "p1_found": """SELECT tbl, name FROM (
 SELECT 'definitions' AS tbl, name, count(DISTINCT def_id) AS n, (SELECT count(DISTINCT def_id) FROM definitions) AS t FROM definitions GROUP BY name
 UNION ALL SELECT 'usages', name, count(DISTINCT usage_id), (SELECT count(DISTINCT usage_id) FROM usages) FROM usages GROUP BY name) WHERE n >= 0.02 * t""",
    "p1_name_figures": f"""SELECT coalesce(d.name, u.name) AS name, coalesce(def_rows, 0) AS def_rows, coalesce(def_files, 0) AS def_files, coalesce(def_langs, 0) AS def_langs,
 coalesce(use_rows, 0) AS use_rows, coalesce(use_files, 0) AS use_files, coalesce(use_langs, 0) AS use_langs,
 def_first_line, def_median_line, def_p90_line, def_p99_line, use_first_line, use_median_line, use_p90_line, use_p99_line,
 CASE WHEN def_rows > 0 THEN round(coalesce(use_rows, 0)::DOUBLE / def_rows, 4) END AS usages_per_definition
 FROM ({_FIGURES.format(p="def", id="def_id", t="definitions")}) d FULL JOIN ({_FIGURES.format(p="use", id="usage_id", t="usages")}) u ON d.name IS NOT DISTINCT FROM u.name""",
    "p3_found": f"WITH {_ORPHANS} SELECT DISTINCT tbl, ref_id FROM found WHERE tbl IN ('memories', 'memory_symbols') AND (orphan = 'direct' OR reason = 'definition of symbol')",
    "p3_orphans": f"WITH {_ORPHANS} SELECT tbl, ref_id::VARCHAR AS ref, reason, orphan FROM found UNION SELECT 'memory_chunks', memory_uid || '#' || chunk_ordinal, 'note of chunk', orphan FROM lost_chunks WHERE orphan IS NOT NULL",
    "p3_report": _REPORT,
}
