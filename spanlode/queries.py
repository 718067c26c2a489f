"""Queries of the index operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlode.functions import kinds
from spanlode.functions.paths import ancestors, node_name, resolved, shortened, symbol_of_node
from spanlode.operators import captures, corpus, graph, grouping, navigation, note_files, notes, patterns, render, resolution
from spanlode.operators.index_references import latest_notes, latest_symbols
from spanlode.sources.tables import files_in_index, once, read
from spanlode.streaming import upkeep

GLOBS = {"tests": "*_test.go", "scripts": "scripts/*", "internal_one_deep": "internal/*/*", "typescript": "*.[mt]s*", "one_letter": "?ib/*.rs"}
SEARCHED = "stale cache lookup of the narrow parser"
PATTERN = r"\b[a-z]+_(ticket|report|cache)\b"
GETTERS = '(function) @name (#match? @name "^get") (#not-eq? @lang "java")'
CALLS = '(ref_call) @name (#any-of? @name "get" "append" "run")'
CHANGED = "2026-02-01 00:00:00"
BEFORE, AFTER = "2025-09-01 00:00:00", "2026-03-01 00:00:00"


def _pair(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, root, "usages"), read(spark, root, "definitions")


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    rows = read(spark, root, "memory_chunks")
    cols = ["indexed_at", "status", "file_status", "title", "chunk_heading", "chunk_text", "symbol_text"]
    return rows.groupBy("memory_uid", "chunk_ordinal").agg(F.max(F.struct(*cols)).alias("r")).select("memory_uid", "chunk_ordinal", "r.*")


def primary_definitions(spark, root):
    """The definition a name leads to, per project and language."""
    return navigation.primary_definitions(read(spark, root, "definitions")).select("project_id", "name", "lang", "def_id", "kind", "path", "candidates")


def ranked_definitions(spark, root):
    """Definitions with confidence, noise removed."""
    return navigation.ranked_definitions(read(spark, root, "definitions")).select("def_id", "confidence")


def ranked_definitions_with_noise(spark, root):
    """Definitions with confidence, all of them."""
    return navigation.ranked_definitions(read(spark, root, "definitions"), include_noise=True).select("def_id", "confidence")


def noisy_paths(spark, root):
    """What the path of each file costs a definition."""
    files = read(spark, root, "source_files").select("path").distinct()
    return files.select("path", kinds.is_noisy(F.col("path")).alias("noisy"), kinds.noise(F.col("path")).alias("cost"))


def identifiers_at_cursors(spark, root):
    """The identifier under a cursor one column into every usage."""
    u, d = _pair(spark, root)
    cursors = navigation.usages_once(u).select(F.col("usage_id").alias("cursor_id"), F.col("file_id").alias("at_file"), F.col("start_line").alias("at_line"), (F.col("start_col") + 1).alias("at_col"))
    return navigation.at_cursor(cursors, d, u)


def words_at_columns(spark, root):
    """The word of the source line at every definition's place, where the line is long enough."""
    lines = corpus.lines(read(spark, root, "source_files")).select("file_id", "line_no", "line")
    d = navigation.definitions_once(read(spark, root, "definitions")).select("def_id", "file_id", F.col("start_line").alias("line_no"), "start_col")
    met = d.join(lines, ["file_id", "line_no"]).where(F.length("line") > F.col("start_col"))
    return met.select("def_id", navigation.word_at(F.col("line"), F.col("start_col")).alias("word"))


def deduplicated_captures(spark, root):
    """One usage per file, name and place."""
    return navigation.deduplicated_captures(read(spark, root, "usages"))


def usages_not_definitions(spark, root):
    """Usages that stand where their name is not defined."""
    u, d = _pair(spark, root)
    return navigation.not_definitions(u, d).select("usage_id")


def resolution_scores(spark, root):
    """Candidates, confidence and best definition of every usage."""
    u, d = _pair(spark, root)
    return resolution.resolved_usages(u, d).select("usage_id", "candidates", "confidence", "best_def_id")


def resolution_scores_by_line(spark, root):
    """The same with what the source line of each usage says."""
    u, d = _pair(spark, root)
    lines = corpus.lines(read(spark, root, "source_files"))
    return resolution.resolved_usages(u, d, lines).select("usage_id", "candidates", "confidence", "best_def_id")


def coupling_scores_by_line(spark, root):
    """Coupling strength of every usage, raised by what its source line does."""
    lines = corpus.lines(read(spark, root, "source_files")).select("file_id", F.col("line_no").alias("start_line"), "line")
    rows = graph.coupled(read(spark, root, "usages")).join(lines, ["file_id", "start_line"], "left")
    return rows.select("usage_id", F.col("line").isNotNull().alias("has_line"), kinds.escalated(F.col("score"), F.col("name"), F.col("line")).alias("score"))


def definition_code(spark, root):
    """The numbered source lines of every definition with the documentation above it."""
    lines, d = corpus.lines(read(spark, root, "source_files")), read(spark, root, "definitions")
    docs = corpus.doc_starts(lines, d.select("file_id", F.col("start_line").alias("line_no")).distinct())
    return render.definition_code(d, lines, docs)


def usage_code(spark, root):
    """The source lines around the usages of every file, merged where they touch."""
    windows = grouping.code_windows(navigation.usages_once(read(spark, root, "usages")), ["file_id"], 2)
    return render.window_code(windows, corpus.lines(read(spark, root, "source_files")))


def pattern_matches(spark, root):
    """Definitions and usages that structural patterns find."""
    u, d = _pair(spark, root)
    return patterns.search(d, u, GETTERS).unionByName(patterns.search(d, u, CALLS))


def capped_matches(spark, root):
    """The first calls by place, at most 100 of a file and 500 in all."""
    u, d = _pair(spark, root)
    return patterns.search(d, u, CALLS, per_file=100, most=500)


def note_markdown(spark, root):
    """Every note written as markdown with its symbols and its chunks as body, and read back."""
    chunks = _chunks(spark, root).groupBy("memory_uid").agg(F.array_sort(F.collect_list(F.struct("chunk_ordinal", "chunk_heading", "chunk_text"))).alias("c"))  # the chunks of one note
    part = lambda c: F.concat_ws("\n", F.when(c["chunk_heading"] != "", F.concat(F.lit("## "), c["chunk_heading"])), F.coalesce(c["chunk_text"], F.lit("")))
    bodies = chunks.select("memory_uid", F.array_join(F.transform("c", part), "\n\n").alias("body"))
    symbols = latest_symbols(spark, root).groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("language", "name", F.coalesce("status", F.lit("active")).alias("status")))).alias("symbols"))  # the symbols of one note
    rows = latest_notes(spark, root).join(once(read(spark, root, "memories").select("memory_id", "title"), "memory_id"), "memory_id").join(symbols, "memory_id", "left").join(bodies, "memory_uid", "left")
    rows = rows.select("memory_id", F.col("memory_uid").alias("id"), "scope", F.col("file_path").alias("file"), "title", "status", F.col("file_status").alias("fileStatus"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("symbols", F.array().cast("array<struct<language:string,name:string,status:string>>")).alias("symbols"))
    back = note_files.parsed(note_files.written(rows).select("memory_id", "markdown"))
    return back.select("memory_id", "id", "scope", "file", "title", "status", "fileStatus", F.size("symbols").alias("n_symbols"), "body")


def note_upserts(spark, root):
    """The table of notes after the changes of some months are laid over what it held before."""
    rows = read(spark, root, "memories")
    at = F.to_timestamp(F.lit(CHANGED + "+00:00"))
    return note_files.upserted(rows.where(F.col("updated_at") < at), rows.where(F.col("updated_at") >= at), "memory_id", "updated_at", ["title", "file_path", "body_hash"])


def note_file_status(spark, root):
    """The file status every file-scoped note should have, next to the one it has."""
    paths = files_in_index(spark, root).select("project_id", resolved(F.col("path")).alias("file")).distinct().withColumn("there", F.lit(True))
    bound = latest_notes(spark, root).where((F.col("scope") == "file") & (F.col("file_path") != "")).withColumn("file", resolved(F.col("file_path")))
    return bound.join(paths, ["project_id", "file"], "left").select("memory_id", "file_status", F.when(F.col("there"), "active").otherwise("deleted").alias("should_be"))


def filtered_usages(spark, root):
    """Usages that are left once unlikely ones are removed."""
    u, d = _pair(spark, root)
    return resolution.filtered_usages(u, d).select("usage_id", "primary_def_id", "confidence")


def coupling_scores(spark, root):
    """Coupling strength of every usage."""
    return graph.coupled(read(spark, root, "usages")).select("usage_id", "score")


def find_usages(spark, root):
    """Usages of every symbol in groups of neighbours with their strongest coupling."""
    scored = graph.coupled(read(spark, root, "usages"))
    return grouping.adjacent_groups(scored, ["project_id", "name", "lang", "file_id"])


def code_windows(spark, root):
    """The lines to show around the usages of every file, two lines each way."""
    return grouping.code_windows(navigation.usages_once(read(spark, root, "usages")), ["file_id"], 2)


def inbound_edges(spark, root):
    """Files that use each symbol, by usages that most likely mean its primary definition."""
    return graph.inbound_edges(*_pair(spark, root))


def kept_inbound_edges(spark, root):
    """The same with twice the least score, so that more symbols fall back to one usage a file."""
    return graph.inbound_edges(*_pair(spark, root), least=0.4)


def outbound_edges(spark, root):
    """Names used within each definition."""
    return graph.outbound_edges(*_pair(spark, root))


def file_graph(spark, root):
    """Files that depend on files, per symbol."""
    return graph.file_graph(*_pair(spark, root))


def graph_metrics(spark, root):
    """Impact and coupling of every symbol."""
    return graph.graph_metrics(*_pair(spark, root))


PLACE = ["project_id", "path"]


def _snapshots(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    files = once(read(spark, root, "source_files").select("file_id", "project_id", "path", "sha256", "indexed_at", "removed_at"), "file_id")
    old, new = (corpus.snapshot(files, F.to_timestamp(F.lit(t + "+00:00"))) for t in (BEFORE, AFTER))
    return old, new


def index_changes(spark, root):
    """What a reconcile between two days would do to every path."""
    old, new = _snapshots(spark, root)
    return corpus.reconcile(new, old, PLACE, "sha256")


def _children(spark: SparkSession, root: str, snapshot: DataFrame) -> DataFrame:
    files = read(spark, root, "source_files").join(snapshot.select("file_id"), "file_id", "left_semi")
    return corpus.captures(corpus.lines(files)).drop("path").join(snapshot.select("file_id", *PLACE), "file_id").select(*PLACE, "file_id", "kind", "name", "line_no")


def reindexed_definitions(spark, root):
    """The definitions in the index after a reconcile: those of changed paths captured anew, those of deleted ones gone."""
    old, new = _snapshots(spark, root)
    actions = corpus.reconcile(new, old, PLACE, "sha256")
    changed = new.join(actions.where(F.col("action") == "index"), PLACE, "left_semi")
    return corpus.applied(_children(spark, root, old), _children(spark, root, changed), actions, PLACE)


def second_reconcile(spark, root):
    """What the same reconcile would do once it has been applied: paths by action, with and without a digest."""
    old, new = _snapshots(spark, root)
    held = corpus.applied(old, new, corpus.reconcile(new, old, PLACE, "sha256"), PLACE)
    again = corpus.reconcile(new, held, PLACE, "sha256").join(new.select(*PLACE, (F.coalesce("sha256", F.lit("")) != "").alias("has_digest")), PLACE)
    return again.groupBy("action", "has_digest").agg(F.count("*").alias("paths"))


def index_stats(spark, root):
    """Per project what the index runs report against what the tables hold."""
    runs = once(read(spark, root, "index_runs").select("run_id", "project_id", "indexed", "skipped", "deleted", "errors", "symbols", "refs"), "run_id")
    told = runs.groupBy("project_id").agg(F.count("*").alias("runs"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("indexed", "skipped", "deleted", "errors", "symbols", "refs")])
    live = files_in_index(spark, root).groupBy("project_id").agg(F.count("*").alias("files"))
    u, d = _pair(spark, root)
    defs = navigation.definitions_once(d).groupBy("project_id").agg(F.count("*").alias("definitions"))
    uses = navigation.usages_once(u).groupBy("project_id").agg(F.count("*").alias("usages"))
    out = read(spark, root, "projects").select("project_id")
    for t in (told, live, defs, uses):
        out = out.join(t, "project_id", "left")
    return out.na.fill(0)


def languages(spark, root):
    """Files by extension language against the language the index gives."""
    files = once(read(spark, root, "source_files").select("file_id", "path", "lang"), "file_id")
    return files.groupBy(kinds.language(F.col("path")).alias("by_extension"), "lang").agg(F.count("*").alias("n_files"))


def glob_files(spark, root):
    """Files that match each of some globs."""
    return corpus.matching_globs(read(spark, root, "source_files"), GLOBS)


def extracted_definitions(spark, root):
    """Definitions found in the source text itself, with where their documentation begins."""
    lines = corpus.lines(read(spark, root, "source_files"))
    found = corpus.captures(lines)
    docs = corpus.doc_starts(lines, found)
    return found.join(docs, ["file_id", "line_no"]).select("file_id", "language", "kind", "name", "line_no", "doc_line")


def structural_matches(spark, root):
    """Matches of each kind per language and project: files, matches and the most in one file."""
    files = once(read(spark, root, "source_files").select("file_id", "project_id"), "file_id")
    per_file = corpus.captures(corpus.lines(read(spark, root, "source_files"))).groupBy("file_id", "language", "kind").agg(F.count("*").alias("n"))
    return per_file.join(files, "file_id").groupBy("project_id", "language", "kind").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_matches"), F.max("n").alias("most"))


def captured_usages(spark, root):
    """Usages found in the source text itself."""
    return captures.captured_usages(read(spark, root, "source_files"))


def undefined_usages(spark, root):
    """Per language and kind the usages in source text, and those of names that their own file doesn't define."""
    files = read(spark, root, "source_files")
    defined = corpus.captures(corpus.lines(files)).select("file_id", "name").distinct().withColumn("here", F.lit(True))
    met = captures.captured_usages(files).join(defined, ["file_id", "name"], "left")
    away = (F.col("kind") != "import") & F.col("here").isNull()
    return met.groupBy("language", "kind").agg(F.count("*").alias("n_usages"), F.count_if(away).alias("defined_elsewhere"))


def definitions_at_cursors(spark, root):
    """Where the identifier under a cursor leads, one column into every usage: in the same file first."""
    u, d = _pair(spark, root)
    cursors = navigation.usages_once(u).select(F.col("usage_id").alias("cursor_id"), "project_id", "lang", F.col("path").alias("at_path"), F.col("file_id").alias("at_file"), F.col("start_line").alias("at_line"), (F.col("start_col") + 1).alias("at_col"))
    return navigation.definitions_at(cursors, d, u)


def source_directories(spark, root):
    """Every directory of a project that holds files in the index, itself or further below, and how many."""
    files = files_in_index(spark, root).where(F.col("path").contains("/"))
    return files.select("project_id", F.explode(ancestors(F.col("path"))).alias("directory")).groupBy("project_id", "directory").agg(F.count("*").alias("n_files"))


def node_names(spark, root):
    """How definitions are named in drawings: a shortened path, a plain id, and the name back from the id."""
    d = navigation.definitions_once(read(spark, root, "definitions"))
    node = F.concat_ws(":", "path", "name", "start_line")
    return d.select("def_id", shortened(F.col("path"), 24).alias("short_path"), node_name(node).alias("node"), symbol_of_node(node).alias("symbol"))


def note_sections(spark, root):
    """Sections of every document."""
    return notes.sections(read(spark, root, "documents").select("doc_id", "text"))


def note_search(spark, root):
    """The notes that a query finds, best first."""
    return notes.search(_chunks(spark, root), SEARCHED)


def note_title_searches(spark, root):
    """The notes that the title of every twentieth note finds, best first."""
    rows = read(spark, root, "memories").where(F.col("memory_id") % 20 == 0)
    titles = rows.groupBy("memory_id").agg(F.max(F.struct("updated_at", "title")).alias("r")).select(F.col("memory_id").alias("query_id"), F.col("r.title").alias("text"))
    return notes.searches(_chunks(spark, root), titles).withColumnRenamed("query_id", "memory_id")


def note_replacements(spark, root):
    """Matches of a pattern in every note chunk and how long the text is once they are replaced."""
    rows = _chunks(spark, root).select("memory_uid", "chunk_ordinal", F.col("chunk_text").alias("text"))
    return notes.replaced(rows, PATTERN, "NAME").select("memory_uid", "chunk_ordinal", "matches", F.length("new_text").alias("new_chars"))


def note_symbol_status(spark, root):
    """The status every note symbol should have, next to the one it has."""
    live = files_in_index(spark, root).select("file_id")
    known = read(spark, root, "definitions").join(live, "file_id", "left_semi").select("project_id", "name", F.lower(F.trim("lang")).alias("language")).distinct().withColumn("there", F.lit(True))
    symbols = latest_symbols(spark, root).withColumn("language", F.lower(F.trim("language"))).join(latest_notes(spark, root).select("memory_id", "project_id"), "memory_id")
    met = symbols.join(known, ["project_id", "name", "language"], "left")
    return met.select("memory_symbol_id", "status", F.when(F.col("there"), "active").otherwise("deleted").alias("should_be"))


def note_slugs(spark, root):
    """The file name part that each note title gives."""
    return read(spark, root, "memories").where(F.col("title") != "").select("title").distinct().select("title", notes.slug(F.col("title")).alias("slug"))


def quiet_periods(spark, root):
    """Events of each user in runs without a pause of more than a day."""
    return upkeep.quiet_periods(read(spark, root, "events"), "user_id", "ts", 86_400)


def streamed_index_state(spark, root):
    """The files each path holds after all index events have streamed by, late and repeated ones included."""
    source = f"{root}/source_files.parquet"
    schema = spark.read.parquet(source).schema
    state = upkeep.index_state(spark, source, schema, ["project_id", "path"], "file_id", ["sha256", "removed_at"])
    return state.select("project_id", "path", F.col("seq").alias("file_id"), "sha256", F.col("removed_at").isNull().alias("in_index"))


QUERIES = {
    f.__name__: f
    for f in (
        primary_definitions, ranked_definitions, ranked_definitions_with_noise, noisy_paths, identifiers_at_cursors, words_at_columns, deduplicated_captures, usages_not_definitions,
        resolution_scores, filtered_usages, coupling_scores, find_usages, code_windows, inbound_edges, kept_inbound_edges, outbound_edges, file_graph, graph_metrics, index_changes,
        index_stats, languages, glob_files, extracted_definitions, structural_matches, note_sections, note_search, note_replacements, note_symbol_status, note_slugs, quiet_periods,
        streamed_index_state, resolution_scores_by_line, coupling_scores_by_line, definition_code, usage_code, pattern_matches, capped_matches, note_markdown, note_upserts, note_file_status, note_title_searches,
        captured_usages, undefined_usages, definitions_at_cursors, reindexed_definitions, second_reconcile, source_directories, node_names,
    )
}
