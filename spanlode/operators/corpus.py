"""Source files, their lines, what they define, and how two states of them differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlode.functions import kinds
from spanlode.functions.paths import basename

#: Language, kind, pattern of a line that defines the name in its first group.
DEFINES = (
    ("go", "function", r"^func (\w+)"),
    ("go", "method", r"^func \([^)]*\) (\w+)"),
    ("go", "struct", r"^type (\w+) struct\b"),
    ("go", "interface", r"^type (\w+) interface\b"),
    ("go", "constant", r"^const (\w+) ="),
    ("go", "variable", r"^var (\w+) ="),
    ("java", "class", r"^(?:public |final |abstract )*class (\w+)"),
    ("java", "interface", r"^(?:public )?interface (\w+)"),
    ("java", "constructor", r"^\s+(?:public |private |protected )?([A-Z]\w*)\([^;=()]*\) (?:throws [\w., ]+ )?\{"),
    ("java", "method", r"^\s+(?:public |private |protected |static |final )*[\w<>,\[\]]+ (\w+)\([^;=]*\) (?:throws [\w., ]+ )?\{"),
    ("java", "enum", r"^\s*(?:public |private |protected |static )*enum (\w+)"),
    ("java", "field", r"^\s+(?:private|public|protected|static) [\w<>,\[\] ]+ (\w+)(?: =|;)"),
    ("java", "variable", r"^\s+(?:final )?[\w.]+(?:<[\w<>,.? ]*>)?(?:\[\])* (\w+) = "),
    ("python", "class", r"^class (\w+)"),
    ("python", "function", r"^(?:async )?def (\w+)"),
    ("python", "method", r"^\s+(?:async )?def (\w+)"),
    ("python", "constant", r"^\s*([A-Z0-9_]*[A-Z][A-Z0-9_]*)(?:: [^=]+)? (?://|\*\*|<<|>>|[-+*/%&|^@])?= "),
    ("python", "variable", r"^\s*([A-Za-z_]\w*)(?:: [^=]+)? (?://|\*\*|<<|>>|[-+*/%&|^@])?= "),
    ("rust", "function", r"^(?:pub(?:\([\w: ]+\))? )?(?:const |async |unsafe )*fn (\w+)"),
    ("rust", "method", r"^\s+(?:pub(?:\([\w: ]+\))? )?(?:const |async |unsafe )*fn (\w+)"),
    ("rust", "struct", r"^(?:pub(?:\([\w: ]+\))? )?struct (\w+)"),
    ("rust", "enum", r"^(?:pub(?:\([\w: ]+\))? )?enum (\w+)"),
    ("rust", "constant", r"^\s*(?:pub(?:\([\w: ]+\))? )?(?:const|static)(?: mut)? (\w+):"),
    ("rust", "trait", r"^\s*(?:pub(?:\([\w: ]+\))? )?(?:unsafe )?trait (\w+)"),
    ("rust", "type_alias", r"^\s*(?:pub(?:\([\w: ]+\))? )?type (\w+)"),
    ("rust", "module", r"^\s*(?:pub(?:\([\w: ]+\))? )?mod (\w+)"),
    ("rust", "variable", r"^\s*let (?:mut )?([a-z_]\w*)"),
    ("javascript", "class", r"^(?:export )?(?:default )?class (\w+)"),
    ("javascript", "function", r"^(?:export )?(?:async )?function (\w+)"),
    ("javascript", "variable", r"^\s*(?:export )?(?:const|let|var) (\w+)(?: =|;)"),
    ("javascript", "constructor", r"^\s+(constructor)\("),
    ("javascript", "method", r"^\s+(?:static |async |get |set )*(#?\w+)\([^()]*\) \{"),
    ("typescript", "class", r"^(?:export )?(?:abstract )?class (\w+)"),
    ("typescript", "interface", r"^(?:export )?interface (\w+)"),
    ("typescript", "type_alias", r"^(?:export )?type (\w+) ="),
    ("typescript", "function", r"^(?:export )?(?:async )?function (\w+)"),
    ("typescript", "enum", r"^\s*(?:export )?(?:declare )?(?:const )?enum (\w+)"),
    ("typescript", "module", r"^\s*(?:export )?(?:declare )?(?:namespace|module) (\w+)"),
    ("typescript", "variable", r"^\s*(?:export )?(?:const|let|var) (\w+)(?::[^=;]*)?(?: =|;)"),
    ("typescript", "constructor", r"^\s+(?:public |private |protected )?(constructor)\("),
    ("typescript", "method", r"^\s+(?:public |private |protected |static |override |async |get |set )*(#?\w+)(?:<[^>]*>)?\([^()]*\)(?:: [^;{]+)? \{"),
    ("typescript", "method", r"^\s+(?:public |protected )?abstract (\w+)(?:<[^>]*>)?\([^()]*\)(?:: [^{]+)?;"),
    ("typescript", "field", r"^\s+(?:public |private |protected |static |readonly |declare )+(#?\w+)[?!]?(?:: [^=;]+)?(?: =|;)"),
)

#: How a documentation line begins, by language.
DOC_LINES = {
    "go": r"^(//|/\*|\*)|\*/$", "java": r"^(//|/\*|\*|@)|\*/$", "typescript": r"^(//|/\*|\*|@)|\*/$", "javascript": r"^(//|/\*|\*|@)|\*/$",
    "rust": r"^(///|//!|//|#\[|#!\[)", "python": r"^(#|@)",
}


def lines(files: DataFrame) -> DataFrame:
    """(file_id, project_id, path, language, line_no, line) of every distinct file, line ends of any kind. A null
    content has no lines. Bytes that aren't UTF-8 are replaced."""
    rows = files.where(F.col("content").isNotNull()).select("file_id", "project_id", "path", kinds.language(F.col("path")).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    rows = rows.groupBy("file_id").agg(F.max(F.struct("project_id", "path", "language", "text")).alias("r")).select("file_id", "r.*")
    text = F.replace(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = rows.select("file_id", "project_id", "path", "language", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return out.withColumn("line_no", F.col("line_no") + 1)


def captures(source_lines: DataFrame) -> DataFrame:
    """(file_id, path, language, kind, name, line_no): what lines define. The first pattern of a language that matches
    counts. Patterns see one line, so a definition that breaks before its name is not seen."""
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for lang, kind, pattern in reversed(DEFINES):
        hit = (F.col("language") == lang) & F.col("line").rlike(pattern)
        found = F.when(hit, F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", pattern, 1).alias("name"))).otherwise(found)
    return source_lines.withColumn("f", found).where(F.col("f").isNotNull()).select("file_id", "path", "language", "f.kind", "f.name", "line_no")


def doc_starts(source_lines: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, line_no, doc_line): where the documentation directly above each captured definition begins; its own
    line if there is none. Only documentation lines meet in the join, by the run of lines they belong to."""
    is_doc = F.lit(False)
    for lang, pattern in DOC_LINES.items():
        is_doc = F.when(F.col("language") == lang, F.trim("line").rlike(pattern)).otherwise(is_doc)
    docs = source_lines.where(is_doc).select("file_id", "line_no")
    from spanlode.operators.grouping import islands

    runs = islands(docs.select("file_id", F.col("line_no").alias("first_line"), F.col("line_no").alias("last_line")), ["file_id"], 1)
    runs = runs.groupBy("file_id", "island").agg(F.min("first_line").alias("doc_line"), (F.max("last_line") + 1).alias("line_no"))
    return found.select("file_id", "line_no").join(runs.select("file_id", "line_no", "doc_line"), ["file_id", "line_no"], "left").withColumn("doc_line", F.coalesce("doc_line", "line_no"))


def matching_globs(files: DataFrame, globs: dict[str, str]) -> DataFrame:
    """(file_id, glob): files whose whole path or base name matches a glob."""
    hits = [F.when(F.col("path").rlike(kinds.glob_pattern(g)) | basename(F.col("path")).rlike(kinds.glob_pattern(g)), F.lit(name)) for name, g in globs.items()]
    return files.select("file_id", "path").distinct().select("file_id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("glob"))


def reconcile(listing: DataFrame, index: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys with the action that makes the index equal to the listing: ``index`` what is new or has another digest,
    ``delete`` what is gone, ``skip`` the rest. Both sides have a key once; null digests differ from all others.
    Doing it again on the result only skips."""
    left = listing.select(*keys, F.coalesce(F.col(digest), F.lit("")).alias("_new"))
    right = index.select(*keys, F.coalesce(F.col(digest), F.lit("")).alias("_old"))
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull() | (F.col("_old") != F.col("_new")) | (F.col("_new") == ""), "index").otherwise("skip")
    return left.join(right, keys, "full_outer").select(*keys, action.alias("action"))


def snapshot(files: DataFrame, at) -> DataFrame:
    """(project_id, path, sha256, file_id): what was in the index at a time; of several files under one path the latest."""
    held = files.where((F.col("indexed_at") <= at) & (F.col("removed_at").isNull() | (F.col("removed_at") > at)))
    return held.groupBy("project_id", "path").agg(F.max(F.struct("indexed_at", "file_id", "sha256")).alias("r")).select("project_id", "path", "r.sha256", "r.file_id")


def applied(held: DataFrame, listed: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """A table after the actions of ``reconcile``: rows of keys to index come from ``listed``, rows of keys to delete go,
    the rest stay. For children of the keyed rows too: all of a key's children are replaced together. Both tables have
    the same columns. Applying the same actions again changes nothing."""
    changed = actions.where(F.col("action") != "skip").select(*keys)
    stay = held.join(changed, keys, "left_anti")
    return stay.unionByName(listed.join(actions.where(F.col("action") == "index").select(*keys), keys, "left_semi").select(*stay.columns))
