"""Notes as markdown files with frontmatter, and changes to the table of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "note"
FIELDS = ("id", "scope", "file", "title", "status", "fileStatus")
#: What a field means where it is missing.
DEFAULTS = {"scope": "project", "status": "active", "fileStatus": "active"}


def _quoted(value):
    text = F.coalesce(value, F.lit(""))
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def written(notes: DataFrame) -> DataFrame:
    """Adds ``markdown``: frontmatter with the fields and symbols of a note, then its body.

    ``notes`` has the columns in ``FIELDS``, body and symbols (array of structs with language, name and status).
    """
    head = [F.concat(F.lit(f"  {f}: "), _quoted(F.col(f))) for f in FIELDS]
    symbol = lambda s: F.concat(F.lit("    - language: "), _quoted(s["language"]), F.lit("\n      name: "), _quoted(s["name"]), F.lit("\n      status: "), _quoted(s["status"]), F.lit("\n"))
    symbols = F.when(F.size("symbols") > 0, F.concat(F.lit("  symbols:\n"), F.array_join(F.transform("symbols", symbol), ""))).otherwise("")
    body = F.when(F.coalesce("body", F.lit("")) == "", "").otherwise(F.concat(F.lit("\n"), F.col("body"), F.when(F.col("body").endswith("\n"), "").otherwise("\n")))
    return notes.withColumn("markdown", F.concat(F.lit(f"---\n{KEY}:\n"), F.concat_ws("\n", *head), F.lit("\n"), symbols, F.lit("---\n"), body))


def _unquoted(text):
    plain = F.regexp_replace(F.trim(text), r'^"(.*)"$', "$1")
    mark = "\u0001"
    return F.replace(F.replace(F.replace(F.replace(plain, F.lit("\\\\"), F.lit(mark)), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit(mark), F.lit("\\"))


def parsed(texts: DataFrame) -> DataFrame:
    """Adds the fields, symbols and ``body`` of ``markdown``. Texts without frontmatter or id have a null id and all of
    their text as body; missing fields take their defaults. Scalars are plain or in double quotes on one line."""
    text = F.replace("markdown", F.lit("\r\n"), F.lit("\n"))
    front = F.regexp_extract(text, r"^---[ \t]*\n([\s\S]*?\n)---[ \t]*(?:\n|$)", 1)
    rest = F.regexp_replace(F.regexp_replace(text, r"^---[ \t]*\n[\s\S]*?\n---[ \t]*(?:\n|$)", ""), r"^\n+", "")
    field = lambda f: _unquoted(F.regexp_extract(front, rf"(?m)^  {f}:[ \t]*(.*)$", 1))
    out = texts.withColumn("_id", F.nullif(field("id"), F.lit("")))
    for f in FIELDS[1:]:
        out = out.withColumn(f, F.when(F.col("_id").isNotNull(), F.when(field(f) == "", F.lit(DEFAULTS.get(f, ""))).otherwise(field(f))))
    names = r'(?m)^    - language:[ \t]*(.*)\n      name:[ \t]*(.*)\n      status:[ \t]*(.*)$'
    parts = [F.regexp_extract_all(front, F.lit(names), F.lit(i)) for i in (1, 2, 3)]
    symbols = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("language", "name", "status"), strict=True)]), lambda s: F.struct(_unquoted(s["language"]).alias("language"), _unquoted(s["name"]).alias("name"), _unquoted(s["status"]).alias("status")))
    return out.withColumn("symbols", F.when(F.col("_id").isNotNull(), symbols)).withColumn("body", F.when(F.col("_id").isNull(), F.col("markdown")).otherwise(rest)).withColumnRenamed("_id", "id")


def upserted(table: DataFrame, changes: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """The table after the changes: of each key the row with the greatest version, in which a field that a change
    leaves null keeps what the row before it had. Deletion is a change of status; nothing is lost. Copies and changes
    in any order give the same result."""
    rows = table.select(key, version, *fields).unionByName(changes.select(key, version, *fields)).where(F.col(key).isNotNull())
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(version, f)))[f].alias(f) for f in fields]
    return rows.groupBy(key).agg(F.max(version).alias(version), *last)


def merged_strays(texts: DataFrame) -> DataFrame:
    """(name, section, markdown): texts with an id as they are, each other text as a section of ``project.md`` below a
    heading with its name, so that broken files are kept. Sections stay rows: however many there are, none are gathered.
    Blank texts without an id are dropped."""
    known = parsed(texts.select("name", "markdown"))
    good = known.where(F.col("id").isNotNull()).select("name", F.lit(None).cast("string").alias("section"), "markdown")
    stray = known.where(F.col("id").isNull() & (F.trim("markdown") != ""))
    return good.unionByName(stray.select(F.lit("project.md").alias("name"), F.col("name").alias("section"), F.concat(F.lit("## "), "name", F.lit("\n\n"), "markdown").alias("markdown")))
