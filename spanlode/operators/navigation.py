"""Definitions and usages by name and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlode.functions import kinds
from spanlode.sources.tables import once

SYMBOL = ["project_id", "name", "lang"]


DEFINITION = ["def_id", "project_id", "file_id", "path", "lang", "name", "kind", "container", "start_line", "start_col", "end_line", "end_col"]
USAGE = ["usage_id", "project_id", "file_id", "path", "lang", "name", "kind", "context_container", "relation", "receiver_type", "target_type", "start_line", "start_col", "end_line"]


def definitions_once(definitions: DataFrame) -> DataFrame:
    """One row per def_id."""
    return once(definitions.select(*DEFINITION).where(F.col("def_id").isNotNull()), "def_id")


def usages_once(usages: DataFrame) -> DataFrame:
    """One row per usage_id."""
    return once(usages.select(*USAGE).where(F.col("usage_id").isNotNull()), "usage_id")


def in_order():
    """The order of definitions as a struct: kind, path, place, id; the least comes first."""
    return F.struct(kinds.kind_order(F.col("kind")).alias("o"), "path", "start_line", "start_col", "def_id")


def primary_definitions(definitions: DataFrame) -> DataFrame:
    """Per project, name and language the first definition and how many there are.

    Both come from one aggregation whose partial results leave the map side, so a name with a third of all
    definitions costs a task no more than another. Null languages and names are symbols of their own.
    """
    return primary_of(definitions_once(definitions))


def primary_of(d: DataFrame) -> DataFrame:
    """``primary_definitions`` of a table that has each definition once."""
    best = d.groupBy(*SYMBOL).agg(F.min(F.struct(in_order().alias("o"), "file_id", "kind", "container", "end_line")).alias("b"), F.count("*").alias("candidates"))
    return best.select(
        *SYMBOL, F.col("b.o.def_id").alias("def_id"), "b.file_id", F.col("b.o.path").alias("path"), "b.kind", "b.container", F.col("b.o.start_line").alias("start_line"), F.col("b.o.start_col").alias("start_col"), "b.end_line", "candidates"
    )


def ranked_definitions(definitions: DataFrame, least: float = 0.55, include_noise: bool = False) -> DataFrame:
    """Definitions with their confidence, without noise: values go where the symbol has a type, then what lies under
    ``least``; where that would leave none, all that were left stay. Flags are aggregated and joined back."""
    d = definitions_once(definitions).withColumn("confidence", kinds.confidence(F.col("kind"), F.col("path")))
    if include_noise:
        return d
    is_type, is_value = F.col("kind").isin(kinds.TYPES), F.col("kind").isin(kinds.VALUES)
    passes = F.col("confidence") >= least
    flags = d.groupBy(*SYMBOL).agg(F.max(is_type).alias("has_type"), F.max(passes).alias("any_passes"), F.max(passes & ~is_value).alias("other_passes"))
    flagged = d.join(flags.select(*[F.col(c).alias(f"_{c}") for c in SYMBOL], "has_type", "any_passes", "other_passes"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SYMBOL])
    left = flagged.where(~(F.col("has_type") & is_value))
    some = F.when(F.col("has_type"), F.col("other_passes")).otherwise(F.col("any_passes"))
    return left.where(passes | ~some).select(*d.columns)


def at_cursor(cursors: DataFrame, definitions: DataFrame, usages: DataFrame) -> DataFrame:
    """(cursor_id, name, source): the identifier at file_id, line and col of each cursor: a definition whose name
    covers the column, else a usage that does, else null. Of several the least by start and name counts.

    Places and spans are made distinct before they meet, so a crowded line costs its width, not its rows."""
    d = definitions_once(definitions).select("file_id", "start_line", "start_col", "end_col", "name", F.lit(0).alias("p"))
    u = usages.select("file_id", "start_line", "start_col", "end_col", "name", F.lit(1).alias("p")).distinct()
    spans = d.unionByName(u).where(F.col("name").isNotNull()).groupBy("file_id", "start_line", "start_col", "end_col", "p").agg(F.min("name").alias("name"))
    place = ["at_file", "at_line", "at_col"]
    places = cursors.select(*place).distinct()
    met = places.join(spans, (F.col("at_file") == F.col("file_id")) & (F.col("at_line") == F.col("start_line")) & F.col("at_col").between(F.col("start_col"), F.col("end_col")))
    best = met.groupBy(*place).agg(F.min(F.struct("p", "start_col", "name")).alias("b"))
    return cursors.select("cursor_id", *place).join(best, place, "left").select("cursor_id", F.col("b.name").alias("name"), F.when(F.col("b.p") == 0, "definition").when(F.col("b.p") == 1, "usage").alias("source"))


def definitions_at(cursors: DataFrame, definitions: DataFrame, usages: DataFrame) -> DataFrame:
    """(cursor_id, name, def_id, path, confidence, candidates): the definition that the identifier under each cursor
    leads to, of the cursor's project and language (``cursors`` has project_id, lang and at_path besides the place): the
    first in the cursor's file, else the first of all; null and 0 without one. Both are looked up in aggregates, so no
    cursor meets all definitions of a name."""
    found = at_cursor(cursors, definitions, usages).select("cursor_id", "name")
    d = definitions_once(definitions).withColumn("o", F.struct(in_order().alias("o"), "kind"))
    near = d.groupBy(*SYMBOL, F.col("file_id").alias("at_file")).agg(F.min("o").alias("near"))
    far = d.groupBy(*SYMBOL).agg(F.min("o").alias("far"), F.count("*").alias("candidates"))
    rows = cursors.select("cursor_id", "project_id", "lang", "at_file", "at_path").join(found, "cursor_id").join(near, [*SYMBOL, "at_file"], "left").join(far, SYMBOL, "left")
    rows = rows.withColumn("to", F.coalesce("near", "far")).withColumn("path", F.col("to.o.path"))
    sure = F.when(F.col("path").isNotNull(), kinds.confidence(F.col("to.kind"), F.col("path"), F.col("at_path")))
    return rows.select("cursor_id", "name", F.col("to.o.def_id").alias("def_id"), "path", sure.alias("confidence"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def word_at(text, col):
    """The identifier around the zero-based column of a line; empty where there is none."""
    before = F.regexp_extract(F.left(text, col), r"[\p{L}\p{Nd}_]*$", 0)
    after = F.regexp_extract(text.substr(col + 1, F.length(text)), r"^[\p{L}\p{Nd}_]+", 0)
    return F.when(after == "", "").otherwise(F.concat(before, after))


def deduplicated_captures(usages: DataFrame) -> DataFrame:
    """Per file, name and place the usage of the highest priority; of equals the one with the least id."""
    place = ["file_id", "name", "start_line", "start_col"]
    order = F.struct(kinds._chosen(F.col("kind"), kinds.CAPTURE_PRIORITY, 10).alias("p"), (-F.col("usage_id")).alias("i"))
    return usages.groupBy(*place).agg(F.max(F.struct(order.alias("o"), "usage_id", "kind")).alias("b"), F.count_distinct("usage_id").alias("captures")).select(*place, "b.usage_id", "b.kind", "captures")


def not_definitions(usages: DataFrame, definitions: DataFrame) -> DataFrame:
    """Usages that don't stand where a definition of that name stands."""
    place = ["file_id", "name", "start_line", "start_col"]
    return usages_once(usages).join(definitions.select(*place).distinct(), place, "left_anti")
