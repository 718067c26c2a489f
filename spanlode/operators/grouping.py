"""Groups of usages that stand near each other, and windows of code around them.

Rows are first reduced to one per line, so the window that finds the gaps holds at most as many rows as a file has
lines, however often a hot name stands on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(lines: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Adds ``island``: intervals first_line..last_line of a key are of one island while each starts no more than
    ``gap`` lines after everything before it has ended. Lines are not null."""
    order = Window.partitionBy(*keys).orderBy("first_line")
    so_far = F.max("last_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.coalesce(F.col("first_line") > so_far + gap, F.lit(True))).cast("int")
    return lines.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def adjacent_groups(scored: DataFrame, keys: list[str], gap: int = 3) -> DataFrame:
    """Per key and island the usages, distinct lines, first and last line and the highest score.

    ``scored`` has the keys, start_line, end_line and score. Rows without lines are left out; copies of a row count
    as often as they occur; null keys form groups of their own.
    """
    rows = scored.where(F.col("start_line").isNotNull())
    lines = rows.groupBy(*keys, F.col("start_line").alias("first_line")).agg(F.max(F.coalesce("end_line", "start_line")).alias("last_line"), F.max("score").alias("score"), F.count("*").alias("n"))
    marked = islands(lines, keys, gap)
    return marked.groupBy(*keys, "island").agg(
        F.sum("n").alias("n_usages"), F.count("*").alias("n_lines"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.max("score").alias("max_score")
    )


def code_windows(places: DataFrame, keys: list[str], around: int) -> DataFrame:
    """Windows [line - around, line + around] per key, from line 1 on, merged where they overlap or touch."""
    k = max(0, min(50, around))
    lines = places.where(F.col("start_line").isNotNull()).groupBy(*keys, "start_line").agg(F.max(F.coalesce("end_line", "start_line")).alias("end_line"))
    spans = lines.select(*keys, F.greatest(F.col("start_line") - k, F.lit(1)).alias("first_line"), (F.col("end_line") + k).alias("last_line"))
    spans = spans.groupBy(*keys, "first_line").agg(F.max("last_line").alias("last_line"))
    return islands(spans, keys, 1).groupBy(*keys, "island").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.count("*").alias("windows"))
