"""Filling containers of fixed capacity by harmonic packing.

An item of size s in (C/(k+1), C/k] is of class k: exactly k of them fit in a container whatever their sizes are, so
each worker numbers the items of a class and closes a container after every k-th, without looking at another item.
Above ``EXACT`` the classes k lie ``STEP`` apart, so a container of small items is filled to 1/``STEP`` at least, and
items of any size down to 1 have a class. Items of size 0 need no room and lie apart. What large items leave over is
itself a capacity: a container of a class 1 or 2 item whose rest has class j (C/j fits in the rest) takes items of
class j, again by number only, before the others of that class are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlode.plans.runtime import cut, salt_of

EXACT = 64
STEP = 1.02
GROUP_ROWS = 50_000


def class_numbers(capacity: int) -> list[int]:
    """The classes above ``EXACT``, ascending: 236 for a capacity of 4,096, 35 more each time it doubles."""
    out, k = [], EXACT
    while (k := max(k + 1, int(k * STEP))) <= capacity:
        out.append(k)
    return out


def classed(sizes: DataFrame, capacity: int) -> DataFrame:
    """Adds ``k``, the reciprocal class of ``size`` (1 .. capacity); 0 for size 0."""
    k = F.floor(F.lit(capacity) / F.greatest(F.col("size"), F.lit(1))).cast("int")
    small = F.split(F.lit(" ".join(map(str, [EXACT, *class_numbers(capacity)]))), " ").cast("array<int>")
    near = F.when(k <= EXACT, k).otherwise(F.array_max(F.filter(small, lambda x: x <= k)))
    return sizes.withColumn("k", F.when(F.col("size") > 0, near).otherwise(0))


def pieces_of(items: DataFrame, capacity: int) -> DataFrame:
    """(item, split, part, first, size): items within the capacity whole, others in full parts and a rest."""
    parts = F.greatest(F.ceil(F.col("size") / F.lit(capacity)), F.lit(1)).cast("int")
    rows = items.select("item", "size", (F.col("size") > capacity).alias("split"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    first = F.col("part").cast("long") * capacity
    return rows.select("item", "split", "part", first.alias("first"), F.least(F.col("size") - first, F.lit(capacity)).cast("long").alias("size"))


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """(item, part, first, size, container, split): a container for every part of every item.

    ``items`` has item (unique) and size (long; null or negative counts as 0). No container holds more than
    ``capacity``. An item above the capacity, and no other, comes in parts (``split``). Groups of about
    ``GROUP_ROWS`` items are packed on their own, so one task holds that many at most; each group leaves at most one
    container a class partly filled, and puts its items of size 0 into one container. An empty table gives no rows.
    """
    sized = items.select("item", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    parts = classed(pieces_of(sized, capacity), capacity)
    groups = max(1, -(-sized.count() // GROUP_ROWS))
    parts = cut(parts.withColumn("g", salt_of("item", "part", salts=groups)))
    order = [F.xxhash64("item", "part"), "item", "part"]
    numbered = parts.withColumn("n", F.row_number().over(Window.partitionBy("g", "k").orderBy(*order)) - 1)
    numbered = numbered.withColumn("home", F.when(F.col("k") > 0, F.floor(F.col("n") / F.greatest("k", F.lit(1)))).otherwise(0).cast("long"))
    rooms = numbered.where(F.col("k").isin(1, 2)).groupBy("g", "k", "home").agg((F.lit(capacity) - F.sum("size")).alias("room"))
    rooms = rooms.withColumn("j", F.greatest(F.ceil(F.lit(capacity) / F.greatest(F.col("room"), F.lit(1))), F.lit(3)).cast("int")).where(F.col("j") <= EXACT)
    fits = F.floor(F.col("room") * F.col("j") / F.lit(capacity)).cast("int")
    slots = rooms.withColumn("slot", F.explode(F.sequence(F.lit(1), F.greatest(fits, F.lit(1)))))
    slots = slots.withColumn("n", F.row_number().over(Window.partitionBy("g", "j").orderBy("k", "home", "slot")) - 1)
    slots = slots.select("g", F.col("j").alias("k"), "n", F.col("k").alias("at_k"), F.col("home").alias("at_home"))
    used = slots.groupBy("g", "k").agg(F.count("*").alias("slots"))
    movable = F.col("k") > 2
    placed = numbered.join(slots, ["g", "k", "n"], "left").join(used, ["g", "k"], "left")
    own = F.floor((F.col("n") - F.coalesce(F.col("slots"), F.lit(0))) / F.greatest("k", F.lit(1))).cast("long")
    taken = movable & F.col("at_k").isNotNull()
    key = F.when(taken, F.concat_ws("-", "g", "at_k", "at_home")).when(movable, F.concat_ws("-", "g", "k", own)).otherwise(F.concat_ws("-", "g", "k", "home"))
    return placed.select("item", "part", "first", "size", key.alias("container"), "split")
