"""Per-key figures and exact quantiles when a few keys hold most rows.

Quantiles come from distributed exact selection. Each round counts, for every (key, quantile) interval, the values
in 256 equal buckets, finds the bucket that holds the wanted rank and takes it as the next interval, until the
interval is one value wide. Counts merge, so each task sends at most 256 numbers per interval and no key's values
are ever gathered. Keys that hold more than 1/``HOT_SHARE`` of the rows are dealt over ``SALTS`` parts before they
meet their interval; there can be at most ``HOT_SHARE`` such keys, so their list is small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlode.plans.runtime import cut, salt_of, written

BITS = 8
HOT_SHARE = 200
SALTS = 32


def weighted_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(k, v, n): how often each key has each value. Partial counts leave the map side, so hot keys shrink first."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))


def exact_quantiles(values: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(k, p, q): for each key and probability the value of rank ceil(p * rows), at least 1, counted from the smallest.

    ``values`` has the columns k, v (long) and n (times). Null values don't count; a key without values has no row.
    A null key is a key like any other; values lie within ±2**62. The result is a value that occurs, never an interpolation.
    """
    values = written(values)
    per_key = values.groupBy("k").agg(F.sum("n").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    per_key = cut(per_key)
    facts = per_key.agg(F.sum("rows"), F.max(F.col("hi") - F.col("lo"))).first()
    total, widest = facts[0] or 0, facts[1] or 0
    hot = F.broadcast(per_key.where(F.col("rows") > total / HOT_SHARE).select(F.col("k").alias("hk"), F.lit(True).alias("is_hot")))  # fewer than HOT_SHARE rows
    rounds = max(1, -(-int(widest).bit_length() // BITS))
    state = per_key.select("k", "rows", "lo", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")).select(
        "k", "p", "lo", F.greatest(F.ceil(F.col("p") * F.col("rows")).cast("long"), F.lit(1)).alias("rank")
    )
    dealt = values.join(hot, F.col("k").eqNullSafe(F.col("hk")), "left").select(
        "k", "v", "n", F.when(F.col("is_hot"), salt_of("v", salts=SALTS)).otherwise(F.lit(0)).alias("salt")
    )
    for step in reversed(range(rounds)):
        shift = step * BITS
        last = step == rounds - 1
        spread = state.join(hot, F.col("k").eqNullSafe(F.col("hk")), "left").select(
            F.col("k").alias("sk"), "p", "lo", "rank",
            F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("ssalt"),
        )
        inside = F.col("v") >= F.col("lo")
        if not last:
            inside &= F.col("v") < F.col("lo") + F.lit(1 << (shift + BITS))
        met = dealt.join(spread, F.col("k").eqNullSafe(F.col("sk")) & (F.col("salt") == F.col("ssalt")) & inside)
        bucket = F.shiftright(F.col("v") - F.col("lo"), shift)
        counts = met.groupBy("k", "p", "lo", "rank", bucket.alias("b")).agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("k", "p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**BITS buckets
        before = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        held = before.where((F.col("before") < F.col("rank")) & (F.col("before") + F.col("n") >= F.col("rank")))
        state = held.select("k", "p", (F.col("lo") + F.shiftleft(F.col("b"), shift)).alias("lo"), (F.col("rank") - F.col("before")).alias("rank"))
        if step:
            state = cut(state)
    return state.select("k", "p", F.col("lo").alias("q"))


def distinct_per_key(df: DataFrame, key: str, what: str, name: str) -> DataFrame:
    """(k, ``name``): distinct non-null values per key in two steps; the first spreads a hot key over its values."""
    pairs = df.where(F.col(what).isNotNull()).select(F.col(key).alias("k"), F.col(what).alias("w")).distinct()
    return pairs.groupBy("k").agg(F.count("*").alias(name))


def key_figures(df: DataFrame, key: str, row_id: str, value: str, distinct: dict[str, str], probabilities: dict[str, float]) -> DataFrame:
    """Per value of ``key``: ``n_rows`` distinct ``row_id``, the distinct counts named in ``distinct`` ({column: result
    name}) and the exact quantiles of ``value`` named in ``probabilities`` ({result name: p}).

    Rows count once per ``row_id`` however often they were delivered; a copy that differs in another column still
    counts once, with the greatest value. Null row ids are left out; a null key is reported as a null key; other nulls
    don't count. Columns that aren't named are never read. An empty table gives no rows.
    """
    used = list(dict.fromkeys([key, row_id, value, *distinct]))
    rows = df.where(F.col(row_id).isNotNull()).select(*used)
    rest = [c for c in used if c not in (key, row_id)]
    rows = rows.groupBy(row_id, key).agg(*[F.max(c).alias(c) for c in rest])  # by id, so evenly dealt
    counts = rows.groupBy(F.col(key).alias("k"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(distinct)], F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    counts = written(counts)
    out = counts.groupBy("k").agg(F.sum("n").alias("n_rows"))
    for i, name in enumerate(distinct.values()):
        per = distinct_per_key(counts, "k", f"_d{i}", name).withColumnRenamed("k", "k2")
        out = out.join(per, F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    weighted = counts.where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.sum("n").alias("n"))
    found = exact_quantiles(weighted, list(probabilities.values()))
    wide = found.groupBy(F.col("k").alias("k2")).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(name) for name, p in probabilities.items()])
    return out.join(wide, F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2").withColumnRenamed("k", key)
