"""Rows that may hold one of a set of keys, told on the map side: a table of bits by the keys' hashes, no exchange of the rows.

A row of a key is always told; others are too now and then, so whoever needs the set itself still joins by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlode.plans.runtime import written
from spanlode.sources.tables import once

#: Words of 64 bits in a table, by the number of rows: a few in tests, 8 MB at most, where more keys only mean more rows told.
LEAST_WORDS, MOST_WORDS, WORDS_A_ROW = 1 << 10, 1 << 20, 1 / 8


def _word_and_bits(words: int, *key: str) -> tuple[Column, Column]:
    """The key's word, and three of the bits of a word."""
    h = F.xxhash64(*key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, n).bitwiseAND(63).cast("int")) for n in (24, 32, 40)]
    return h.bitwiseAND(words - 1), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def may_hold(keys: DataFrame, *key: str, rows: int) -> Column:
    """A condition on rows with the columns ``key``: true where ``keys`` has them, rarely true elsewhere. Keys of which a
    part is null are in no set. ``rows`` is about how many keys there are, at most."""
    words = LEAST_WORDS
    while words < min(rows * WORDS_A_ROW, MOST_WORDS):
        words *= 2
    word, bits = _word_and_bits(words, *key)
    whole = F.lit(True)
    for c in key:
        whole &= F.col(c).isNotNull()
    told = keys.where(whole).select(word.alias("w"), bits.alias("b")).unionByName(keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")))
    table = told.groupBy("w").agg(F.bit_or("b").alias("b")).agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("t"))
    held = written(table.select(F.transform("t", lambda x: x["b"]).alias("t"))).scalar()
    return whole & (F.get(held, word.cast("int")).bitwiseAND(bits) == bits)


def each_once(df: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """``once(df, key)`` where ``where``, without rows of which the key is null. Only rows whose key may occur again are exchanged."""
    rows = df.where(F.col(key).isNotNull())
    repeated = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    again = may_hold(repeated, key, rows=df.count() // 64)
    wanted = F.lit(True) if where is None else where
    return rows.where(~again & wanted).unionByName(once(rows.where(again), key).select(*df.columns).where(wanted))
