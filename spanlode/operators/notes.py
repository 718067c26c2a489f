"""Markdown notes: sections, ranked search, status, text replacement."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^#{1,6}[ \t]+(\S.*)$"
#: What a hit in a field counts.
BOOST = {"title": 2.0, "chunk_heading": 1.5, "chunk_text": 1.0, "symbol_text": 1.0}
GROUP, BLOCK = 20_000, 200_000  # chunks and queries, about, that a task holds at once


def sections(texts: DataFrame) -> DataFrame:
    """(doc_id, ordinal, heading, n_lines, n_chars): texts cut before every heading of level 1 to 6; what stands before
    the first heading has an empty one; sections of blank text are dropped and the rest numbered from 0.

    Each text is cut within its row at the places of its headings, so there is no exchange and the work grows with its
    length. Null and blank texts have no section.
    """
    rows = texts.where(F.col("text").isNotNull()).select("doc_id", F.split(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), "\n").alias("l"))
    heads = F.filter(F.transform("l", lambda x, i: F.when(x.rlike(HEADING), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("h", heads).withColumn("s", F.when((F.size("h") > 0) & (F.try_element_at("h", F.lit(1)) == 1), F.col("h")).otherwise(F.concat(F.array(F.lit(1)), "h")))
    end = lambda k: F.coalesce(F.try_element_at("s", k + 2), F.size("l") + 1)
    parts = F.transform("s", lambda at, k: F.slice("l", at, end(k) - at))
    kept = F.filter(parts, lambda p: F.trim(F.array_join(p, "")) != "")
    rows = rows.select("doc_id", F.posexplode(kept).alias("ordinal", "p"))
    heading = F.trim(F.regexp_extract(F.element_at("p", 1), HEADING, 1))
    return rows.select("doc_id", "ordinal", heading.alias("heading"), F.size("p").alias("n_lines"), F.length(F.array_join("p", "\n")).alias("n_chars"))


def terms(text):
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def searches(chunks: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, memory_uid, chunk_ordinal, score): for every row of ``queries`` (query_id, text) the notes by their
    best chunk, of its ``limit`` best chunks.

    A chunk's score is, over fields and distinct query terms, boost * sqrt(times) * (1 + ln(chunks / chunks with the
    term))**2 / sqrt(terms in the field). Only active notes with an active file count. A blank query has no hits.

    Queries with the same terms are searched once. Groups of chunks meet blocks of queries, all of them, and a pair of
    both gives each query's ``limit`` best chunks, so scores of single chunks are never exchanged: chunks once for every
    block, queries and their best once for every group.
    """
    active = chunks.where((F.col("status") == "active") & (F.col("file_status") == "active")).select("memory_uid", "chunk_ordinal", *[terms(F.col(f)).alias(f) for f in BOOST])
    asked = queries.select("query_id", F.array_sort(F.array_distinct(terms(F.col("text")))).alias("asked")).where(F.size("asked") > 0).select("query_id", F.array_join("asked", " ").alias("asked"))
    distinct = asked.select("asked").distinct()
    wanted = distinct.select("asked", F.explode(F.split("asked", " ")).alias("term"))
    found_in = active.select(F.explode(F.array_distinct(F.concat(*BOOST))).alias("term")).groupBy("term").agg(F.count("*").alias("found_in"))
    weight = F.pow(1 + F.log(active.agg(F.count("*").alias("n")).scalar() / F.col("found_in")), 2)
    weighed = wanted.join(found_in, "term").groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("w"))  # the terms of one query
    groups, blocks = (F.greatest(df.agg(F.ceil(F.count("*") / size)).scalar(), F.lit(1)) for df, size in ((active, GROUP), (distinct, BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = active.select("memory_uid", "chunk_ordinal", *[F.array_join(f, " ").alias(f) for f in BOOST], F.pmod(F.xxhash64("memory_uid", "chunk_ordinal"), groups).alias("group"), every(blocks).alias("block"))
    right = weighed.select("asked", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights"), F.pmod(F.xxhash64("asked"), blocks).alias("block"), every(groups).alias("group"))
    kinds = [(c, active.schema[c].dataType.simpleString()) for c in ("memory_uid", "chunk_ordinal")]
    schema = "asked string, " + ", ".join(f"{c} {t}" for c, t in kinds) + ", score double"
    scored = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(_best_chunks(limit), schema)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "memory_uid", "chunk_ordinal")
    top = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    best = Window.partitionBy("asked", "memory_uid").orderBy(F.desc("score"), "chunk_ordinal")
    top = top.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return asked.join(top, "asked").select("query_id", "memory_uid", "chunk_ordinal", "score")


def _best_chunks(limit: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(asked, memory_uid, chunk_ordinal, score): of each query in one table the best chunks in the other."""

    def work(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        chunks = chunks.take(pc.sort_indices(chunks, sort_keys=[("memory_uid", "ascending"), ("chunk_ordinal", "ascending")], null_placement="at_start"))
        places: dict[str, tuple[list[int], list[float]]] = {t: ([], []) for terms in asked.column("terms").to_pylist() for t in terms}
        for row, fields in enumerate(zip(*[chunks.column(f).to_pylist() for f in BOOST], strict=True)):  # terms are of letters and digits
            held: dict[str, float] = {}
            for boost, words in zip(BOOST.values(), fields, strict=True):
                words = words.split()
                for word, times in Counter(words).items():
                    if word in places:
                        held[word] = held.get(word, 0.0) + boost * math.sqrt(times) / math.sqrt(len(words))
            for word, h in held.items():
                places[word][0].append(row)
                places[word][1].append(h)
        found = {t: (np.array(r, dtype=np.int64), np.array(h)) for t, (r, h) in places.items()}
        names, rows, scores = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for name, terms, weights in zip(*[asked.column(c).to_pylist() for c in ("asked", "terms", "weights")], strict=True):
            total = np.zeros(chunks.num_rows)
            for t, w in zip(terms, weights, strict=True):
                at, h = found[t]
                total[at] += h * w
            hit = np.flatnonzero(total)
            score = np.floor(total[hit] * 1e6 + 0.5) / 1e6
            if len(hit) > limit:
                enough = score >= np.partition(score, len(hit) - limit)[len(hit) - limit]
                hit, score = hit[enough], score[enough]
            first = np.lexsort((hit, -score))[:limit]
            names += [name] * len(first)
            rows.append(hit[first])
            scores.append(score[first])
        kept = chunks.select(["memory_uid", "chunk_ordinal"]).take(pa.array(np.concatenate(rows)))
        return pa.table({"asked": pa.array(names, pa.string()), "memory_uid": kept.column(0), "chunk_ordinal": kept.column(1), "score": pa.array(np.concatenate(scores))})

    return work


def search(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(memory_uid, chunk_ordinal, score): ``searches`` for one query."""
    one = chunks.sparkSession.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("text"))
    return searches(chunks, one, limit).select("memory_uid", "chunk_ordinal", "score")


def replaced(texts: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Adds ``matches`` and ``new_text`` to texts with a match."""
    return texts.where(F.col("text").rlike(pattern)).withColumn("matches", F.regexp_count("text", F.lit(pattern))).withColumn("new_text", F.regexp_replace("text", pattern, replacement))


def slug(title):
    """Lower case, runs of anything but letters and digits as one dash, at most 50 characters, no dash at the ends."""
    dashed = F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 50), "-$", "")
