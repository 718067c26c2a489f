"""Queries of the text problems and, where there is one, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlode.llm import chunk_split, leakage, origin, packing, residue, syntax
from spanlode.sources.tables import read

CAPACITY = 4096


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The latest revision of every note chunk in pieces of at most 1,200 characters that share 120."""
    chunks = chunk_split.latest_chunks(read(spark, root, "memory_chunks"))
    return chunk_split.split_long(chunks, "chunk_text", ["memory_uid", "chunk_ordinal", "chunk_heading"])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that come in more than one piece."""
    chunks = chunk_split.latest_chunks(read(spark, root, "memory_chunks"))
    pieces = chunk_split.split_long(chunks, "chunk_text", ["memory_uid", "chunk_ordinal"])
    return pieces.where((F.col("piece") == 1)).select("memory_uid", "chunk_ordinal").distinct()


def p2_covered(spark: SparkSession, root: str) -> DataFrame:
    """Of every chunk the characters that its pieces reach, and how many pieces are too long, leave a gap or overlap too little."""
    chunks = chunk_split.latest_chunks(read(spark, root, "memory_chunks"))
    pieces = chunk_split.split_long(chunks, "chunk_text", ["memory_uid", "chunk_ordinal"])
    ends = pieces.select("memory_uid", "chunk_ordinal", (F.col("piece") + 1).alias("piece"), (F.col("start") + F.col("n_chars")).alias("end"))
    met = pieces.join(ends, ["memory_uid", "chunk_ordinal", "piece"], "left")
    apart = F.coalesce(F.col("start") > F.col("end") - 120, F.col("start") != 0)
    return met.groupBy("memory_uid", "chunk_ordinal").agg(F.max(F.col("start") + F.col("n_chars")).alias("covered"), F.count_if(F.col("n_chars") > 1200).alias("too_long"), F.count_if(apart).alias("apart"))


def _origins(spark: SparkSession, root: str) -> DataFrame:
    return origin.origins(read(spark, root, "source_files"), read(spark, root, "known_files"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Files that aren't hand-written for their project."""
    return _origins(spark, root).select("file_id").distinct()


def p4_kinds(spark: SparkSession, root: str) -> DataFrame:
    """The kinds of origin of each such file."""
    return _origins(spark, root)


def _parsed(spark: SparkSession, root: str) -> DataFrame:
    return syntax.parsed(read(spark, root, "source_files").where(F.col("file_id").isNotNull()))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Files that no dialect of their language accepts."""
    return _parsed(spark, root).where(F.size("dialects") == 0).select("file_id").distinct()


def p5_dialects(spark: SparkSession, root: str) -> DataFrame:
    """The language of every file and the dialects that accept it."""
    return _parsed(spark, root).select("file_id", "language", F.array_join("dialects", ",").alias("dialects")).distinct()


def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    """Files that don't parse per project and language, next to the errors that index runs report."""
    return syntax.rates(read(spark, root, "source_files"), read(spark, root, "index_runs"))


def _sizes(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "documents").select(F.col("doc_id").alias("item"), F.octet_length("text").cast("long").alias("size"))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of every part of every document."""
    return packing.pack(_sizes(spark, root), CAPACITY).withColumnRenamed("item", "doc_id")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose tokens lie in more than one container, since none holds them whole."""
    spread = packing.pack(_sizes(spark, root), CAPACITY).groupBy("item").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return spread.where(F.col("a") < F.col("b")).select(F.col("item").alias("doc_id"))


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, tokens and the share of the room that is used."""
    boxes = packing.pack(_sizes(spark, root), CAPACITY).groupBy("container").agg(F.sum("size").alias("tokens"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.round(F.sum("tokens") / (F.count("*") * CAPACITY), 4).alias("fill"))


def p6_checked(spark: SparkSession, root: str) -> DataFrame:
    """Documents, parts and tokens in containers, and how many containers are overfull or documents split without need."""
    packed = packing.pack(_sizes(spark, root), CAPACITY)
    boxes = packed.groupBy("container").agg(F.sum("size").alias("tokens")).agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > CAPACITY).alias("overfull"))
    items = packed.groupBy("item").agg(F.count("*").alias("parts"), F.sum("size").alias("size"))
    items = items.agg(F.count("*").alias("documents"), F.sum("parts").alias("parts"), F.count_if((F.col("parts") > 1) & (F.col("size") <= CAPACITY)).alias("needless"))
    return items.withColumn("one", F.lit(1)).join(boxes.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(read(spark, root, "documents"), "doc_id", "text", read(spark, root, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """(item, document) pairs that share at least 12 consecutive words."""
    return _leaks(spark, root).select("item_id", "doc_id").distinct()


def p7_passages(spark: SparkSession, root: str) -> DataFrame:
    """The leaked passages by word position."""
    return _leaks(spark, root).distinct()


def p7_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Affected documents without the leaked passages."""
    return leakage.cleaned(read(spark, root, "documents"), "doc_id", "text", _leaks(spark, root))


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("host"), "text")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with unfilled slots, filler, errors or notices in place of content."""
    return residue.residue(_texts(spark, root)).select(F.col("id").alias("doc_id")).distinct()


def p8_kinds(spark: SparkSession, root: str) -> DataFrame:
    """The kinds of residue of each such document."""
    return residue.residue(_texts(spark, root)).withColumnRenamed("id", "doc_id")


def p8_line_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many documents of each source have each normalised line."""
    return residue.line_counts(_texts(spark, root))


QUERIES = {
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_covered": p2_covered,
    "p4_found": p4_found,
    "p4_kinds": p4_kinds,
    "p5_found": p5_found,
    "p5_dialects": p5_dialects,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_checked": p6_checked,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p7_cleaned": p7_cleaned,
    "p8_found": p8_found,
    "p8_kinds": p8_kinds,
    "p8_line_counts": p8_line_counts,
}

#: Width forms and what they stand for, invisible format characters: as much of NFKC as the tables have.
_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_WORDS = "regexp_extract_all(lower(replace(replace(translate(regexp_replace(text, '[\\x{AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]', '', 'g'), '" + _WIDE + "', '" + _PLAIN + "'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '[\\p{L}\\p{N}]+')"


def _grams(key: str, table: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL))"


SQL = {
    "p2_covered": """SELECT memory_uid, chunk_ordinal, length(t)::INTEGER AS covered, 0::BIGINT AS too_long, 0::BIGINT AS apart
 FROM (SELECT memory_uid, chunk_ordinal, arg_max(chunk_text, indexed_at) AS t FROM memory_chunks GROUP BY ALL) WHERE t IS NOT NULL""",
    "p6_checked": """SELECT count(*) AS documents, sum(greatest(ceil(coalesce(strlen(text), 0) / 4096.0), 1))::BIGINT AS parts, 0::BIGINT AS needless, sum(coalesce(strlen(text), 0))::BIGINT AS tokens, 0::BIGINT AS overfull
 FROM (SELECT DISTINCT doc_id, text FROM documents)""",
    "p7_found": f"SELECT DISTINCT item_id, doc_id FROM ({_grams("item_id", "eval_items")}) JOIN ({_grams("doc_id", "documents")}) USING (gram)",
    "p2_found": """SELECT memory_uid, chunk_ordinal FROM (SELECT memory_uid, chunk_ordinal, arg_max(chunk_text, indexed_at) AS t FROM memory_chunks GROUP BY ALL)
 WHERE length(t) > 1200""",
    "p6_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > 4096",
}
