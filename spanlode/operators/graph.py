"""Dependency edges between files and symbols, for all symbols at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlode.functions import kinds
from spanlode.functions.paths import directory
from spanlode.operators.membership import each_once, may_hold
from spanlode.operators.navigation import DEFINITION, USAGE, definitions_once, in_order, primary_of, usages_once
from spanlode.operators.resolution import dealt, primary_scores, whole_symbol
from spanlode.plans.runtime import written

SYMBOL = ["project_id", "name", "lang"]
LEAST = 0.2
BIN = 64
_META = ["kind", "relation", "receiver_type", "target_type"]


def coupled(usages: DataFrame) -> DataFrame:
    """Each usage once with its coupling strength as ``score``."""
    return usages_once(usages).withColumn("score", kinds.coupling(F.col("kind"), F.col("relation")))


def of_defined_names(usages: DataFrame, definitions: DataFrame) -> DataFrame:
    """Usages once, without nearly all of those of names that have no definition in their project and language.

    They are told by hashes while the table is read, so only rows that may have copies are exchanged. A usage whose
    hash agrees with that of another name stays; whoever joins by name leaves it out."""
    defined = may_hold(definitions.where(F.col("def_id").isNotNull()), *SYMBOL, rows=definitions.count())
    return each_once(usages.select(*USAGE), "usage_id", defined)


def inbound_edges(usages: DataFrame, definitions: DataFrame, least: float = LEAST, lines: DataFrame | None = None, told: bool = True) -> DataFrame:
    """Per symbol with a definition and file that uses it: usages, highest score, and what the usage of that score is
    (of equals the first by place and id). The score is the primary definition's share of the candidates' weight.

    Usages under ``least`` don't count. A symbol that would have none left keeps one usage a file, the highest. Both
    ways follow from one aggregation per symbol and file; the flag that decides between them is a window over a symbol's
    files. Without ``told`` both tables have every id once, and what the usage is, is left out.
    """
    scored = primary_scores(usages_once(usages), definitions_once(definitions), lines) if told else primary_scores(usages, definitions, lines)
    order = F.struct("score", (-F.col("start_line")).alias("l"), (-F.col("start_col")).alias("c"), (-F.col("usage_id")).alias("i"))
    best = F.max(F.struct(order.alias("o"), "primary_path", *_META)) if told else F.max(F.struct(F.struct("score").alias("o"), "primary_path"))
    passes = F.sum((F.col("score") >= least).cast("long")).alias("passing")
    edges = scored.groupBy(*SYMBOL, "path").agg(passes, best.alias("b")).withColumn("some", F.max(F.col("passing") > 0).over(Window.partitionBy(*SYMBOL)))
    n = F.when(F.col("some"), F.col("passing")).otherwise(F.lit(1).cast("long"))
    met = edges.where((F.col("passing") > 0) | ~F.col("some"))
    return met.select(*SYMBOL, "path", F.col("b.primary_path").alias("to_path"), n.alias("n_usages"), F.col("b.o.score").alias("max_score"), *[F.col(f"b.{c}").alias(c) for c in _META if told])


def _targets(definitions: DataFrame, more: list[str], name: str) -> DataFrame:
    return definitions.groupBy(*SYMBOL, *more).agg(F.min("o").alias(name))


def outbound_edges(usages: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per definition and name used within its lines: usages, what the first usage of the highest rank is, 1/sqrt of
    the candidates of the name as score, and the target: the first candidate in the same file, else in the same
    directory, else of all. A definition's own name doesn't count, nor do names without a definition.

    The range join meets on file and bins of ``BIN`` lines. Both sides are reduced first: usages to counts per file,
    line and name, definitions to distinct spans, so copies and crowded lines don't multiply. Targets are looked up in
    three aggregates of the definitions; no usage meets all candidates of its name.
    """
    d = definitions_once(definitions).where(F.col("start_line").isNotNull())
    spans = d.select("file_id", "start_line", F.greatest("end_line", "start_line").alias("end_line")).distinct()
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))))
    rank = F.struct(kinds.outbound_rank(F.col("kind")).alias("p"), (-F.col("start_line")).alias("l"), (-F.col("start_col")).alias("c"), (-F.col("usage_id")).alias("i"))
    marks = usages_once(usages).groupBy("project_id", "file_id", "lang", "name", F.col("start_line").alias("line")).agg(F.count("*").alias("n"), F.max(F.struct(rank.alias("r"), "path", *_META)).alias("k"))
    marks = marks.withColumn("bin", F.floor(F.col("line") / BIN))
    met = binned.join(marks, ["file_id", "bin"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    per_span = met.groupBy("project_id", "file_id", "start_line", "end_line", "lang", "name").agg(F.sum("n").alias("n_usages"), F.max("k").alias("k")).withColumn("dir", directory(F.col("k.path")))
    placed = definitions_once(definitions).withColumn("dir", directory(F.col("path"))).withColumn("o", in_order())
    candidates = placed.groupBy(*SYMBOL).agg(F.count("*").alias("candidates"), F.min("o").alias("t3"))
    found = per_span.join(candidates, SYMBOL).join(_targets(placed, ["file_id"], "t1"), [*SYMBOL, "file_id"], "left").join(_targets(placed, ["dir"], "t2"), [*SYMBOL, "dir"], "left")
    scored = found.withColumn("t", F.coalesce("t1", "t2", "t3")).select(
        "file_id", "start_line", "end_line", F.col("name").alias("used_name"), "n_usages", *[F.col(f"k.{c}").alias(f"used_{c}") for c in _META],
        F.round(1 / F.sqrt(F.col("candidates")), 6).alias("score"), F.col("t.def_id").alias("target_def_id"), F.col("t.path").alias("target_path"),
    )
    own = d.select("def_id", "name", "file_id", "start_line", F.greatest("end_line", "start_line").alias("end_line"))
    out = own.join(scored, ["file_id", "start_line", "end_line"]).where(F.col("name") != F.col("used_name"))
    return out.select("def_id", "used_name", "n_usages", *[F.col(f"used_{c}").alias(c) for c in _META], "score", "target_def_id", "target_path")


def _outbound_of(of: DataFrame, usages: DataFrame, definitions: DataFrame) -> DataFrame:
    """The outbound edges of the definitions ``of``, without what their usages are; all tables have every id once.

    Usages are exchanged once by file and bin, edges once by the symbol they name, with its definitions: candidates and
    targets are windows there."""
    d = of.where(F.col("start_line").isNotNull()).select("def_id", "file_id", F.col("name").alias("own"), directory(F.col("path")).alias("dir"), "start_line", F.greatest("end_line", "start_line").alias("end_line"))
    binned = d.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))))
    placed = usages.withColumn("bin", F.floor(F.col("start_line") / BIN)).repartition("file_id", "bin")
    marks = placed.groupBy("file_id", "bin", *SYMBOL, F.col("start_line").alias("line")).agg(F.count("*").alias("n"))
    met = binned.join(marks, ["file_id", "bin"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")) & (F.col("name") != F.col("own")))
    named = met.where(whole_symbol()).groupBy("file_id", "bin", "dir", "def_id", *SYMBOL).agg(F.sum("n").alias("n")).select("file_id", "dir", "def_id", *SYMBOL, "n")
    candidates = definitions.where(whole_symbol()).select(*SYMBOL, "file_id", in_order().alias("o"))
    named, candidates, by = dealt(named, candidates, "def_id", usages)
    rows = named.unionByName(candidates, allowMissingColumns=True).repartition(*by).withColumn("dir", F.coalesce("dir", directory(F.col("o.path"))))
    for name, more in (("t1", ["file_id"]), ("t2", ["dir"]), ("t3", [])):
        rows = rows.withColumn(name, F.min("o").over(Window.partitionBy(*by, *more)))
    rows = rows.withColumn("candidates", F.count("o").over(Window.partitionBy(*by))).where(F.col("def_id").isNotNull() & (F.col("candidates") > 0))
    near = [F.when(F.col(c).isNotNull(), F.col(t)) for c, t in (("file_id", "t1"), ("dir", "t2"))]
    edges = rows.withColumn("t", F.coalesce(*near, "t3")).groupBy(*by, "def_id").agg(F.sum("n").alias("n_usages"), F.min("t").alias("t"), F.min("candidates").alias("candidates"))
    return edges.select("def_id", F.col("name").alias("used_name"), "n_usages", F.round(1 / F.sqrt(F.col("candidates")), 6).alias("score"), F.col("t.path").alias("target_path"))


def _mean(score: str, unit: int):
    """The average to four places, from a sum of whole numbers: the same in whatever order the scores come."""
    return F.round(F.sum(F.round(F.col(score) * unit).cast("long")) / (F.count("*") * F.lit(unit // 10_000))) / 10_000


def _graph_of_primaries(usages: DataFrame, definitions: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = written(each_once(definitions.select(*DEFINITION), "def_id"))
    first = written(primary_of(d).select(*SYMBOL, "def_id", "file_id", "path", "start_line", "end_line"))
    u = of_defined_names(usages, first)
    outward = _outbound_of(first, u, d).join(first.select(*SYMBOL, "def_id", F.col("path").alias("at_path")), "def_id")
    return first, inbound_edges(u, d, least, None, False), outward


def file_graph(usages: DataFrame, definitions: DataFrame, least: float = LEAST) -> DataFrame:
    """Per symbol the edges between files: from those that use it to that of its primary definition, and from there to
    those of the names it uses: usages and highest score, four places. Edges of a file to itself are left out."""
    _, inward, outward = _graph_of_primaries(usages, definitions, least)
    cols = lambda a, b, s: [*SYMBOL, F.col(a).alias("from_path"), F.col(b).alias("to_path"), "n_usages", F.col(s).alias("score")]
    edges = inward.select(*cols("path", "to_path", "max_score")).unionByName(outward.select(*cols("at_path", "target_path", "score")))
    edges = edges.where(F.col("from_path") != F.col("to_path"))
    return edges.groupBy(*SYMBOL, "from_path", "to_path").agg(F.sum("n_usages").alias("n_usages"), kinds.rounded(F.max("score")).alias("max_score"))


def graph_metrics(usages: DataFrame, definitions: DataFrame, least: float = LEAST) -> DataFrame:
    """Per symbol with a definition: inbound files, usages and impact (average score of the inbound edges), outbound
    names, files and coupling (average score of its primary definition's outbound edges); 0 without edges."""
    first, inward, outward = _graph_of_primaries(usages, definitions, least)
    inbound = inward.groupBy(*SYMBOL).agg(F.count("*").alias("inbound_files"), F.sum("n_usages").alias("inbound_usages"), _mean("max_score", 10_000).alias("impact"))
    outbound = outward.groupBy("def_id").agg(F.count("*").alias("outbound_names"), F.count_distinct("target_path").alias("outbound_files"), _mean("score", 1_000_000).alias("coupling"))
    out = first.join(inbound, SYMBOL, "left").join(outbound, "def_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    mean = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select(*SYMBOL, zero("inbound_files"), zero("inbound_usages"), mean("impact"), zero("outbound_names"), zero("outbound_files"), mean("coupling"))
