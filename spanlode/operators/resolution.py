"""Which definition a usage means, for all usages at once.

A candidate's weight is a product: 3 in the same file, 1.5 in the same directory; 1.5 in the same container; the fit of
the kinds. With f, d, c as 0 or 1 the place and container part is

    (1 + 0.5 d + 1.5 f) (1 + 0.5 c) = 1 + 0.5 d + 1.5 f + 0.5 c + 0.25 d c + 0.75 f c

(the factor of a usage's relation is the same for all candidates and cancels) so a usage's total weight is a sum over six counts per kind of definition: of its name, and of its name within the
file, directory, container, and the last with each of the first two. Each count is an aggregate with at most one entry
per kind, joined by equality; no pair of a usage and a candidate is ever made, however many a hot name has of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlode.functions import kinds
from spanlode.functions.paths import directory
from spanlode.operators.navigation import definitions_once, in_order, primary_definitions, usages_once
from spanlode.plans.runtime import salt_of

SYMBOL = ["project_id", "name", "lang"]
#: (columns besides the symbol, factor in the sum, weight of a candidate that agrees in just these), both times 8.
PARTS = [((), 8, 8), (("dir",), 4, 12), (("file_id",), 12, 24), (("box",), 4, 12), (("dir", "box"), 2, 18), (("file_id", "box"), 6, 36)]


def _fit(order):
    """Both factors as a whole number: weights add up exactly, in whatever order."""
    table = F.split(F.lit(" ".join(map(str, kinds.FACTORS))), " ").cast("array<long>")  # folded to one literal
    return F.get(table, F.col("_place") + order)


def _weighed(weight: int):
    return lambda x: F.struct((-F.lit(weight) * _fit(x["kind"])).alias("w"), x["o"].alias("o"))


def _placed(u: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Usages with ``_place``, where the factors of their kind and of their source line's class begin."""
    out, cls = u, F.lit(0)
    if lines is not None:
        at = lines.select(F.col("file_id"), F.col("line_no").alias("start_line"), "line")
        out, cls = u.join(at, ["file_id", "start_line"], "left"), kinds.line_class(F.col("line"), F.col("name"))
    return out.withColumn("_place", kinds.place(F.col("kind"), cls)).drop("line")


def _weighed_usages(usages: DataFrame, definitions: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Usages once with dir, box, _place, ``candidates``, ``_total`` (the candidates' weight) and ``_best``."""
    d = definitions_once(definitions).select(*SYMBOL, "file_id", directory(F.col("path")).alias("dir"), F.col("container").alias("box"), kinds.kind_order(F.col("kind")).alias("kind"), in_order().alias("o"))
    u = usages_once(usages).withColumn("dir", directory(F.col("path"))).withColumn("box", F.nullif("context_container", F.lit("")))
    bests, drop = [], []
    out = _placed(u, lines).withColumn("_total", F.lit(0).cast("long"))
    for i, (more, factor, weight) in enumerate(PARTS):
        cols = [*SYMBOL, *more]
        rows = d.where(F.coalesce(F.col("box"), F.lit("")) != "") if "box" in more else d
        by_kind = rows.groupBy(*cols, "kind").agg(F.count("*").alias("n"), F.min("o").alias("o"))
        table = by_kind.groupBy(*cols).agg(F.collect_list(F.struct("kind", "n", "o")).alias(f"p{i}"))  # one entry a kind, 16 at most
        out = out.join(table, cols, "left")
        held = F.coalesce(F.col(f"p{i}"), F.array().cast(table.schema[f"p{i}"].dataType))
        out = out.withColumn("_total", F.col("_total") + F.lit(factor) * F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x["n"] * _fit(x["kind"])))
        if not more:
            out = out.withColumn("candidates", F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x["n"]))
        bests.append(F.transform(held, _weighed(weight)))
        drop.append(f"p{i}")
    return out.withColumn("_best", F.array_min(F.flatten(F.array(*bests)))).drop(*drop)


def resolved_usages(usages: DataFrame, definitions: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Each usage with ``candidates``, ``confidence`` (the best candidate's share of the weight, four places) and
    ``best_def_id`` (of equals the first by kind, path and place). Without candidates: 0, 0.0 and null.

    Only definitions of the usage's project, name and language are candidates. Empty or null containers agree with
    nothing. With ``lines`` (file_id, line_no, line) the
    class of the usage's source line counts as a factor too; a line that isn't there counts as 1.
    """
    out = _weighed_usages(usages, definitions, lines)
    share = F.when(F.col("candidates") > 0, kinds.rounded(-F.col("_best.w") / F.col("_total"))).otherwise(0.0)
    return out.withColumn("confidence", share).withColumn("best_def_id", F.col("_best.o.def_id")).drop("_total", "_best", "_place", "dir", "box")


def _alike() -> list[list[int]]:
    """Kinds of definitions, by their order, in classes that have the same factors wherever they are used."""
    n, classes = len(kinds.DEFINITION_KINDS), {}
    for k in range(n):
        classes.setdefault(tuple(kinds.FACTORS[k::n]), []).append(k)
    return list(classes.values())


#: Usages are counted in so many buckets of symbols; one with more than a share of ``HOT``, and ``MANY``, is dealt to ``SALTS`` tasks.
BUCKETS, HOT, MANY, SALTS = 4096, 1 / 50, 100_000, 16


def whole_symbol() -> Column:
    """Rows whose symbol can agree with another's."""
    return F.col("project_id").isNotNull() & F.col("name").isNotNull() & F.col("lang").isNotNull()


def dealt(u: DataFrame, d: DataFrame, spread: str, counted: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Usages, definitions and the columns to exchange both by: those of a symbol or, where a bucket of symbols has many
    of the usages ``counted``, a salt too, by the column ``spread`` of ``u``; there, definitions go with every salt."""
    bucket = F.pmod(F.xxhash64(*SYMBOL), F.lit(BUCKETS))
    counts = counted.groupBy(bucket.alias("b")).count().collect()
    least = max(MANY, HOT * sum(r["count"] for r in counts))
    hot = [r["b"] for r in counts if r["count"] > least]
    if not hot:
        return u, d, SYMBOL
    is_hot = bucket.isin(hot)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return u.withColumn("_salt", F.when(is_hot, salt_of(spread, salts=SALTS)).otherwise(0)), d.withColumn("_salt", F.explode(salts)), [*SYMBOL, "_salt"]


def primary_scores(usages: DataFrame, definitions: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Usages of symbols that have a definition, with the primary one (``primary_def_id``, ``primary_path``) and
    ``score``: that definition's share of the weight of all candidates, four places. Both tables have every id once.

    The primary's own weight needs no other candidate: it follows from the usage's row and the one row of its symbol.
    Usages and definitions are exchanged once, by symbol; the counts of definitions that make up the total are then
    windows within a symbol."""
    d = definitions.where(whole_symbol()).select(*SYMBOL, "file_id", F.col("container").alias("context_container"), in_order().alias("_d"))
    u, d, by = dealt(usages.where(whole_symbol()), d, "path", usages)
    u = _placed(u, lines).select(*usages.columns, "_place", *by[len(SYMBOL) :])
    rows = u.unionByName(d, allowMissingColumns=True).repartition(*by).withColumn("dir", directory(F.coalesce("path", "_d.path"))).withColumn("box", F.nullif("context_container", F.lit("")))
    rows = rows.withColumn("_total", F.lit(0).cast("long"))
    classes = _alike()
    for i in (4, 1, 0, 5, 2, 3):  # three of these are in the order of the one before them
        more, factor, _ = PARTS[i]
        within = Window.partitionBy(*by, *more)
        counted = {f"_n{j}": F.sum(F.when(F.col("_d.o").isin(of), 1)).over(within) for j, of in enumerate(classes)}
        if not more:
            counted["_p"] = F.min(F.when(F.col("_d").isNotNull(), F.struct("_d", "file_id", "dir", "box"))).over(within)
        weight = F.lit(0).cast("long")
        for j, of in enumerate(classes):
            weight += F.coalesce(F.col(f"_n{j}"), F.lit(0)) * _fit(of[0])
        for c in more:
            weight = F.when(F.col(c).isNotNull(), weight).otherwise(0)
        rows = rows.withColumns(counted).withColumn("_total", F.col("_total") + F.lit(factor) * weight).drop(*[c for c in counted if c != "_p"])
    rows = rows.where(F.col("_d").isNull() & F.col("_p").isNotNull())
    place = F.when(F.col("file_id") == F.col("_p.file_id"), 12).when(F.col("dir") == F.col("_p.dir"), 6).otherwise(4)
    box = F.when(F.col("box") == F.col("_p.box"), 3).otherwise(2)
    score = kinds.rounded((place * box * _fit(F.col("_p._d.o"))).cast("double") / F.col("_total"))
    return rows.select(*usages.columns, F.col("_p._d.def_id").alias("primary_def_id"), F.col("_p._d.path").alias("primary_path"), score.alias("score"))


def filtered_usages(usages: DataFrame, definitions: DataFrame, least: float = 0.55) -> DataFrame:
    """Usages of each symbol that are meant: noisy paths go where the symbol's primary definition lies on a clean path;
    where there are two candidates or more, those stay whose best definition is the primary one with at least ``least``.
    A step that would leave a symbol without usages is skipped for it."""
    first = primary_definitions(definitions).select(*SYMBOL, F.col("def_id").alias("primary_def_id"), (~kinds.is_noisy(F.col("path"))).alias("primary_clean"))
    rows = resolved_usages(usages, definitions).join(first, SYMBOL)
    rows = rows.withColumn("stays1", ~(F.col("primary_clean") & kinds.is_noisy(F.col("path"))))
    rows = rows.withColumn("stays2", (F.col("candidates") < 2) | ((F.col("confidence") >= least) & (F.col("best_def_id") == F.col("primary_def_id"))))
    flags = rows.groupBy(*SYMBOL).agg(F.max("stays1").alias("any1"), F.max(F.col("stays1") & F.col("stays2")).alias("both"), F.max("stays2").alias("any2"))
    rows = rows.join(flags, SYMBOL)
    one = F.col("stays1") | ~F.col("any1")
    some2 = F.when(F.col("any1"), F.col("both")).otherwise(F.col("any2"))
    return rows.where(one & (F.col("stays2") | ~some2)).drop("stays1", "stays2", "any1", "both", "any2", "primary_clean")
