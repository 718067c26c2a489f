import pytest
from pyspark.sql import functions as F

from spanlode.functions import kinds, paths
from spanlode.operators import graph, membership, navigation, resolution
from spanlode.plans.runtime import written
from tests.conftest import rows

USAGES = "usage_id long, project_id long, file_id long, path string, lang string, name string, kind string, context_container string, relation string, receiver_type string, target_type string, start_line int, start_col int, end_line int"
DEFINITIONS = "def_id long, project_id long, file_id long, path string, lang string, name string, kind string, container string, start_line int, start_col int, end_line int, end_col int"


def tables(spark):
    use = lambda i, name, lang="go", project=1, file=2: (i, project, file, f"b/{file}.go", lang, name, "call", "", "", "", "", 10 + i % 7, 1, 10 + i % 7)
    usages = [use(1, "f"), use(2, "f"), use(2, "f"), use(3, "f", "java"), use(4, "f", project=9), use(5, "g", file=1), *(use(100 + i, f"undefined{i}") for i in range(200))]
    usages += [use(6, "f"), use(6, "nowhere"), use(7, None), use(8, "f", None)]  # of copies that differ the one that sorts last counts
    definitions = [(1, 1, 1, "b/1.go", "go", "f", "function", "", 5, 1, 30, 2), (2, 1, 3, "c/3.go", "go", "g", "function", "", 5, 1, 9, 2), (None, 1, 3, "c/3.go", "go", "undefined1", "function", "", 5, 1, 9, 2)]
    return spark.createDataFrame(usages, USAGES), spark.createDataFrame(definitions, DEFINITIONS)


@pytest.mark.parametrize("name", ["file_graph", "graph_metrics"])
def test_only_usages_of_defined_names_are_carried_on(spark, monkeypatch, name):
    carried, inbound = [], graph.inbound_edges
    monkeypatch.setattr(graph, "inbound_edges", lambda u, *more: carried.append(u) or inbound(u, *more))
    getattr(graph, name)(*tables(spark)).collect()
    assert rows(carried[0], "usage_id") == [(1,), (2,), (5,)]


def test_edges_of_defined_names(spark):
    got = rows(graph.file_graph(*tables(spark)), "name", "from_path", "to_path", "n_usages")
    assert got == [("f", "b/1.go", "c/3.go", 1), ("f", "b/2.go", "b/1.go", 2), ("g", "b/1.go", "c/3.go", 1)]


def many(spark):
    """30,000 usages with 300 copies, a third of them of defined names."""
    name = lambda i: f"f{i % 700}" if i % 3 == 0 else f"undefined{i % 9000}"
    use = lambda i: (i, i % 5, i % 400, f"d{i % 20}/{i % 400}.go", "go", name(i), ("call", "read", "type_ref")[i % 7 % 3], "" if i % 5 else f"C{i % 4}", "", "", "", i % 97, i % 40, i % 97)
    usages = [*map(use, range(30_000)), *map(use, range(0, 30_000, 100))]
    definitions = [(i, i % 5, i % 400, f"d{i % 20}/{i % 400}.go", "go", f"f{i % 700}", ("function", "class", "variable")[i % 3], "" if i % 3 else f"C{i % 4}", i % 90, 1, i % 90 + 9, 2) for i in range(3000)]
    return spark.createDataFrame(usages, USAGES), spark.createDataFrame(definitions, DEFINITIONS)


def exchanged(spark):
    """Bytes exchanged by the session so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_metrics_exchange_few_bytes(spark):
    """Whole usages of defined names only, by symbol and by place; of the others the id."""
    usages, definitions = (written(t) for t in many(spark))
    before = exchanged(spark)
    graph.graph_metrics(usages, definitions).collect()
    assert exchanged(spark) - before < 80 * 30_000


def test_metrics_of_symbols_with_many_usages(spark, monkeypatch):
    tables = many(spark)
    plain = sorted(graph.graph_metrics(*tables).collect())
    monkeypatch.setattr(resolution, "MANY", 10)
    monkeypatch.setattr(resolution, "HOT", 1 / 1000)
    assert sorted(graph.graph_metrics(*tables).collect()) == plain and sum(r["inbound_usages"] for r in plain) > 4000


def test_scores_agree_with_pairs(spark):
    """The share of the first definition, from every pair of a usage and a candidate."""
    usages, definitions = many(spark)
    usages = usages.distinct().where("usage_id % 3 = 0 and usage_id < 6000")
    u, d = (t.withColumn("dir", paths.directory(F.col("path"))) for t in (usages, definitions))
    d = d.select("project_id", "name", "lang", F.col("file_id").alias("f"), F.col("dir").alias("p"), "container", F.col("kind").alias("k"), navigation.in_order().alias("o"))
    place = F.when(F.col("f") == F.col("file_id"), 12).when(F.col("p") == F.col("dir"), 6).otherwise(4)
    box = F.when((F.col("context_container") != "") & (F.col("context_container") == F.col("container")), 3).otherwise(2)
    fit = F.when(F.col("kind") == "call", F.when(F.col("k") == "function", 25).otherwise(6)).when(F.col("kind") == "type_ref", F.when(F.col("k") == "class", 25).otherwise(6)).otherwise(F.when(F.col("k") == "variable", 15).otherwise(8))
    pairs = u.join(d, ["project_id", "name", "lang"]).withColumn("w", place * box * fit).groupBy("usage_id").agg(F.min(F.struct("o", "w")).alias("b"), F.sum("w").alias("t"))
    want = pairs.select("usage_id", F.col("b.o.def_id").alias("primary_def_id"), kinds.rounded(F.col("b.w") / F.col("t")).alias("score"))
    cols = ["usage_id", "primary_def_id", "score"]
    got = rows(resolution.primary_scores(usages, definitions), *cols)
    assert got == rows(want, *cols) and len(got) > 1000


def test_each_once_keeps_the_last_of_copies_that_differ(spark):
    rest = [(i, f"x{i}") for i in range(2000)]
    df = spark.createDataFrame([*rest, (7, "y"), (7, "a"), (8, "x8"), (None, "n")], "id long, v string")
    got = rows(membership.each_once(df, "id"), "id", "v")
    assert got == sorted([(i, "y" if i == 7 else v) for i, v in rest])
    assert rows(membership.each_once(df, "id", F.col("v").isin("x7", "x8", "x9")), "id", "v") == [(8, "x8"), (9, "x9")]


def test_may_hold_misses_no_key(spark):
    keys = spark.range(50_000).select(F.col("id").alias("k"))
    assert keys.where(membership.may_hold(keys, "k", rows=50_000)).count() == 50_000
    others = spark.range(100_000, 200_000).select(F.col("id").alias("k"))
    assert others.where(membership.may_hold(keys, "k", rows=50_000)).count() < 5000
    assert others.where(membership.may_hold(keys.limit(0), "k", rows=0)).count() == 0
