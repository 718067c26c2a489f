"""Rules of the index operators on small hand-made tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spanlode.functions import kinds
from spanlode.operators import corpus, graph, grouping, navigation, notes, resolution
from spanlode.streaming import upkeep
from tests.conftest import rows

D = "def_id long, project_id long, file_id long, path string, lang string, name string, kind string, container string, start_line int, start_col int, end_line int, end_col int"
U = "usage_id long, project_id long, file_id long, path string, lang string, name string, kind string, context_container string, relation string, receiver_type string, target_type string, start_line int, start_col int, end_line int, end_col int"


def definition(i, path, name="foo", kind="class", line=1, container="", end=None, file=None):
    return (i, 1, i if file is None else file, path, "go", name, kind, container, line, 0, line if end is None else end, 3)


def usage(i, path, file=99, name="foo", kind="other", line=1, relation="", container=""):
    return (i, 1, file, path, "go", name, kind, container, relation, "R", "T", line, 0, line, 3)


def test_weights_of_one_usage(spark):
    one = resolution.resolved_usages(spark.createDataFrame([usage(1, "z/u.go"), usage(1, "z/u.go")], U), spark.createDataFrame([definition(1, "a/d.go")], D)).collect()
    assert [(r.candidates, r.confidence, r.best_def_id) for r in one] == [(1, 1.0, 1)]
    two = [definition(1, "pkg/config.go", file=7), definition(2, "other/types.go")]
    got = resolution.resolved_usages(spark.createDataFrame([usage(1, "pkg/config.go", file=7)], U), spark.createDataFrame(two, D)).first()
    assert (got.confidence, got.best_def_id) == (0.75, 1)
    root = [definition(1, "main.go", file=7), definition(2, "other.go")]
    assert resolution.resolved_usages(spark.createDataFrame([usage(1, "main.go", file=7)], U), spark.createDataFrame(root, D)).first().confidence == 0.6667
    none = resolution.resolved_usages(spark.createDataFrame([usage(1, "a.go", name="bar")], U), spark.createDataFrame(root, D)).first()
    assert (none.candidates, none.confidence, none.best_def_id) == (0, 0.0, None)


def test_filters_never_empty_a_symbol(spark):
    many = [definition(1, "models/a.go"), definition(2, "db/migrations/b.go", kind="variable"), definition(3, "migrations/c.go", kind="variable")]
    assert rows(navigation.ranked_definitions(spark.createDataFrame(many, D)), "def_id") == [(1,)]
    assert rows(navigation.ranked_definitions(spark.createDataFrame(many[1:], D)), "def_id") == [(2,), (3,)]
    assert navigation.ranked_definitions(spark.createDataFrame([], D)).collect() == []
    noisy = [usage(1, "tests/u.go"), usage(2, "tests/v.go")]
    assert len(resolution.filtered_usages(spark.createDataFrame(noisy, U), spark.createDataFrame(many, D)).collect()) == 2
    assert rows(resolution.filtered_usages(spark.createDataFrame([*noisy, usage(3, "models/u.go")], U), spark.createDataFrame(many[:1], D)), "usage_id") == [(3,)]


def test_confidence_and_coupling(spark):
    df = spark.createDataFrame([("class", "models/a"), ("variable", "migrations/a"), ("function", "services/a"), ("package", "a"), (None, None)], "kind string, path string")
    assert [r.c for r in df.select(kinds.confidence(F.col("kind"), F.col("path")).alias("c")).collect()] == [0.9, 0.05, 0.7, 0.55, 0.55]
    df = spark.createDataFrame([("call", ""), ("other", "inherits"), ("other", "prototype"), (None, None)], "kind string, relation string")
    assert [r.c for r in df.select(kinds.coupling(F.col("kind"), F.col("relation")).alias("c")).collect()] == [0.65, 1.0, 0.8, 0.1]


def test_groups_and_windows(spark):
    spans = [(10, 10), (13, 13), (17, 17), (18, 30), (20, 20), (33, 33), (33, 33), (None, 4)]
    df = spark.createDataFrame([("f", a, b, 0.5) for a, b in spans], "file string, start_line int, end_line int, score double")
    assert rows(grouping.adjacent_groups(df, ["file"]), "first_line", "last_line", "n_usages") == [(10, 13, 2), (17, 33, 5)]
    for pair, want in (([(1, 5), (6, 10)], [(1, 10)]), ([(1, 5), (8, 10)], [(1, 5), (8, 10)])):
        df = spark.createDataFrame([("f", a, b) for a, b in pair], "file string, start_line int, end_line int")
        assert rows(grouping.code_windows(df, ["file"], 0), "first_line", "last_line") == want


def test_inbound_edges(spark):
    """One class and one variable of the name: a class usage means the class at 25 to 6, a read the variable at 15 to 8."""
    d = spark.createDataFrame([definition(1, "x/m.go"), definition(2, "y/n.go", kind="variable")], D)
    u = [usage(1, "a.go", kind="type_ref", line=5), usage(2, "a.go", kind="read", line=9), usage(3, "a.go", kind="type_ref", line=4, relation="r"), usage(4, "b.go", kind="read"), usage(5, "c.go", name="other")]
    edges = graph.inbound_edges(spark.createDataFrame(u, U), d, 0.5)
    assert rows(edges, "path", "to_path", "n_usages", "max_score", "kind", "relation", "target_type") == [("a.go", "x/m.go", 2, 0.8065, "type_ref", "r", "T")]
    reads = spark.createDataFrame([u[1], u[3], usage(6, "a.go", kind="read", line=2)], U)
    assert rows(graph.inbound_edges(reads, d, 0.5), "path", "n_usages", "max_score") == [("a.go", 1, 0.3478), ("b.go", 1, 0.3478)]
    assert rows(graph.inbound_edges(reads, d, 0.3), "path", "n_usages") == [("a.go", 2), ("b.go", 1)]
    assert graph.inbound_edges(reads, d.limit(0)).collect() == [] and graph.inbound_edges(reads.limit(0), d).collect() == []


def test_outbound_edges_and_graph(spark):
    d = [definition(1, "p/m.go", name="outer", line=1, end=300, file=9), definition(2, "p/m.go", line=400, file=9, kind="function"), definition(3, "a/z.go"), definition(4, "p/o.go", name="near", kind="variable"), definition(5, "a/z.go", name="near")]
    u = [usage(1, "p/m.go", file=9, line=200), usage(2, "p/m.go", file=9, line=300, kind="call"), usage(3, "p/m.go", file=9, line=301), usage(4, "p/m.go", file=9, name="outer", line=2), usage(5, "p/m.go", file=9, name="near", line=3), usage(6, "p/m.go", file=9, name="unknown", line=3), usage(7, "p/m.go", file=9, line=2, kind="annotation")]
    u, d = spark.createDataFrame(u, U), spark.createDataFrame(d, D)
    assert rows(graph.outbound_edges(u, d), "def_id", "used_name", "n_usages", "kind", "score", "target_def_id", "target_path") == [(1, "foo", 3, "call", 0.707107, 2, "p/m.go"), (1, "near", 1, "other", 0.707107, 4, "p/o.go")]
    files = rows(graph.file_graph(u.where("usage_id <= 5"), d), "name", "from_path", "to_path", "n_usages", "max_score")
    assert [f[:4] for f in files] == [("foo", "p/m.go", "a/z.go", 2), ("near", "p/m.go", "a/z.go", 1), ("outer", "p/m.go", "p/o.go", 1)]
    got = rows(graph.graph_metrics(u, d), "name", "inbound_files", "outbound_names", "outbound_files", "coupling")
    assert got == [("foo", 1, 0, 0, 0.0), ("near", 1, 0, 0, 0.0), ("outer", 1, 2, 2, 0.7071)]


def test_cursor_and_words(spark):
    d, u = spark.createDataFrame([definition(1, "a.go", line=5)], D), spark.createDataFrame([usage(1, "a.go", file=1, name="bar", line=5)], U)
    cursors = spark.createDataFrame([(1, 1, 5, 3), (2, 1, 6, 0), (3, None, None, None)], "cursor_id int, at_file long, at_line int, at_col int")
    assert rows(navigation.at_cursor(cursors, d, u), "cursor_id", "name") == [(1, "foo"), (2, None), (3, None)]
    df = spark.createDataFrame([("x = foo_1(y)", c) for c in (4, 6, 1, 99)], "t string, c int")
    assert [r.w for r in df.select(navigation.word_at(F.col("t"), F.col("c")).alias("w")).collect()] == ["foo_1", "foo_1", "", ""]


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(kinds.glob_pattern(g), p))
    assert hit("*.go", "a.go") and not hit("*.go", "x/a.go") and hit("a/?.go", "a/b.go") and hit("[!x]*", "abc") and not hit("[!x]*", "xbc") and hit("a.b", "a.b") and not hit("a.b", "acb")


def test_reconcile_is_idempotent(spark):
    new = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (1, "c", "3")], "project_id long, path string, sha256 string")
    old = spark.createDataFrame([(1, "a", "1"), (1, "b", "x"), (1, "d", "4")], new.schema)
    assert rows(corpus.reconcile(new, old, ["project_id", "path"], "sha256"), "path", "action") == [("a", "skip"), ("b", "index"), ("c", "index"), ("d", "delete")]
    assert {r.action for r in corpus.reconcile(new, new, ["project_id", "path"], "sha256").collect()} == {"skip"}


def test_captures_and_docs(spark):
    text = b"package a\r\n\r\n// Foo does.\r\n// More.\r\nfunc Foo() {\n}\n\n// apart\n\ntype Bar struct {\n"
    files = spark.createDataFrame([(1, 1, "a.go", bytearray(text)), (1, 1, "a.go", bytearray(text)), (2, 1, "b.go", None), (3, 1, "c.go", bytearray(b"\xff\xfe"))], "file_id long, project_id long, path string, content binary")
    lines = corpus.lines(files)
    found = corpus.captures(lines)
    assert rows(found, "kind", "name", "line_no") == [("function", "Foo", 5), ("struct", "Bar", 10)]
    assert rows(corpus.doc_starts(lines, found), "line_no", "doc_line") == [(5, 3), (10, 10)]


def test_sections(spark):
    texts = ["before\n## one\nx\n### two\n####### not\n## three", "", None, "   ", "###### six", "no heading"]
    got = notes.sections(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert [h for i, _, h in rows(got, "doc_id", "ordinal", "heading") if i == 0] == ["", "one", "two", "three"]
    assert {r.doc_id for r in got.collect()} == {0, 4, 5}


def test_search_finds_the_matching_note_first(spark):
    cols = "memory_uid string, chunk_ordinal int, status string, file_status string, title string, chunk_heading string, chunk_text string, symbol_text string"
    data = [("a", 0, "active", "active", "parser notes", "", "about the parser", ""), ("b", 0, "active", "active", "cache", None, "nothing here", ""), ("c", 0, "deleted", "active", "parser", "", "parser", ""), ("d", 0, "active", "active", "x", "", "a parser", "")]
    chunks = spark.createDataFrame(data, cols)
    assert [r.memory_uid for r in notes.search(chunks, "Parser!").orderBy(F.desc("score")).collect()] == ["a", "d"]
    assert notes.search(chunks, "  ").collect() == []
    assert notes.replaced(chunks.withColumnRenamed("chunk_text", "text"), "parser", "X").select("matches").first().matches == 1


def test_slug(spark):
    df = spark.createDataFrame([("How the Cache: works!",), ("x" * 60,), ("--",)], "t string")
    assert [r.s for r in df.select(notes.slug(F.col("t")).alias("s")).collect()] == ["how-the-cache-works", "x" * 50, ""]


def test_quiet_periods_and_stream(spark, tmp_path):
    t = datetime(2025, 1, 1)
    ev = spark.createDataFrame([("a", t), ("a", t + timedelta(seconds=5)), ("a", t + timedelta(seconds=60)), ("a", None)], "key string, ts timestamp")
    assert rows(upkeep.quiet_periods(ev, "key", "ts", 10), "period", "n_events") == [(1, 2), (2, 1)]
    source = str(tmp_path / "events")
    cols = "path string, version long, sha string"
    for batch in ([("a", 2, "new"), ("b", 1, "b")], [("a", 1, "late"), ("a", 2, "new")], [("c", 1, None)]):
        spark.createDataFrame(batch, cols).coalesce(1).write.mode("append").parquet(source)
    state = upkeep.index_state(spark, source, spark.read.parquet(source).schema, ["path"], "version", ["sha"])
    assert rows(state, "path", "seq", "sha") == [("a", 2, "new"), ("b", 1, "b"), ("c", 1, None)]


def test_many_searches_rank_for_each_query(spark):
    cols = "memory_uid string, chunk_ordinal int, status string, file_status string, title string, chunk_heading string, chunk_text string, symbol_text string"
    data = [("a", 0, "active", "active", "parser notes", "", "about the parser", ""), ("b", 0, "active", "active", "cache", None, "nothing here", ""), ("d", 0, "active", "active", "x", "", "a parser", "")]
    queries = spark.createDataFrame([(1, "Parser!"), (2, "cache parser"), (3, " "), (4, "parser")], "query_id long, text string")
    got = notes.searches(spark.createDataFrame(data, cols), queries)
    ranked = {q: [r.memory_uid for r in sorted(got.collect(), key=lambda r: -r.score) if r.query_id == q] for q in (1, 2, 3, 4)}
    assert ranked == {1: ["a", "d"], 2: ["b", "a", "d"], 3: [], 4: ["a", "d"]}


def test_kinds_of_definitions(spark):
    held = {
        "a.js": ("class A {\n  constructor(x) {\n  async load(y) {\n    if (x) {\n    let n = 1;", [("A", "class"), ("constructor", "constructor"), ("load", "method"), ("n", "variable")]),
        "a.ts": ("export enum E {\nnamespace N {\n  private readonly f: number = 1;\n  constructor(a: T) {\n  get(a: T): R {\n  abstract go(): void;", [("E", "enum"), ("N", "module"), ("constructor", "constructor"), ("f", "field"), ("get", "method"), ("go", "method")]),
        "A.java": ("public enum E {\n    public A(int x) {\n    void run(int a) throws X, Y {\n        int n = 1;\n        return n;\n    private int m;", [("A", "constructor"), ("E", "enum"), ("m", "field"), ("n", "variable"), ("run", "method")]),
        "a.rs": ("pub(crate) async fn f() {\npub trait T {\ntype U = V;\nmod m;\n    let mut x = 1;\n    if let Some(y) = z {", [("T", "trait"), ("U", "type_alias"), ("f", "function"), ("m", "module"), ("x", "variable")]),
        "a.py": ("async def f():\n    y = 1\nMAX_N: int = 3\nif x == 2:\nf(a=1)", [("MAX_N", "constant"), ("f", "function"), ("y", "variable")]),
    }
    files = spark.createDataFrame([(i, 1, p, bytearray(t.encode())) for i, (p, (t, _)) in enumerate(held.items())], "file_id long, project_id long, path string, content binary")
    got = corpus.captures(corpus.lines(files)).collect()
    for path, (_, want) in held.items():
        assert sorted((r.name, r.kind) for r in got if r.path == path) == want, path


def test_reconcile_applied_twice_changes_nothing(spark):
    cols = "path string, sha string, n int"
    held = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1), ("c", "3", 2)], cols)
    listed = spark.createDataFrame([("a", "1", 9), ("b", "5", 9), ("d", "4", 9), ("d", "4", 8)], cols)
    once_each = lambda df: df.select("path", "sha").distinct()
    actions = corpus.reconcile(once_each(listed), once_each(held), ["path"], "sha")
    assert rows(actions, "path", "action") == [("a", "skip"), ("b", "index"), ("c", "delete"), ("d", "index")]
    now = corpus.applied(held, listed, actions, ["path"])
    assert rows(now, *["path", "sha", "n"]) == [("a", "1", 1), ("b", "5", 9), ("d", "4", 8), ("d", "4", 9)]
    assert rows(corpus.applied(now, listed, actions, ["path"]), "path", "n") == rows(now, "path", "n")
    again = corpus.reconcile(once_each(listed), once_each(now), ["path"], "sha")
    assert {r.action for r in again.collect()} == {"skip"}
    assert corpus.applied(held.limit(0), listed.limit(0), actions, ["path"]).collect() == []


def test_stream_state_is_compacted(spark, tmp_path):
    """Seven files of late and repeated events, parts merged after every second one."""
    source = str(tmp_path / "events")
    for batch in ([("a", 1)], [("a", 3), ("b", 1)], [("a", 2)], [("c", 5), ("c", 5)], [("b", 4)], [], [("d", 1), ("a", 3)]):
        spark.createDataFrame([(p, v, f"{p}{v}") for p, v in batch], "path string, version long, sha string").coalesce(1).write.mode("append").parquet(source)
    state = upkeep.index_state(spark, source, spark.read.parquet(source).schema, ["path"], "version", ["sha"], compact_every=2)
    assert rows(state, "path", "seq", "sha") == [("a", 3, "a3"), ("b", 4, "b4"), ("c", 5, "c5"), ("d", 1, "d1")]
    assert len(state.inputFiles()) <= 3 * 4  # a base and what came after it, not seven parts
