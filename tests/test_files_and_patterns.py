import pytest
from pyspark.sql import functions as F

from spanlode.functions import kinds
from spanlode.operators import corpus, note_files, patterns, render
from spanlode.sources import scan
from tests.conftest import rows

D = "def_id long, project_id long, file_id long, path string, lang string, name string, kind string, container string, start_line int, start_col int, end_line int, end_col int"


def test_scan_prunes_and_hashes(spark, tmp_path):
    for name, text in {"a.go": "package a", "x/b.py": "x = 1", "node_modules/c.js": "c", ".git/d.py": "d", "x/.hid/e.rs": "e", "x/readme.txt": "t", "n/one.MD": "# one", "n/two.md": "# two"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = scan.source_tree(spark, str(tmp_path))
    assert rows(tree, "path", "lang", "size_bytes") == [("a.go", "go", 9), ("x/b.py", "python", 5)]
    assert rows(scan.note_tree(spark, str(tmp_path)), "name", "markdown") == [("n/one.MD", "# one"), ("n/two.md", "# two")]


def test_frontmatter_round_trip(spark):
    cols = "id string, scope string, file string, title string, status string, fileStatus string, body string, symbols array<struct<language:string,name:string,status:string>>"
    data = [("u1", "file", "a\\b.go", 'the "title": x\nline', "active", "deleted", "# h\ntext\n", [("go", "Foo", "active"), ("java", 'B"ar', "deleted")]), ("u2", None, None, "", None, None, None, [])]
    written = note_files.written(spark.createDataFrame(data, cols))
    back = {r.id: r for r in note_files.parsed(written.select("markdown")).collect()}
    assert (back["u1"].file, back["u1"].title, back["u1"].fileStatus, back["u1"].body) == ("a\\b.go", 'the "title": x\nline', "deleted", "# h\ntext\n")
    assert [tuple(s) for s in back["u1"].symbols] == data[0][-1]
    assert (back["u2"].scope, back["u2"].status, back["u2"].fileStatus, back["u2"].body, back["u2"].symbols) == ("project", "active", "active", "", [])


def test_broken_notes_are_kept_as_sections(spark):
    texts = spark.createDataFrame([("a.md", '---\nnote:\n  id: "1"\n---\n\nbody'), ("b.md", "no front"), ("c.md", "---\nnote:\n  title: x\n---\nb"), ("d.md", "  "), ("e.md", None)], "name string, markdown string")
    assert rows(note_files.merged_strays(texts), "name", "section") == [("a.md", None), ("project.md", "b.md"), ("project.md", "c.md")]


def test_upserts_in_any_order(spark):
    cols = "id long, v int, title string, status string"
    old, new = [(1, 1, "a", "active"), (2, 1, "b", "active")], [(1, 3, None, "deleted"), (1, 2, "aa", None), (3, 1, "c", "active"), (None, 9, "x", "y"), (1, 3, None, "deleted")]
    want = [(1, 3, "aa", "deleted"), (2, 1, "b", "active"), (3, 1, "c", "active")]
    for changes in (new, new[::-1]):
        got = note_files.upserted(spark.createDataFrame(old, cols), spark.createDataFrame(changes, cols), "id", "v", ["title", "status"])
        assert rows(got, "id", "v", "title", "status") == want


def test_patterns(spark):
    d = spark.createDataFrame([(i, 1, 1, "a.go", "go", n, k, "", i, 0, i, 3) for i, (n, k) in enumerate([("getA", "function"), ("setA", "function"), ("getB", "method"), ("getA", "function")])], D)
    find = lambda p, **kw: rows(patterns.search(d, d, p, **kw), "name", "start_line")
    assert find('(function) @n (#match? @n "^get")') == [("getA", 0), ("getA", 3)]
    assert find('(function) @n (#not-match? @n "^get") (#any-of? @lang "go" "java")') == [("setA", 1)]
    assert find("(function) @n", most=2) == [("getA", 0), ("setA", 1)] and find("(function) @n", per_file=1) == [("getA", 0)]
    assert find(patterns.rendered("defs.method.named", name="getB")) == [("getB", 2)]
    for bad in ("(function", "(nothing) @n", "(function) @n (#like? @n \"x\")", "(function (x)) @n", "(function) @n (#eq? @m \"x\")"):
        with pytest.raises(ValueError):
            patterns.search(d, d, bad)
    for stub, args in (("none", {}), ("defs.class.named", {})):
        with pytest.raises(ValueError):
            patterns.rendered(stub, **args)


def test_line_rules(spark):
    lines = ["x = new Foo(1)", "class A extends Foo", "a.Foo", "Foo(1)", "", "bar", "x: Foo", None]
    df = spark.createDataFrame([(x, "Foo") for x in lines], "line string, name string")
    assert [r.c for r in df.select(kinds.line_class(F.col("line"), F.col("name")).alias("c")).collect()] == [1, 2, 3, 4, 0, 0, 5, 0]
    raised = ["return x instanceof Foo;", "extends FooBar", "&Foo{", "Foo::new()", "Foo", ""]
    df = spark.createDataFrame([(x, "Foo", 0.1) for x in raised], "line string, name string, b double")
    assert [r.c for r in df.select(kinds.escalated(F.col("b"), F.col("name"), F.col("line")).alias("c")).collect()] == [0.1, 1.0, 0.95, 0.95, 0.1, 0.1]


def test_definition_code(spark):
    text = "\n".join(f"line {i}" for i in range(1, 200))
    files = spark.createDataFrame([(1, 1, "a.go", bytearray(text.encode()))], "file_id long, project_id long, path string, content binary")
    d = spark.createDataFrame([(1, 1, 1, "a.go", "go", "f", "function", "", 63, 0, 65, 3), (2, 1, 1, "a.go", "go", "g", "function", "", 500, 0, 501, 3), (3, 1, 1, "a.go", "go", "h", "function", "", 1, 0, 199, 3)], D)
    got = dict(rows(render.definition_code(d, corpus.lines(files), most=200), "def_id", "code"))
    assert got[1] == "--- a.go:63-65 (f function) ---\n    63| line 63\n    64| line 64\n    65| line 65"
    assert set(got) == {1, 3} and got[3].endswith("\n... truncated") and len(got[3]) == 200 + len("\n... truncated")
