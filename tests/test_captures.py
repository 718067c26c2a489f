from pyspark.sql import functions as F

from spanlode.functions import paths
from spanlode.operators.captures import captured_usages, usages_of
from spanlode.operators.navigation import definitions_at
from tests.conftest import rows
from tests.test_operators import D, U, definition, usage

CASES = {
    "go": ('package a\nimport "fmt"\nfunc F(x T) int { // call it\n\ty := g(x)\n\ty += h.k\n}\n', [("x", "read"), ("T", "read"), ("int", "read"), ("y", "write"), ("g", "call"), ("x", "read"), ("y", "write"), ("h", "read"), ("k", "read")]),
    "python": ('from a import b\n@deco\nclass A(B):\n    """x\n y"""\n    def f(self, q: Int) -> Foo:\n        self.z = b(q)\n', [("a", "import"), ("b", "import"), ("deco", "annotation"), ("B", "inherit"), ("q", "read"), ("Int", "type_ref"), ("Foo", "type_ref"), ("z", "write"), ("b", "call"), ("q", "read")]),
    "java": ("@Dep\nclass A extends B implements C { String s = new D(e); }", [("Dep", "annotation"), ("B", "inherit"), ("C", "inherit"), ("String", "read"), ("s", "write"), ("D", "type_ref"), ("e", "read")]),
    "rust": ("use a::b;\n#[derive(X)]\nimpl T for S {}\nfn f(x: Foo) { let y = x.g('c', \"s\"); }", [("a", "import"), ("b", "import"), ("derive", "annotation"), ("X", "annotation"), ("T", "inherit"), ("S", "read"), ("x", "read"), ("Foo", "type_ref"), ("x", "read"), ("g", "call")]),
    "typescript": ("const a: Foo = `b ${c}`; d(e) // f", [("Foo", "type_ref"), ("d", "call"), ("e", "read")]),
}


def test_kinds_of_usages():
    for language, (text, want) in CASES.items():
        assert [u[:2] for u in usages_of(language, text)] == want, language
    assert usages_of("python", "x = 1\n'''a\nb''' + y\n")[-1] == ("y", "read", 3, 7)
    assert usages_of("go", "") == []


def test_files_with_nulls_copies_and_line_ends(spark):
    files = [(1, "a.py", b"\xef\xbb\xbff(x)\r\ng()\r", "z"), (1, "a.py", b"\xef\xbb\xbff(x)\r\ng()\r", "z"), (2, "b.txt", b"h()", "z"), (3, "c.py", None, "z"), (None, "d.py", b"i()", "z"), (4, "e.js", b"", "z"), (5, "f.js", b"\xff j()", "z")]
    df = spark.createDataFrame([(i, p, None if c is None else bytearray(c), n) for i, p, c, n in files], "file_id long, path string, content binary, name string")
    assert rows(captured_usages(df), "file_id", "name", "kind", "start_line", "start_col") == [(1, "f", "call", 1, 0), (1, "g", "call", 2, 0), (1, "x", "read", 1, 2), (5, "j", "call", 1, 2)]
    assert captured_usages(df.limit(0)).collect() == []


def test_cursor_leads_to_its_own_file_first(spark):
    d = spark.createDataFrame([definition(1, "a.go"), definition(2, "z.go", file=99, kind="variable"), definition(3, "b.go", name="bar")], D)
    u = spark.createDataFrame([usage(1, "z.go", line=5), usage(2, "q.go", file=98, line=5), usage(3, "q.go", file=98, name="none", line=6)], U)
    cursors = spark.createDataFrame([(1, 1, "go", "z.go", 99, 5, 1), (2, 1, "go", "x/q.go", 98, 5, 1), (3, 1, "go", "q.go", 98, 6, 1), (4, 1, "go", "q.go", 98, 7, 1)], "cursor_id int, project_id long, lang string, at_path string, at_file long, at_line int, at_col int")
    assert rows(definitions_at(cursors, d, u), "cursor_id", "name", "def_id", "confidence", "candidates") == [(1, "foo", 2, 0.75, 2), (2, "foo", 1, 0.9, 2), (3, "none", None, None, 0), (4, None, None, None, 0)]


def test_names_in_drawings(spark):
    df = spark.createDataFrame([("a/b/c/d.go:F:12",), ("9x:y",), ("",), ("abcdefghijklmnopqrstuvwxyz",)], "t string")
    got = df.select(paths.shortened(F.col("t"), 12).alias("s"), paths.node_name(F.col("t")).alias("n"), paths.symbol_of_node(F.col("t")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("a/b/...go:F:12"[:7] + "go:F:12"[-5:], "a_b_c_d_go_F_12", "F"), ("9x:y", "n9x_y", "9x:y"), ("", "node", ""), ("abcd...vwxyz", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz")]
    assert spark.createDataFrame([("a/b/c.go",), ("d.go",)], "p string").select(paths.ancestors(F.col("p")).alias("a")).collect()[0].a == ["a", "a/b"]
