import ast
import glob
import os
import time
import warnings

import pytest

from spanlode.llm import lexers
from spanlode.llm.gll import Grammar
from spanlode.llm.syntax import parsed, rates
from tests.conftest import rows

VALID = {
    "go": ["package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\ntype T[K comparable] struct {\n\tA, b int `json:\"a\"`\n\t*m.X\n}\n\nfunc (t *T[K]) F(x ...int) (int, error) {\n\tfor i, v := range x {\n\t\tif _, ok := q[i]; !ok && v > 0 {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch y := z.(type) {\n\tcase int, []string:\n\t\treturn 0, nil\n\tdefault:\n\t}\n\tselect {\n\tcase <-c:\n\t}\n\tp := []T{{A: 1}, {b: 2}}\n\tdefer func() { recover() }()\n\treturn len(p), nil\n}"],
    "java": ["class A {}", "package a.b;\nimport java.util.*;\n@X(a = 1, b = {2})\npublic sealed class A<T extends B & C> extends D<T> implements E permits F {\n  private final Map<String, List<int[]>> m = new HashMap<>();\n  static { int x = 1; }\n  A(int... a) throws X { this.m = (Map<String, List<int[]>>) null; }\n  <R> R f(Function<? super T, R> g) {\n    for (int i = 0, j = 1; i < 3; i++, j--) { if (x instanceof String s && !s.isEmpty()) continue; }\n    int k = switch (y) { case 1, 2 -> 3; default -> { yield 4; } };\n    Runnable r = () -> { throw new E(); };\n    try (var z = open()) { z.a()[0].b += 'c' >>> 2; } catch (A | B e) { } finally { }\n    return g.apply(A::new);\n  }\n  record P(int a, String b) { P { } }\n  enum Q { U, V(1) { int h() { return 2; } }; int h() { return 1; } }\n  String t = \"\"\"\n    text \"block\"\n    \"\"\";\n}"],
    "rust": ["", "#![allow(x)]\nuse a::{b, c::*, d as e};\n/* outer /* nested */ */\npub(crate) struct S<'a, T: Clone + 'a> where T: Copy { pub x: &'a [T; 3], y: Box<dyn Fn(i32) -> u8> }\nimpl<'a, T> S<'a, T> {\n  pub async fn f(&mut self, (a, _): (u8, i64)) -> Result<Vec<T>, String> {\n    let v: Vec<Vec<i32>> = x.iter().map(|&(a, b)| a << b).collect::<Vec<_>>();\n    if let Some(Foo { a, .. }) = q? && a > 3 { return Err(format!(\"{}\", 'x')); }\n    match y { 1..=5 | 7 => {}, Some(n) if n > 0 => n += 1, _ => unsafe { g() } }\n    let s = S { x: r#\"a\"b\"#, ..Default::default() };\n    'l: for i in 0..10 { break 'l; }\n    loop { x.0.await; }\n    Ok(v)\n  }\n}\nmacro_rules! m { ($x:expr) => { $x } }\nconst A: &str = \"a\\n\";\n"],
    "javascript": ["", "return_ = 1", "import a, { b as c } from \"x\";\nexport default class extends D { #p = 1; static async *g() { yield* h(); } get x() { return this.#p } }\nconst { a: [q, ...r], s = 2 } = o, f = async ({ x }, ...y) => ({ x, ...y });\nfor (const k of it) if (/[/\"]\\//g.test(k)) continue; else break\nlabel: while (x?.y?.[0] ?? z) { x = `a${`b${c}` + {}}d` }\nlet n = a / b / c, m = 1_000n ** 2n\nswitch (t) { case 1: default: }\ndo x++; while (x < 3)\nexport * as ns from 'y'"],
    "typescript": ["export interface A<T extends B = C> extends D<T> { readonly x?: T[]; [k: string]: number | undefined; f<U>(a: U): a is U; new (): A }\ntype M = { [K in keyof T]?: T[K] extends infer U ? U : never };\nexport abstract class P<T> implements Q { constructor(private readonly a: number, public b?: string) { super() } abstract f(): void; declare x: y; }\nconst f = <T,>(a: T, b = <any>c): Map<string, Array<number>> => a as unknown as Map<string, Array<number>>;\nenum E { A = 1, B }\ndeclare module 'x' { export const y: number; }\nnamespace N.M { let z = g<string>(h!)! }\nfunction o(this: A, x: [a: number, ...b: string[]]): asserts x is any;\nimport type { T } from './t'"],
    "python": ["", "#!/usr/bin/python\n", "@d(1)\nasync def f(a, /, b: int = 2, *c, d=None, **e) -> X:\n    async with a as b, c: pass\n    x = [i for i in y if i if (j := i)] + {**a, 'b': 1}['b'][1:2, ::3]\n    print(f'{a!r:>{w}} {b[\"c\"]}', *g, end=\"\")\n    try:\n        yield\n    except* (A, B) as e:\n        raise E from e\n    else: ...\n    match x:\n        case [1, *_] | {'a': b} if b: return lambda *a, k=1: (yield)\n        case P(x=1): pass\n\nclass A(B, metaclass=C):\n  'doc'\n\n  x: int; y = z = 1 if 2 else 3\nif a:\n\tb\nelif c: d\nelse:\n\te; f\n"],
}
BROKEN = {
    "go": ["func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nvar x = []int{1\n}\n", "package a\n<<<<<<< HEAD\nvar x = 1\n", "package a\nfunc f() {\n\tx := \n}\n", "def f(): pass\n"],
    "java": ["class A {", "class A { int f() { return 1 } }", "class A { void f() { x + 1; } }", "class A { void f() { try { } } }", "class A { String s = \"a; }", "{\"a\": 1}", "class A { void f(int x { } }"],
    "rust": ["fn f() { let x = ; }", "fn f( {", "struct S { a: i32", "fn f() { \"abc }", "import a", "fn f() -> { }"],
    "javascript": ["const x", "if (a {", "{\"a\": 1}", "function f() { return `a }", "a b", "let = = 1", "import x from"],
    "typescript": ["interface A { x: }", "const x: number", "type A = ;", "class A { f(: number) {} }", "# title\n\ntext here\n"],
    "python": ["def f(:\n  pass", "if x\n  y\n", "x = (1,\n", "  x = 1\n y = 2\n", "print 'a'\n", "'abc\n", "try:\n  x\n", "f'{a +}'\n", "f'{a!r:>{w}'\n", "f'a}'\n", "x = 1 +\n"],
}


@pytest.mark.parametrize("name", list(VALID))
def test_valid_and_broken(name):
    for text in VALID[name]:
        for variant in (text, "﻿" + text, text.replace("\n", "\r\n")):
            assert lexers.dialects(name, variant.encode()), variant
    for text in BROKEN[name]:
        assert not lexers.dialects(name, text.encode()), text
    for text in VALID[name]:
        assert not lexers.dialects(name, (text + "\n<<<<<<< HEAD\n=======\n>>>>>>> x\n").encode())
    assert lexers.dialects(name, b"\xff\xfe") == []


def test_python_agrees_with_the_interpreter():
    warnings.simplefilter("ignore")
    files = sorted(glob.glob(os.path.dirname(os.__file__) + "/[a-f]*.py"))
    wrong = 0
    for f in files:
        content = open(f, "rb").read()
        assert len(ast.parse(content).body) >= 0
        wrong += not lexers.dialects("python", content)
    assert wrong <= 0.04 * len(files)
    for text in BROKEN["python"]:
        with pytest.raises(SyntaxError):
            ast.parse(text)


def test_dialects():
    assert lexers.dialects("javascript", b"import a from 'a'") == ["Module"]
    assert lexers.dialects("javascript", b"var a = 1;") == ["Script", "Module"]


def test_ambiguous_and_left_recursive_grammar():
    g = Grammar("S = S S | S 'a' | 'b' | p:S\n", ["S"], set())
    a, b = g.token("a"), g.token("b")
    assert g.accepts("S", [b, a, b, b, a, a]) and g.accepts("S", [b] * 40) and not g.accepts("S", [a]) and not g.accepts("S", [])
    assert g.accepts("S", [g.group("p", [b, a]), a]) and not g.accepts("S", [g.group("p", [a])])


def test_long_and_deep_files():
    assert lexers.dialects("javascript", b"x = [" + b"1, " * 200_000 + b"]")
    assert lexers.dialects("java", b"class A { void f() { " + b"if (a) b(); else " * 3000 + b"c(); } }")
    assert lexers.dialects("python", b"(" * 90 + b"1" + b")" * 90 + b"\n")


def test_operator(spark):
    cols = "file_id long, project_id long, path string, content binary, language string, dialects string"
    data = [(1, 1, "a.go", bytearray(b"package a\n")), (1, 1, "a.go", bytearray(b"package a\n")), (2, 1, "B.PY", bytearray(b"x = ")), (3, None, "c.txt", bytearray(b"?")), (4, 2, "d.rs", None), (5, 2, None, bytearray(b"x")), (6, 2, "e.java", bytearray(b""))]
    files = spark.createDataFrame([(*d, "x", "y") for d in data], cols)
    got = parsed(files).selectExpr("file_id", "size(dialects) = 0 as broken").distinct()
    assert rows(got, "file_id", "broken") == [(1, False), (2, True), (4, False), (6, False)]
    assert parsed(files.limit(0)).collect() == []
    runs = spark.createDataFrame([(1, 1, 4), (1, 1, 4), (2, 1, None)], "run_id long, project_id long, errors int")
    told = rates(files, runs)
    assert rows(told, "project_id", "language", "n_files", "n_broken", "reported_errors", "silent_runs") == [(1, "go", 1, 0, 4, 1), (1, "python", 1, 1, 4, 1), (2, "java", 1, 0, None, None), (2, "rust", 1, 0, None, None)]


INVALID = {
    "python": ["1 = x\n", "f() = 3\n", "a + 1 += 2\n", "for 1 in x: pass\n", "f(a=1, 2)\n", "f(**k, *a)\n", "f(**k, 1)\n", "def f(a=1, b): pass\n", "def f(*): pass\n", "def f(/, a): pass\n", "lambda a=1, b: 0\n", "x if y\n", "if x:\n\ty = 1\n        z = 2\n"],
    "go": ["package a\nfunc f() {\n\tif x == T{} { }\n}\n", "package a\nfunc f() {\n\tfor x := range T{} { }\n}\n"],
    "rust": ["fn f() { a < b < c; }", "fn f() { a == b == c; }"],
    "javascript": ["return 1", "if (x) { return 1 }", "class A { static { return 1 } }", "<div/>"],
    "typescript": ["namespace N { return 1 }", "const x = <div></div>;"],
}
STILL_VALID = {
    "python": ["a, *b = c\n(a, b), [c, d] = e\nx.y = z[1] = 3\n(x): int\nx[1] += 2\ndel a, (b, c)\n() = x\nf(*a, b, c=1, *d, **e, g=2)\n", "def f(a, b=1, /, c=2, *, d, e=3, **k): pass\ndef g(a, /, b): pass\ndef h(*a, b): pass\ndef i(**k,): pass\nx = lambda a, /, b=1, *c, d=2, **e: 0\n", "y = [i for i in a if b if c]\nz = [i if a else b for i in c if d]\n"],
    "go": ["package a\nfunc f() {\n\tfor _, x := range []int{1} { g(T{1}) }\n\tif (x == T{}) { }\n\tif v, ok := m[K{1}]; ok { } else if y { } else { }\n\tfor x < 3 { }\n}\n"],
    "rust": ["fn f() { let x = a < b && c < d || e == f; x += a >> 2; let z = a & b != 0; for i in 0..n - 1 { } }"],
    "javascript": ["function f() { if (a) { return 1 } else return b ? c : d ? e : f; } const g = a => b => a = b; class A { m() { return 1 } }"],
    "typescript": ["const f = <T>(y: T) => { return y as T ? 1 : 2 }; type X = A extends B ? C : D; function g(a?: number, b = 1) { return a }"],
}


@pytest.mark.parametrize("name", list(INVALID))
def test_more_of_what_the_languages_forbid(name):
    assert [t for t in INVALID[name] if lexers.dialects(name, t.encode())] == []
    assert [t for t in STILL_VALID[name] if not lexers.dialects(name, t.encode())] == []


def test_elements_are_a_dialect_of_their_extensions():
    good = "const x = <div className=\"a\" onClick={() => { go({a: 1}) }} {...p}>don't {y ? <b>z</b> : null} text {/* c */}<br/><></></div>;\nif (a < b) { c }"
    assert lexers.dialects("javascript", good.encode(), True) == ["ScriptWithElements", "ModuleWithElements"]
    assert lexers.dialects("javascript", good.encode()) == []
    assert lexers.dialects("typescript", b"const f = <T,>(x: T) => x; const h = () => <A.B x={1} y='z'/>;", True)
    for bad in ("const x = <div></p>;", "const x = <div>{1 +}</div>;", "const x = <div>;", "const x = <div a=b/>;"):
        assert lexers.dialects("javascript", bad.encode(), True) == []


CHAINS = {
    "not": ("javascript", "x = ", "!", "y;"), "choice": ("javascript", "x = ", "a ? b : ", "c;"), "else if": ("javascript", "if (a) {b}", " else if (a) {b}", ""), "assignment": ("javascript", "", "a = ", "b;"), "arrow": ("javascript", "x = ", "a => ", "b;"),
    "java choice": ("java", "class A { int x = ", "a ? b : ", "c; }"), "java else if": ("java", "class A { void f() { if (a) {b();}", " else if (a) {b();}", " } }"), "python choice": ("python", "x = ", "a if b else ", "c\n"), "python power": ("python", "x = ", "a ** ", "b\n"),
    "python list": ("python", "x = [", "1, ", "]\n"), "go else if": ("go", "package a\nfunc f() {\nif a {\nb()\n}", " else if a {\nb()\n}", "\n}\n"), "rust else if": ("rust", "fn f() { if a { b() }", " else if a { b() }", " }"), "union": ("typescript", "type A = ", "'a' | ", "b;"),
}


@pytest.mark.parametrize("name", list(CHAINS))
def test_chains_of_fifty_thousand(name):
    language, before, link, after = CHAINS[name]
    began = time.process_time()
    assert lexers.dialects(language, (before + link * 50_000 + after).encode())
    assert time.process_time() - began < 30  # seconds; a tenth of it on an idle machine


def test_nesting_never_fails_a_task():
    assert lexers.dialects("javascript", ("x = " + "(" * 50_000 + "a" + ")" * 50_000).encode())
    assert lexers.dialects("javascript", ("x = " + "`${" * 50_000 + "a" + "}`" * 50_000).encode()) == []
    assert lexers.dialects("javascript", ("x = " + "<a>" * 50_000 + "</a>" * 50_000).encode(), True)
