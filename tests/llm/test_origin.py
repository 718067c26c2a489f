import random
import sys

import numpy as np

from spanlode.llm import lexers, origin
from spanlode.llm.origin import _clusters, band_hashes, features, is_marker, origins
from spanlode.plans.runtime import cut
from tests.conftest import rows

COLS = "file_id long, project_id long, path string, content binary, kind string, class_id long"


def hand(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=7))
    body = "".join(f"\t{word()} := {r.randint(100, 9999)}\n\tif {word()} == \"{word()}\" {{\n\t\t{word()}({r.randint(100, 9999)})\n\t}}\n" for _ in range(r.randint(8, 16)))
    return f"package {word()}\n\nfunc {word()}() {{\n{body}}}\n"


def getters(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=7))
    return "package p\n\n" + "".join(f"func (m *T) {word()}() string {{\n\tif m != nil {{\n\t\treturn m.{word()}\n\t}}\n\treturn \"\"\n}}\n\n" for _ in range(n))


def files(spark, data):
    return spark.createDataFrame([(i, p, path, None if t is None else bytearray(t.encode()), "x", 1) for i, p, path, t in data], COLS)


def kinds(spark, data, known=()):
    out = origins(files(spark, data), spark.createDataFrame([(k, "n") for k in known], "sha256 string, lib_name string"))
    found = {}
    for i, k in rows(out, "file_id", "kind"):
        found.setdefault(i, set()).add(k)
    return found


def test_families(spark):
    vendored = hand(1)
    data = [(i, i % 5, f"h{i}.go", hand(100 + i)) for i in range(40)]
    data += [(100, 1, "x/v.go", vendored), (101, 2, "y/v.go", vendored.replace("\n}", "\n\textra()\n}", 1)), (102, 3, "z/v.go", "// note\n" + vendored)]
    data += [(200, 1, "g/a.go", getters(1, 20)), (201, 1, "g/b.go", getters(2, 12))]
    data += [(300, 1, "blob.py", "DATA = [" + ", ".join(str(7919 * i % 100_003) for i in range(200)) + "]\n")]
    data += [(400, 1, "a.js", "// Code generated by x; DO NOT EDIT.\nlet a = 1;\n"), (401, 1, "b.js", 'const t = "Code generated by x; DO NOT EDIT.";\n'), (402, 1, "c.py", "# This file is not generated, edit it.\nx = 1\n")]
    data += [(500 + i, i, f"p{i}/__init__.py", '"""Package marker."""\n') for i in range(6)]
    data += [(600, 4, "back.go", hand(7)), (601, 4, "back.go", hand(7)), (600, 4, "back.go", hand(7))]
    data += [(700, 1, "n.go", None), (701, None, "e.go", ""), (702, 1, None, "x"), (703, 1, "o.txt", "text")]
    data += [(800, 1, "m.js", "!function(t){" + "".join(f"t.a{i}=function(e,n){{return e+n*{i}}};" for i in range(60)) + "}(this)")]
    got = kinds(spark, data)
    assert got == {100: {"vendored"}, 101: {"vendored"}, 102: {"vendored"}, 200: {"generated"}, 201: {"generated"}, 300: {"literals"}, 400: {"notice"}, 800: got.get(800, set()) | {"minified"}}


def test_known_hash_and_empty_tables(spark):
    import hashlib

    text = hand(3)
    sha = hashlib.sha256(text.encode()).hexdigest()
    assert kinds(spark, [(1, 1, "a.go", text), (2, 2, "b.go", hand(4))], [sha, None, ""]) == {1: {"known"}}
    assert kinds(spark, []) == {}


def test_similarity_is_exact(spark):
    base = hand(9).splitlines(keepends=True)
    near, far = "".join(base[:-4] + base[-1:]), "".join(base[: len(base) // 2])
    a, b, c = (set(features("go", t.encode()).shingles.tolist()) for t in ("".join(base), near, far))
    assert len(a & b) / len(a | b) >= 0.8 > len(a & c) / len(a | c)
    got = kinds(spark, [(1, 1, "a.go", "".join(base)), (2, 2, "b.go", near), (3, 3, "c.go", far)])
    assert set(got) == {1, 2}


def test_long_file():
    assert features("python", b"x = [" + b"12345, " * 300_000 + b"]\n").literal_only


def test_pairs_at_the_threshold_share_a_band():
    r = np.random.default_rng(5)
    missed = 0
    for _ in range(3000):
        drawn = r.integers(0, 2**32, 100, dtype=np.uint32)
        a, b = np.unique(drawn[:90]), np.unique(drawn[10:])
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) == 0.8
        missed += not (band_hashes(a) == band_hashes(b)).any()
    assert missed <= 3  # 0.2 are expected; 16 bands miss 17 of these pairs


def test_members_that_left_with_a_pivot_meet_those_that_stayed(spark):
    sets = {1: range(100), 2: range(5, 105), 3: range(12, 112), 4: range(40, 140), 5: [*range(75), *range(200, 225)]}  # 1 ~ 2 ~ 3, but 1 and 3 share 88 of 112
    classes = spark.createDataFrame([(i, "go", [7], list(s)) for i, s in sets.items()], "class_id long, language string, bands array<long>, shingles array<int>")
    assert rows(_clusters(classes), "class_id", "family") == [(1, 1), (2, 1), (3, 1)]


def test_families_of_literals_are_data(spark):
    numbers = lambda seed, n: ", ".join(str(random.Random(seed * 1000 + i).randint(1000, 9999)) for i in range(n))
    data = [(1, 1, "a/t.js", f"export const a = [{numbers(1, 50)}];\n"), (2, 2, "b/u.js", f"export const other = [{numbers(2, 70)}];\n")]  # each under 400 bytes
    data += [(3, 1, "list.py", f"CODES = [{numbers(3, 50)}]\n"), (4, 1, "lone.go", f"package p\n\nvar x = []int{{{numbers(4, 200)}}}\n")]
    data += [(5, 1, "h.js", hand(5)), (6, 2, "few.js", "export const a = [1000, 2000, 3000];\n")]
    assert kinds(spark, data) == {1: {"data"}, 2: {"data"}, 4: {"literals"}}


def test_small_files_have_families_too(spark):
    """Copies of a few lines in two projects; the same lines with other names; module files, alike everywhere."""
    small = lambda n: f"package p\n\nfunc {n}(a int) int {{\n\treturn a + {n}Base\n}}\n"
    data = [(1, 1, "a/x.go", small("first")), (2, 2, "b/x.go", small("first")), (3, 3, "c/x.go", small("second")), (4, 3, "c/y.go", small("third")), (5, 4, "d.go", small("own")), (6, 4, "e.go", small("own"))]
    data += [(10 + i, i, f"m{i}/index.ts", 'export * from "./main";\nexport { a, b } from "./other";\n') for i in range(4)]
    assert kinds(spark, data) == {1: {"vendored"}, 2: {"vendored"}}


def test_marker_files():
    for name, text in {"go": 'package a\n\nimport (\n\t"fmt"\n)\n', "rust": "pub mod core;\nuse a::{b,\n c};\n", "python": '"""Doc\nstring."""\nfrom a import (\n    b,\n    c,\n)\n__all__ = ["b"]\n', "javascript": "'use strict';\nexport * from 'x'; // y\n", "java": "/* c */\npackage a.b;\n"}.items():
        assert is_marker(name, text), text
    for name, text in {"go": "package a\nvar x = 1\n", "rust": "mod a;\nfn f() {}\n", "python": "import a\na.f()\n", "javascript": "export const a = 1;\n", "java": "package a;\nclass B {}\n"}.items():
        assert not is_marker(name, text), text


def test_no_link_is_lost_in_crowded_bands(spark):
    """Two hundred sets in one band, a few similar ones among them: families are those of brute force."""
    r = random.Random(3)
    sets = {i: set(r.sample(range(10_000), 60)) for i in range(1, 181)}
    for i in range(181, 201):
        base = sorted(sets[r.randint(1, i - 1)])
        sets[i] = set(base[r.randint(0, 6) :]) | {20_000 + i}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted((i, root(i)) for i in sets if sum(root(j) == root(i) for j in sets) > 1)
    classes = spark.createDataFrame([(i, "go", [7], sorted(s)) for i, s in sets.items()], "class_id long, language string, bands array<long>, shingles array<int>")
    assert rows(_clusters(classes), "class_id", "family") == want and len(want) > 20


def test_crowded_bands_take_few_rounds(spark, monkeypatch):
    """Two hundred sets of one band, none like another: every round's plans and jobs stay in the driver's memory."""
    made = []
    monkeypatch.setattr(origin, "cut", lambda df: made.append(1) or cut(df))
    classes = spark.createDataFrame([(i, "go", [7], list(range(100 * i, 100 * i + 20))) for i in range(200)], "class_id long, language string, bands array<long>, shingles array<int>")
    assert rows(_clusters(classes), "class_id", "family") == []
    assert len(made) <= 12  # two rounds of three, and four more


def test_tokens_take_no_call_each():
    """Tokens go to their codes within one call of the interpreter, and literals to their lengths: else those calls take most of the time."""
    text = "package p\n\nfunc f() {\n" + '\tfirst := second + 1234 + "literal"\n' * 3000 + "}\n"
    features("go", text.encode())
    calls = []
    sys.setprofile(lambda frame, event, what: calls.append(event) if event in ("call", "c_call") else None)
    try:
        got = features("go", text.encode())
    finally:
        sys.setprofile(None)
    assert got.tokens == 3000 * 7 + 8 and len(calls) < 1000


def test_words_are_the_tokens_of_the_language():
    """Also where marks, numbers, names and quotes meet, and among comments, odd blanks and line ends."""
    r = random.Random(11)
    parts = r"""a b r f rb br #x r#x 'a 'b' "s" "" "e\"e" ''' ` ${ } ( ) [ ] { , ; : :: := = == => === . .. ... ..= .5 1. 1.5e3 0 00 07 0x1f 1_0 12n 3j 1u8 1$ $x /* */ // # \ / /x/g * ** ? ?. < > - -> é ² _ f"{x}" r#"s"# b"x" b'x' \" \'""".split(" ")
    parts += ["\n", " ", "\t", "\v", "\\\n", "\n\n", "\xa0", "\x1c", "\ufeff", '"""']
    for name in lexers.TOKENS:
        for _ in range(1500):
            text = "".join(r.choices(parts, k=r.randint(1, 25)))
            want = [w for w in lexers.language(name).pattern.findall(text) if w and not w.isspace() and not w.startswith("/*")]
            assert [w for w in lexers.words(name).findall(text) if w] == want, (name, text)


def test_bands_of_large_sets():
    shingles = np.unique(np.random.default_rng(6).integers(0, 2**32, 3 * origin.BLOCK + 5, dtype=np.uint32))
    least = ((shingles.astype(np.uint64) * origin._A[:, None] + origin._B[:, None]) >> np.uint64(32)).min(axis=1).reshape(origin.BANDS, origin.ROWS)
    want = (least * origin._BAND_WEIGHTS).sum(axis=1, dtype=np.uint64) * np.uint64(31) + np.arange(origin.BANDS, dtype=np.uint64)
    assert (band_hashes(shingles) == want.view(np.int64)).all()
