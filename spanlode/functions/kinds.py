"""Closed sets of the code index and the weights that scoring gives them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlode.functions.paths import directory

#: Definition kinds in the order by which definitions sort.
DEFINITION_KINDS = "unknown package class interface struct enum function method property field variable constant constructor type_alias trait module".split()
TYPES = ["class", "struct", "interface", "enum", "type_alias", "trait"]
CALLABLES = ["function", "method", "constructor"]
VALUES = ["variable", "field", "property", "parameter"]

#: Coupling strength of a usage by its kind.
COUPLING = {"inherit": 1.0, "call": 0.65, "write": 0.55, "read": 0.5, "import": 0.4, "type_ref": 0.25, "annotation": 0.2, "other": 0.1}

#: Which usage wins at one position.
CAPTURE_PRIORITY = {"inherit": 90, "annotation": 80, "call": 70, "write": 60, "import": 50, "type_ref": 40, "read": 30, "other": 10}

#: Usage kind, (definition kinds it fits, factor if so, factor if not).
FIT = {
    "import": ([], 3.0, 3.0),
    "type_ref": (TYPES, 2.5, 0.6),
    "inherit": (["class", "interface", "trait"], 3.0, 0.5),
    "call": (CALLABLES, 2.5, 0.6),
    "write": (["field", "variable", "property"], 2.0, 0.7),
    "read": (["field", "variable", "property", "constant"], 1.5, 0.8),
    "annotation": ([], 1.2, 1.2),
}

#: Which usage of a name within a definition stands for the others.
OUTBOUND_RANK = {"inherit": 100, "call": 70, "write": 60, "import": 50, "type_ref": 40, "read": 30}

#: What a definition's kind adds to its confidence.
KIND_WEIGHT = {
    "class": 0.4, "interface": 0.4, "struct": 0.4, "enum": 0.4, "trait": 0.4, "type_alias": 0.3, "function": 0.2, "method": 0.2, "constructor": 0.2,
    "constant": 0.1, "variable": 0.0, "field": 0.0, "property": 0.0, "parameter": 0.0,
}
OTHER_KIND_WEIGHT = 0.05

#: Path segments that make a path noisy, by what they cost.
NOISE_SEGMENTS = {
    0.45: "migrations migration migrate db_migrate alembic flyway liquibase".split(),
    0.40: "fixtures __fixtures__ mocks stubs fake fakes".split(),
    0.35: "testdata test tests __tests__ spec specs generated gen vendor pb proto".split(),
    0.0: ["db_migration"],
}
NOISE_SUFFIX_COST = 0.30
NOISE_SUFFIX = r"(_test\.go|\.(test|spec)\.(ts|tsx|js|jsx))$"

#: Extension, language.
EXTENSIONS = {
    "go": "go", "java": "java", "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "pyi": "python",
}


def _chosen(value: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for key, x in table.items():
        out = F.when(value == key, F.lit(x)).otherwise(out)
    return out


def kind_order(kind: Column) -> Column:
    """The kind's place in ``DEFINITION_KINDS``; kinds that aren't there count as unknown."""
    return F.greatest(F.coalesce(F.array_position(F.lit(DEFINITION_KINDS), kind), F.lit(1)), F.lit(1)).cast("int") - 1


def coupling(kind: Column, relation: Column) -> Column:
    base = _chosen(kind, COUPLING, 0.1)
    return F.when(relation.isin("inherits", "implements"), 1.0).when(relation == "prototype", F.greatest(base, F.lit(0.8))).otherwise(base)


def outbound_rank(kind: Column) -> Column:
    return _chosen(kind, OUTBOUND_RANK, 10)


def kind_weight(kind: Column) -> Column:
    return _chosen(kind, KIND_WEIGHT, OTHER_KIND_WEIGHT)


def noise(path: Column) -> Column:
    """What the path costs: the dearest class of segments that occurs, else the suffix of a test file, else 0."""
    segments = F.split(F.lower(path), "/")
    out = F.when(F.lower(path).rlike(NOISE_SUFFIX), NOISE_SUFFIX_COST).otherwise(0.0)
    for cost, names in sorted(NOISE_SEGMENTS.items()):
        if cost:
            out = F.when(F.arrays_overlap(segments, F.lit(names)), cost).otherwise(out)
    return out


def is_noisy(path: Column) -> Column:
    names = [n for held in NOISE_SEGMENTS.values() for n in held]
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.lit(names)) | F.lower(path).rlike(NOISE_SUFFIX)


def rounded(x: Column) -> Column:
    """Half away from zero to four places."""
    return F.round(x * 10000) / 10000


#: What it adds to a definition's confidence to lie in the file, or the directory, one starts from.
SAME_FILE, SAME_DIRECTORY = 0.25, 0.12


def confidence(kind: Column, path: Column, start: Column | None = None) -> Column:
    """Of a definition: kind, noise and, with the path one starts from, how near it lies; within 0 and 1."""
    near = F.lit(0.0) if start is None else F.when(path == start, SAME_FILE).when(directory(path) == directory(start), SAME_DIRECTORY).otherwise(0.0)
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + kind_weight(kind) - noise(path) + near)))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def glob_pattern(glob: str) -> str:
    """A glob as a pattern for a whole path: ``*`` and ``?`` stay within a segment, ``[...]`` is a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2)
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and end > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if c in r".^$+{}()|[]\\" else c
        i += 1
    return f"^{out}$"


#: What the source line of a usage says about it, by class: (definition kinds it fits, factor, factor otherwise).
LINE_FIT = {
    1: ([*TYPES, "constructor"], 2.0, 0.5),
    2: (TYPES, 2.0, 0.5),
    3: (["field", "property", "method"], 2.0, 0.8),
    4: (CALLABLES, 2.0, 0.7),
    5: (TYPES, 1.6, 1.0),
}
#: Patterns of the line classes 1, 2 and 5.
NEW_LINE, BASE_LINE, HINT_LINE = r"\bnew\s+[0-9A-Za-z_]+", r"\b(extends|implements)\s+[0-9A-Za-z_]+", r":\s*[A-Z][0-9A-Za-z_]*|->\s*[A-Za-z_]"


def line_class(line: Column, name: Column) -> Column:
    """Which class of ``LINE_FIT`` a source line puts the usage in; 0 for none, for empty lines and lines without the name."""
    text = F.coalesce(line, F.lit(""))
    there = (text != "") & text.contains(name)
    return (
        F.when(~there, 0).when(text.rlike(NEW_LINE), 1).when(text.rlike(BASE_LINE), 2).when(text.contains(F.concat(F.lit("."), name)), 3)
        .when(text.contains(F.concat(name, F.lit("("))), 4).when(text.rlike(HINT_LINE), 5).otherwise(0)
    )


def _factor(row, kind: str) -> int:
    fitting, yes, no = row or ([], 1.0, 1.0)
    return round(10 * (yes if not fitting or kind in fitting else no))


#: Both factors of a usage and a definition, times 10 each, at place(usage kind, line class) + kind_order(definition kind).
FACTORS = [_factor(FIT.get(u), d) * _factor(LINE_FIT.get(c), d) for u in (*FIT, None) for c in range(6) for d in DEFINITION_KINDS]


def place(usage_kind: Column, cls: Column) -> Column:
    """Where the factors of a usage's kind and line class begin in ``FACTORS``."""
    known = F.array_position(F.lit(list(FIT)), usage_kind)
    row = F.when(known > 0, known - 1).otherwise(F.lit(len(FIT)))
    return ((row * 6 + cls) * len(DEFINITION_KINDS)).cast("int")


def escalated(base: Column, name: Column, line: Column) -> Column:
    """Coupling raised by what the line does with the name: inheriting from it, or making one of it."""
    text = F.coalesce(line, F.lit(""))
    has = lambda before, after: text.contains(F.concat(F.lit(before), name, F.lit(after)))
    makes = F.lit(False)
    for before, after in (("new ", "("), ("new ", "{"), ("new ", " {"), ("&", "{"), ("&", " {"), ("", "{"), ("", " {"), ("", "::new"), ("", "::New")):
        makes |= has(before, after)
    raised = F.when(has("extends ", "") | has("implements ", ""), 1.0).when(makes, F.greatest(base, F.lit(0.95))).otherwise(base)
    return F.when((base >= 0.99) | (text == ""), base).otherwise(raised)
