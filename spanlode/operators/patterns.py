"""Structural search over captured definitions and usages.

A pattern is a node type, a capture and tests of the captured name:

    (function) @name (#match? @name "^get") (#any-of? @lang "go" "rust")

Node types are the kinds of definitions, or those of usages with ``ref_`` before them. Other syntax is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlode.functions import kinds

_PATTERN = re.compile(r"\s*\(\s*(\w+)\s*\)\s*@(\w+)((?:\s*\(#[^()]*(?:\"(?:[^\"\\]|\\.)*\"[^()]*)*\))*)\s*$")
_TEST = re.compile(r"\(#(not-)?(eq|match|any-of)\?\s+@(\w+)((?:\s+\"(?:[^\"\\]|\\.)*\")+)\s*\)")

#: Searches by name that need no pattern: what they look for.
STUBS = {
    "defs.function.named": "(function) @name (#eq? @name \"{{name}}\")",
    "defs.class.named": "(class) @name (#eq? @name \"{{name}}\")",
    "defs.interface.named": "(interface) @name (#eq? @name \"{{name}}\")",
    "defs.method.named": "(method) @name (#eq? @name \"{{name}}\")",
    "refs.type.named": "(ref_type_ref) @name (#eq? @name \"{{name}}\")",
    "refs.call.named": "(ref_call) @name (#eq? @name \"{{name}}\")",
    "refs.write.named": "(ref_write) @name (#eq? @name \"{{name}}\")",
    "refs.import.named": "(ref_import) @name (#eq? @name \"{{name}}\")",
}


def rendered(stub: str, **args: str) -> str:
    """The pattern of a stub; unknown stubs and missing arguments are errors."""
    if stub not in STUBS:
        raise ValueError(f"unknown stub {stub}")
    out = STUBS[stub]
    for name in re.findall(r"\{\{(\w+)\}\}", out):
        if not args.get(name):
            raise ValueError(f"{stub} needs {name}")
        out = out.replace("{{" + name + "}}", args[name].replace("\\", "\\\\").replace('"', '\\"'))
    return out


def condition(pattern: str):
    """(node type, condition on the columns name, lang and path) of a pattern."""
    m = _PATTERN.match(pattern)
    if not m:
        raise ValueError(f"pattern not understood: {pattern}")
    node, capture, tests = m.groups()
    if node.removeprefix("ref_") not in (*kinds.DEFINITION_KINDS, *kinds.COUPLING):
        raise ValueError(f"unknown node type {node}")
    found = list(_TEST.finditer(tests))
    if "".join(t[0] for t in found).replace(" ", "") != re.sub(r"\s", "", tests).replace(" ", "") and len(found) != tests.count("(#"):
        raise ValueError(f"test not understood: {tests}")
    out = F.lit(True)
    for t in found:
        negated, test, column, values = t.groups()
        if column not in (capture, "lang", "path"):
            raise ValueError(f"unknown capture @{column}")
        x = F.col("name" if column == capture else column)
        words = [re.sub(r"\\(.)", r"\1", v) for v in re.findall(r"\"((?:[^\"\\]|\\.)*)\"", values)]
        hit = x.rlike(words[0]) if test == "match" else x.isin(words if test == "any-of" else words[:1])
        out &= ~hit if negated else hit
    return node, out


def search(definitions: DataFrame, usages: DataFrame, pattern: str, per_file: int | None = None, most: int | None = None) -> DataFrame:
    """(file_id, path, lang, name, start_line, start_col, id) that match, each place once. ``per_file`` and ``most``
    cap the matches by place, as the search tool does; without them all are returned. The cap per file is a row number
    that Spark limits before it shuffles, so a file with very many matches sends no more than that from a task."""
    node, wanted = condition(pattern)
    rows, key = (usages, "usage_id") if node.startswith("ref_") else (definitions, "def_id")
    hits = rows.where((F.col("kind") == node.removeprefix("ref_")) & wanted).groupBy("file_id", "path", "lang", "name", "start_line", "start_col").agg(F.min(key).alias("id"))
    place = ["path", "start_line", "start_col", "name", "id"]
    if per_file:
        from pyspark.sql import Window

        hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy(*place))).where(F.col("r") <= per_file).drop("r")
    return hits.orderBy(*place).limit(most) if most else hits
