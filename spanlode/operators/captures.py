"""Usages of names in source text.

A file is cut into tokens by one pattern per language; a name that is neither a word of the language nor the one being
defined is a usage. What kind it is follows from the tokens beside it and the first word of its line:

1. ``import`` on a line that begins with an import word
2. ``annotation`` after ``@``, in Rust on a line that begins with ``#``
3. ``inherit`` after ``extends`` or ``implements``, in Python on a ``class`` line, in Rust after ``impl`` before ``for``
4. ``type_ref`` after ``new``, ``:``, ``->``, ``<`` or ``instanceof`` if the name begins with a capital
5. ``call`` before ``(``
6. ``write`` before an assignment
7. ``read`` otherwise
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlode.functions import kinds

_C_TEXT = r'/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
#: Comments and texts of a language, which hold no names.
TEXTS = {
    "go": r"//[^\n]*|`[^`]*`|" + _C_TEXT, "java": r"//[^\n]*|" + _C_TEXT, "rust": r'//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\.)\'|\'\w+',
    "javascript": r"//[^\n]*|`[^`]*`|" + _C_TEXT, "typescript": r"//[^\n]*|`[^`]*`|" + _C_TEXT,
    "python": r'#[^\n]*|"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'',
}
#: Other tokens.
REST = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|:=|->|=>|===?|!==?|<=|>=|[-+*/%&|^]=|[^\sA-Za-z0-9_$]|\n"
#: Words of a language that are no names.
WORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static super switch synchronized this throw throws transient try void volatile while true false null var record",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "javascript": "async await break case catch class const continue debugger default delete do else enum export extends false finally for from function get if import in instanceof let new null of return set static super switch this throw true try typeof undefined var void while with yield",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return self try while with yield",
}
WORDS["typescript"] = WORDS["javascript"] + " abstract any as boolean constructor declare implements interface keyof namespace never number object private protected public readonly string type unknown"
#: Words after which a name is defined, words that begin an import, what stands before a type and before a value is written.
DEFINE = "func function def fn class struct interface enum trait type mod package namespace const let var static mut record".split()
IMPORT = {"go": "import", "java": "import package", "rust": "use mod", "python": "import from", "javascript": "import", "typescript": "import"}
TYPED = [":", "->", "new", "<", "instanceof"]
ASSIGN = ["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="]
_TOKENS = {lang: re.compile(f"{texts}|{REST}") for lang, texts in TEXTS.items()}
_WORDS = {lang: frozenset(w.split()) for lang, w in WORDS.items()}


def usages_of(language: str, text: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, line from 1, column from 0) of the usages in a text."""
    words, imports, out = _WORDS[language], IMPORT[language].split(), []
    line, begin, head, before = 1, 0, "", ""
    tokens = [(m[0], m.start()) for m in _TOKENS[language].finditer(text)]
    for i, (token, at) in enumerate(tokens):
        if token == "\n":
            line, begin, head, before = line + 1, at + 1, "", ""
            continue
        if token[0] in "\"'`#/" and len(token) > 1 and token != "/=":  # comments and texts, whose lines count
            if "\n" in token:
                line, begin = line + token.count("\n"), at + token.rindex("\n") + 1
            if not token.startswith(("//", "/*")) and not (token[0] == "#" and language == "python"):
                head, before = head or token, token
            continue
        head = head or token
        if (token[0].isalpha() or token[0] in "_$") and token not in words and not (before in DEFINE and head not in imports):
            after = tokens[i + 1][0] if i + 1 < len(tokens) else ""
            if head in imports:
                kind = "import"
            elif before == "@" or language == "rust" and head == "#":
                kind = "annotation"
            elif before in ("extends", "implements") or language == "python" and head == "class" or language == "rust" and before == "impl" and after == "for":
                kind = "inherit"
            elif before in TYPED and token[0].isupper():
                kind = "type_ref"
            else:
                kind = "call" if after == "(" else "write" if after in ASSIGN else "read"
            out.append((token, kind, line, at - begin))
        before = token
    return out


def captured_usages(files: DataFrame) -> DataFrame:
    """(file_id, language, name, kind, start_line, start_col): the usages in every distinct file of a known language.

    Files are cut where they are read, once per file_id; nothing but their usages leaves a task. Line ends are of any
    kind, bytes that aren't UTF-8 are replaced; null and empty contents have none. Columns count characters from 0.
    """
    rows = files.where(F.col("file_id").isNotNull() & F.col("content").isNotNull()).select("file_id", kinds.language(F.col("path")).alias("language"), "content")
    rows = rows.where(F.col("language").isNotNull())
    schema = "file_id long, language string, name string, kind string, start_line int, start_col int"
    out = pa.schema([("file_id", pa.int64()), ("language", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("start_col", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, found = [], [], []
            for file_id, lang, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = content.as_py().decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
                got = usages_of(lang, text)
                found += got
                ids += [file_id] * len(got)
                langs += [lang] * len(got)
            cols = list(zip(*found)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, langs, *map(list, cols)], out, strict=True)], schema=out)

    return rows.mapInArrow(work, schema).distinct()  # a redelivered file is captured twice
