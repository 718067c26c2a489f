"""Source text to the token trees that ``gll`` reads.

A text is cut by one pattern per language; token texts map to numbers through a table, so most of the work is done by
``re`` and ``dict``. Brackets must nest in all six languages; where they don't, or where a character begins no token, the
text is not in the language and no grammar is asked.
"""

from __future__ import annotations

import re
from functools import lru_cache

from spanlode.llm import grammars
from spanlode.llm.gll import END, NL_BIT, Grammar

OPEN = {"(": -1, "[": -3, "{": -5}
CLOSE = {")": -2, "]": -4, "}": -6}
LINE, BAD, SKIP = -7, -8, -9
_GROUP = {-2: (-1, "p"), -4: (-3, "s"), -6: (-5, "b")}
_TEXTS = 300_000

_BLOCK = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_NAME = r"[^\W\d][\w]*"

#: Reserved words.
RESERVED = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _",
    "rust": "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try _",
    "javascript": "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
}
RESERVED["typescript"] = RESERVED["javascript"]

#: Words that are names except where a rule asks for them.
CONTEXTUAL = {
    "go": "",
    "java": "record sealed permits non yield module open",
    "rust": "union auto default raw",
    "javascript": "async await yield let static of get set as from target meta accessor",
    "typescript": "async await yield let static of get set as from target meta accessor public private protected readonly abstract override declare type namespace module global keyof unique infer is asserts satisfies require out interface implements",
    "python": "match case type",
}

_C_STRING = r'"(?:[^"\\\n]|\\.)*"'
#: What a token looks like, by language; the first alternative that fits counts.
TOKENS = {
    "go": [r"\n\s*", _BLOCK, r"`[^`]*`", r'"(?:[^"\\\n]++|\\[abfnrtv\\"0-7xuU])*"', r"'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))'", _NAME,
           r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bBoO][\d_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?(?!\w)",
           r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~]"],
    "java": [r'"""[^\S\n]*\n(?:[^"\\]++|\\[\s\S]|"(?!""))*"""', r'"(?:[^"\\\n]++|\\(?:[btnfrs"\'\\0-7]|u+[\da-fA-F]{4}))*"(?!")|""(?!")', r"'(?:[^'\\\n]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[\da-fA-F]{4}))'", r"[^\W\d$]?[\w$]*(?<!\W)(?<=[A-Za-z_$])(?:[\w$]*)|" + r"[^\W\d][\w$]*|\$[\w$]*",
             r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?[lLfFdD]?|\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdD]?)(?!\w)",
             r"\.\.\.|->|::|<<=|>=|<<|&&|\|\||\+\+|--|==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^<>=!~?:;,.@()\[\]{}]"],
    "rust": [r'(?:b|c)?"(?:[^"\\]++|\\(?:[nrt\\0\'"\n]|x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,8}\}))*"', r'(?:b|c)?r"[^"]*"|(?:b|c)?r#"[\s\S]*?"#(?!#)|(?:b|c)?r##"[\s\S]*?"##|(?:b|c)?r###"[\s\S]*?"###',
             r"b?'(?:[^'\\\n\t]|\\(?:[nrt\\0'\"]|x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,8}\}))'", r"'[^\W\d]\w*(?!')", r"r#[^\W\d]\w*", _NAME,
             r"(?:0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.(?![._]|[^\W\d])(?:\d[\d_]*)?)?(?:[eE][+-]?[\d_]+)?)(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?(?!\w)",
             r"\.\.=|\.\.\.|<<=|>=|->|=>|::|\.\.|&&|\|\||<<|==|!=|<=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|[-+*/%^!&|=<>@.,;:#$?~()\[\]{}]"],
    "javascript": [r"\n\s*", _BLOCK, r"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{)|\$\{[^{}`]*\})*`", r'"(?:[^"\\\n]++|\\[\s\S])*"', r"'(?:[^'\\\n]++|\\[\s\S])*'",
                   r"(?:(?<=[(,=:\[!&|?{};])|(?<=[(,=:\[!&|?{};]\s))/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", r"#?(?:[^\W\d]|\$)[\w$]*",
                   r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?(?![\w$])",
                   r"\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\*\*|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^<>=!~?:;,.@()\[\]{}]"],
    "python": [r"\n[ \t\f]*",
               r'[fF][rR]?"(?!"")(?:[^"\\\n{}]++|\\[\s\S]|\{\{|\}\}|\{(?:[^{}"\n]|"[^"\n{}]*"|\{[^{}\n]*\})*\})*"', r"[fF][rR]?'(?!'')(?:[^'\\\n{}]++|\\[\s\S]|\{\{|\}\}|\{(?:[^{}'\n]|'[^'\n{}]*'|\{[^{}\n]*\})*\})*'",
               r'(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"""(?:[^"\\]++|\\[\s\S]|"(?!""))*"""', r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?'''(?:[^'\\]++|\\[\s\S]|'(?!''))*'''",
               r'(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"(?:[^"\\\n]++|\\[\s\S])*"', r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?'(?:[^'\\\n]++|\\[\s\S])*'", _NAME,
               r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|(?:[1-9](?:_?\d)*|0(?:_?0)*)(?![\d_])[jJ]?|\d(?:_?\d)*[jJ])(?!\w)",
               r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|<<|>>|<=|>=|==|!=|->|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|:=|[-+*/%@&|^~<>()\[\]{},:.;=]"],
}
TOKENS["java"][3] = r"(?:[^\W\d]|\$)[\w$]*"
TOKENS["typescript"] = TOKENS["javascript"]
_SPACE = {
    "go": r"(?:[ \t\r\f]+|//[^\n]*)*",
    "java": rf"(?:\s+|//[^\n]*|{_BLOCK})*",
    "rust": rf"(?:\s+|//[^\n]*|{_BLOCK})*",
    "javascript": r"(?:[^\S\n]+|﻿|//[^\n]*)*",
    "python": r"(?:[ \t\f]+|#[^\n]*|\\\n)*",
}
_SPACE["typescript"] = _SPACE["javascript"]
#: What lies between tokens besides blanks and line ends, by language.
_BETWEEN = {"go": rf"//[^\n]*|{_BLOCK}", "java": rf"//[^\n]*|{_BLOCK}", "rust": rf"//[^\n]*|{_BLOCK}", "javascript": rf"//[^\n]*|{_BLOCK}|\ufeff", "python": r"#[^\n]*|\\\n"}
_BETWEEN["typescript"] = _BETWEEN["javascript"]
#: What begins no longer token and no other: single marks, and numbers without a fraction, exponent or suffix.
_WHOLE = r"[()\[\]{},;]|\.(?=[^\W\d])|=(?![=>])|:(?![:=])|(?:0|[1-9]\d*+)(?![\w.$])"
#: Names by what ``TOKENS`` takes for a name, where no quote or mark follows that makes the letters a prefix.
_WHOLE_NAME = {"go": r"[^\W\d]\w*", "rust": r"[^\W\d]\w*+(?![\"'#])", "python": r"[^\W\d]\w*+(?![\"'])"} | dict.fromkeys(("java", "javascript", "typescript"), r"[^\W\d][\w$]*")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_FIELD = re.compile(r"\{\s*[^\W\d][\w.]*\s*(?:![rsa])?(?::[^{}]*)?\}")
_TAG = re.compile(r"<(/?)\s*([^\W\d][\w$.:-]*)?\s*")
_ATTRIBUTE = re.compile(r"[^\W\d][\w$:-]*\s*(?:=\s*(\"[^\"]*\"|'[^']*'|(?=\{)))?\s*")
_ELEMENT_TEXT = re.compile(r"[^<>{}]+")
_QUOTES = "\"'`"


class Language:
    """Grammar and lexer of one language, with the table of token texts seen so far."""

    def __init__(self, name: str, elements: bool = False):
        self.name, self.elements = name, elements
        self.grammar: Grammar = grammars.load(name)
        self.script = name in ("javascript", "typescript")
        g = self.grammar
        words = dict.fromkeys(RESERVED[name].split(), False) | dict.fromkeys(CONTEXTUAL[name].split(), True)
        self.fixed = {w: g.token(w, "NAME", "ID") if soft else g.token(w, "NAME") for w, soft in words.items()}
        self.id, self.num, self.str = g.token("ID", "NAME"), g.token("NUM"), g.token("STR")
        self.fixed |= OPEN | CLOSE | {"": SKIP}
        self.known = dict(self.fixed)
        self.pattern = re.compile(_SPACE[name] + "+(" + "|".join(TOKENS[name]) + r"|\S|\Z)")
        self.semi = g.token(";") if name == "go" else None
        self.newline = g.token("NEWLINE") if name == "python" else None
        ends = "break continue fallthrough return ++ --".split() if name == "go" else []
        self.closes = {self.id, self.num, self.str, g.token("CHAR"), *[g.token(w) for w in ends]} if name == "go" else set()

    def kind(self, text: str) -> int:
        """The number of a token text that isn't in the table yet."""
        if len(self.known) > _TEXTS:
            self.known = dict(self.fixed)
        n = self.known[text] = self._kind(text)
        return n

    def _kind(self, text: str) -> int:
        g, c, name = self.grammar, text[0], self.name
        if c == "\n":
            return LINE
        if text.startswith("/*"):
            return (LINE if "\n" in text else SKIP) if len(text) > 3 and text.endswith("*/") else BAD
        if name == "python":
            m = re.match(r"[rRbBuUfF]{0,2}(?=[\"'])", text)
            if m:
                return (self.str if self._fields(text) else BAD) if "f" in m[0].lower() else self.str if len(text) > len(m[0]) + 1 else BAD
        elif c == "`":
            if name == "go":
                return self.str if len(text) > 1 else BAD
            return self._template(text)
        elif name == "rust" and (m := re.match(r"(?:[bc]?r?#*\"|b?')", text)) and not text.startswith("r#") or name == "rust" and re.match(r"[bc]?r#+\"", text):
            if c == "'" and not text.endswith("'"):
                return g.token("LIFE") if len(text) > 1 else BAD
            if len(text) == 1:
                return BAD
            return g.token("CHAR") if "'" in text[:2] and '"' not in text[:2] else self.str
        if c in _QUOTES:
            if len(text) < 2:
                return BAD
            return g.token("CHAR") if c == "'" and name in ("go", "java", "rust") else self.str
        if c.isdigit() or (c == "." and len(text) > 1 and text[1].isdigit()):
            return self.num if len(text) > 1 or c.isdigit() else BAD
        if text.startswith("r#") and name == "rust" or c.isalpha() or c in "_$" and (len(text) > 1 or c == "_" or self.script or name == "java"):
            if text[-1] == "$" and name not in ("java", "javascript", "typescript"):
                return BAD
            return self.id
        if c == "#" and self.script:
            return g.token("PRIVATE") if len(text) > 1 else BAD
        if c == "/" and self.script and len(text) > 2:
            return g.token("REGEX")
        if text in g.terminals:
            return g.token(text)
        return BAD if len(text) == 1 and not re.match(r"[-+*/%&|^<>=!~?:;,.@#$()\[\]{}]", text) else g.token(text)

    def _part(self, text: str, rule: str) -> bool:
        tokens = self.tokens(text + ("\n" if self.name == "python" else ""))
        if tokens and self.name == "python" and tokens[-1] == self.newline:
            tokens = tokens[:-1]
        return tokens is not None and self.grammar.accepts(rule, tokens)

    def _template(self, text: str) -> int:
        """A template literal counts if what stands in its slots are expressions."""
        if len(text) < 2:
            return BAD
        ok = all(re.fullmatch(r"\s*[^\W\d][\w.]*\s*", x) or self._part(x, "Expr") for x in re.findall(r"(?<!\\)\$\{([^{}`]*)\}", text))
        return self.grammar.token("TEMPLATE") if ok else BAD

    def _fields(self, text: str) -> bool:
        """Whether the replacement fields of an f-string are expressions."""
        body = re.sub(r"^[a-zA-Z]+(\"{3}|'{3}|[\"'])([\s\S]*)\1$", r"\2", text)
        plain = _FIELD.sub("", body)
        if "{" not in plain and "}" not in plain:
            return True
        at = 0
        while at < len(body):
            c = body[at]
            if body[at : at + 2] in ("{{", "}}"):
                at += 2
            elif c == "{":
                at = self._field_end(body, at)
                if at < 0:
                    return False
            elif c == "}":
                return False
            else:
                at += 1
        return True

    def _field_end(self, body: str, at: int) -> int:
        """One past the replacement field that opens at ``at``; -1 if it holds no expression or doesn't end."""
        level, i, end, n = 0, at + 1, -1, len(body)
        while i < n:
            c = body[i]
            if c in "\"'":
                quote = body[i : i + 3] if body[i : i + 3] == c * 3 else c
                i = body.find(quote, i + len(quote)) + len(quote)
                if i < len(quote):
                    return -1
                continue
            level += (c in "([{") - (c in ")]" or c == "}" and level > 0)
            if level == 0 and (c in ":}" or c == "!" and body[i + 1 : i + 2] in ("r", "s", "a") and body[i + 2 : i + 3] in (":", "}")):
                end = i
                break
            i += 1
        if end < 0 or not self._part("(" + body[at + 1 : end].rstrip("= ") + ")", "FString"):
            return -1
        i = end + 2 if body[end] == "!" else end
        while i < n and body[i] != "}":  # the format, which may hold fields again
            i = self._field_end(body, i) if body[i] == "{" else i + 1
            if i < 0:
                return -1
        return i + 1 if i < n else -1

    def _scan(self, text: str) -> list[int]:
        """Token by token, for script texts in which a slash or a back-tick needs what stands before it."""
        out, at, match, n = [], 0, self.pattern.match, len(text)
        division = self._operands()
        before = None
        while at < n:
            m = match(text, at)
            if not m or not m[1]:
                break
            start, word = m.start(1), m[1]
            end = m.end()
            if word[0] == "/" and not word.startswith("/*"):
                r = _REGEX.match(text, start) if before not in division else None
                if r:
                    word, end = r[0], r.end()
                elif len(word) > 2:
                    word, end = "/", start + 1
            elif word == "`":
                end = self._template_end(text, start)
                if end < 0:
                    return [BAD]
                out.append(self.grammar.token("TEMPLATE"))
                before, at = out[-1], end
                continue
            elif word == "<" and self.elements and before not in division and (closed := self._element_end(text, start)) > 0:
                out.append(self.grammar.token("ELEMENT"))
                before, at = out[-1], closed
                continue
            k = self.known.get(word)
            k = self.kind(word) if k is None else k
            out.append(k)
            if k not in (LINE, SKIP):
                before = k
            at = end
        return out

    def _operands(self) -> set[int]:
        """Tokens after which a slash divides and a less-than compares."""
        g = self.grammar
        return {self.id, self.num, self.str, g.token("TEMPLATE"), g.token("REGEX"), g.token("ELEMENT"), *CLOSE.values(), *[self.fixed[w] for w in ("this", "super", "null", "true", "false")]}

    def _slot_end(self, text: str, at: int) -> int:
        """One past the brace that closes the one at ``at``; -1 if there is none or what is between is no expression."""
        j, depth, before, n = at + 1, 1, None, len(text)
        while j < n and depth:
            m = self.pattern.match(text, j)
            if not m or not m[1]:
                return -1
            j, word = m.end(), m[1]
            if word == "`":
                j = self._template_end(text, m.start(1))
            elif word == "<" and before not in self._operands() and (closed := self._element_end(text, m.start(1))) > 0:
                j, word = closed, ")"
            if j < 0:
                return -1
            depth += (word == "{") - (word == "}")
            k = self.known.get(word)
            before = (self.kind(word) if k is None else k) if not word.isspace() else before
        return j if not depth and self._part(text[at + 1 : j - 1], "Slot") else -1

    def _element_end(self, text: str, at: int) -> int:
        """One past the element that begins at ``at``; -1 if there is none: tags close in turn, slots hold expressions."""
        names, i, n = [], at, len(text)
        while i < n:
            if text[i] == "{":
                i = self._slot_end(text, i)
            elif text[i] != "<":
                m = _ELEMENT_TEXT.match(text, i)
                i = m.end() if m else -1
            else:
                m = _TAG.match(text, i)
                i = m.end()
                if m[1]:
                    if not names or names.pop() != (m[2] or "") or text[i : i + 1] != ">":
                        return -1
                    i += 1
                else:
                    i, alone = self._attributes_end(text, i)
                    if not alone:
                        names.append(m[2] or "")
            if i < 0:
                return -1
            if not names:
                return i
        return -1

    def _attributes_end(self, text: str, i: int) -> tuple[int, bool]:
        """(one past the tag whose attributes begin here or -1, whether the tag closes itself)."""
        while True:
            if text.startswith("/>", i):
                return i + 2, True
            if text[i : i + 1] == ">":
                return i + 1, False
            if text[i : i + 1] != "{":
                m = _ATTRIBUTE.match(text, i)
                if not m:
                    return -1, True
                i = m.end()
                if m[1] != "":
                    continue
            i = self._slot_end(text, i)
            if i < 0:
                return -1, True
            while text[i : i + 1].isspace():
                i += 1

    def _template_end(self, text: str, at: int) -> int:
        """One past the template literal that begins at ``at``; -1 if it doesn't end or a slot holds no expression."""
        i, n = at + 1, len(text)
        while i < n:
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1
            elif c == "$" and text[i + 1 : i + 2] == "{":
                depth, j = 1, i + 2
                while j < n and depth:
                    m = self.pattern.match(text, j)
                    if not m:
                        return -1
                    j, word = m.end(), m[1]
                    if word == "`":
                        j = self._template_end(text, m.start(1))
                        if j < 0:
                            return -1
                    depth += (word == "{") - (word == "}")
                if depth or not self._part(text[i + 2 : j - 1], "Expr"):
                    return -1
                i = j
            else:
                i += 1
        return -1

    def tokens(self, text: str) -> list[int] | None:
        """The token tree of a text as the tokens of its outermost level; None if it isn't made of tokens."""
        words = self.pattern.findall(text)
        get, kind = self.known.get, self.kind
        if self.script and ("/" in words or "/=" in words or "`" in words or self.elements and "<" in words):
            kinds = self._scan(text)
        else:
            kinds = [k if (k := get(w)) is not None else kind(w) for w in words]
        if self.name == "python":
            return self._lines(words, kinds)
        group, stack, out, nl = self.grammar.group, [], [], NL_BIT if self.script else 0
        script, semi, closes, closed = self.script, self.semi, self.closes, False
        for k in kinds:
            if k >= 0:
                if nl:
                    out.append(k | NL_BIT)
                    nl = 0
                else:
                    out.append(k)
                closed = False
            elif k == LINE:
                if script:
                    nl = NL_BIT
                elif semi is not None and out and (closed or out[-1] in closes):
                    out.append(semi)
                    closed = False
            elif k in (-1, -3, -5):
                stack.append((k, out, nl))
                out, nl, closed = [], 0, False
            elif k in _GROUP:
                opened, letter = _GROUP[k]
                if not stack or stack[-1][0] != opened:
                    return None
                token = group(letter, out)
                _, out, flag = stack.pop()
                out.append(token | flag)
                nl, closed = 0, True
            elif k == BAD:
                return None
        if stack:
            return None
        if semi is not None and out and (closed or out[-1] in closes):
            out.append(semi)
        return out

    def _lines(self, words: list[str], kinds: list[int]) -> list[int] | None:
        """Python's lines and indentation; an indented block becomes a group."""
        group, newline = self.grammar.group, self.newline
        out: list[int] = []
        stack: list = []  # open brackets and blocks
        columns, depth, column, fresh = [(0, 0)], 0, (0, 0), True  # with tabs to every eighth column, and as one blank
        for w, k in zip(words, kinds, strict=True):
            if k == SKIP:
                continue
            if k == LINE:
                if depth:
                    continue
                if not fresh:
                    out.append(newline)
                fresh, column = True, (0, 0)
                for c in w[1:]:
                    column = (column[0] + 1, column[1] + 1) if c == " " else ((column[0] // 8 + 1) * 8, column[1] + 1) if c == "\t" else (0, 0)
                continue
            if k == BAD:
                return None
            if fresh:
                fresh = False
                if column[0] > columns[-1][0]:
                    if column[1] <= columns[-1][1]:
                        return None
                    columns.append(column)
                    stack.append(("i", out))
                    out = []
                while column[0] < columns[-1][0]:
                    columns.pop()
                    token = group("i", out)
                    out = stack.pop()[1]
                    out.append(token)
                if column != columns[-1]:
                    return None
            if k >= 0:
                out.append(k)
            elif k in (-1, -3, -5):
                depth += 1
                stack.append((k, out))
                out = []
            elif k in _GROUP:
                opened, letter = _GROUP[k]
                if not stack or stack[-1][0] != opened:
                    return None
                depth -= 1
                token = group(letter, out)
                out = stack.pop()[1]
                out.append(token)
        if depth:
            return None
        if not fresh:
            out.append(newline)
        while len(columns) > 1:
            columns.pop()
            token = group("i", out)
            out = stack.pop()[1]
            out.append(token)
        return out


@lru_cache(maxsize=None)
def words(name: str) -> re.Pattern:
    """A pattern whose ``findall`` gives the token texts of a language as ``Language.pattern`` does, but none for line
    ends and comments; these come as empty texts or not at all. Names and single marks are most of a text, so they
    are tried first where nothing else can begin with them."""
    tokens = [t for t in TOKENS[name] if not t.startswith(r"\n") and t != _BLOCK]
    return re.compile(rf"\s*+(?:{_BETWEEN[name]}|({_WHOLE}|{_WHOLE_NAME[name]}|{'|'.join(tokens)}|\S|\Z))")


@lru_cache(maxsize=None)
def language(name: str, elements: bool = False) -> Language:
    return Language(name, elements)


def without_nested_comments(text: str) -> str:
    """Rust's block comments nest, which no single pattern can follow; texts that have them lose them here."""
    out, at, depth = [], 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*|\*/', text, re.S):
        if m[0] == "/*":
            if depth == 0:
                out.append(text[at : m.start()])
            depth += 1
        elif m[0] == "*/" and depth:
            depth -= 1
            if depth == 0:
                at = m.end()
                out.append(" ")
    return "".join(out) + (text[at:] if depth == 0 else "/*")


def dialects(name: str, content: bytes, elements: bool = False) -> list[str]:
    """The dialects of the language that accept the content; none if it is not valid source. With ``elements`` also
    those with element syntax, asked where the plain ones reject it.

    A byte-order mark and any line ends are allowed. Bytes that aren't UTF-8 are not valid source, nor are templates,
    elements or format fields nested in each other deeper than the interpreter's stack.
    """
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return []
    text = text.removeprefix("﻿")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!") and name in ("javascript", "typescript", "rust") and not text.startswith("#!["):
        text = "\n" + text.partition("\n")[2]
    if not text.strip():
        return list(language(name).grammar.starts)
    if name == "rust" and re.search(r"/\*(?:(?!\*/)[\s\S])*/\*", text):
        text = without_nested_comments(text)
    if name == "python":
        column = re.match(r"[ \t\f]*", text)[0]
        text = "\n" + column + text[len(column) :] if column else text
    try:
        found = _accepted(language(name), text)
        return found if found or not elements else [f"{d}WithElements" for d in _accepted(language(name, True), text)]
    except RecursionError:
        return []


def _accepted(lang: Language, text: str) -> list[str]:
    tokens = lang.tokens(text)
    return [] if tokens is None else lang.grammar.accepted_by(tokens)


assert END == 0
