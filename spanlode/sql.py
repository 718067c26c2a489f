"""SQL of the queries in ``queries``, written pair by pair and row by row, not the way the operators work.

Weights, word lists and patterns are written out here again, so that a wrong one in the operators shows.
"""

from __future__ import annotations

from spanlode.queries import AFTER, BEFORE, CHANGED, PATTERN, SEARCHED

_SEGMENTS = "list_has_any(string_split(lower({p}), '/'), {names})"
_MIGRATIONS = "['migrations', 'migration', 'migrate', 'db_migrate', 'alembic', 'flyway', 'liquibase']"
_FAKES = "['fixtures', '__fixtures__', 'mocks', 'stubs', 'fake', 'fakes']"
_TESTS = "['testdata', 'test', 'tests', '__tests__', 'spec', 'specs', 'generated', 'gen', 'vendor', 'pb', 'proto']"
_SUFFIX = "regexp_matches(lower({p}), '(_test\\.go|\\.(test|spec)\\.(ts|tsx|js|jsx))$')"


def _noise(path: str) -> str:
    of = lambda names: _SEGMENTS.format(p=path, names=names)
    return f"CASE WHEN {of(_MIGRATIONS)} THEN 0.45::DOUBLE WHEN {of(_FAKES)} THEN 0.4::DOUBLE WHEN {of(_TESTS)} THEN 0.35::DOUBLE WHEN {_SUFFIX.format(p=path)} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END"


def _noisy(path: str) -> str:
    lists = " OR ".join(_SEGMENTS.format(p=path, names=n) for n in (_MIGRATIONS, _FAKES, _TESTS, "['db_migration']"))
    return f"({lists} OR {_SUFFIX.format(p=path)})"


_TYPES = "('class', 'struct', 'interface', 'enum', 'type_alias', 'trait')"
_VALUES = "('variable', 'field', 'property', 'parameter')"
_CALLABLES = "('function', 'method', 'constructor')"
_ORDER = """CASE d.kind WHEN 'package' THEN 1 WHEN 'class' THEN 2 WHEN 'interface' THEN 3 WHEN 'struct' THEN 4 WHEN 'enum' THEN 5 WHEN 'function' THEN 6 WHEN 'method' THEN 7 WHEN 'property' THEN 8
  WHEN 'field' THEN 9 WHEN 'variable' THEN 10 WHEN 'constant' THEN 11 WHEN 'constructor' THEN 12 WHEN 'type_alias' THEN 13 WHEN 'trait' THEN 14 WHEN 'module' THEN 15 ELSE 0 END"""
_KIND_WEIGHT = """CASE WHEN kind IN ('class', 'interface', 'struct', 'enum', 'trait') THEN 0.4::DOUBLE WHEN kind = 'type_alias' THEN 0.3::DOUBLE WHEN kind IN ('function', 'method', 'constructor') THEN 0.2::DOUBLE
  WHEN kind = 'constant' THEN 0.1::DOUBLE WHEN kind IN ('variable', 'field', 'property', 'parameter') THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END"""
_CONFIDENCE = f"round(greatest(0.0, least(1.0, 0.5::DOUBLE + {_KIND_WEIGHT} - {_noise('path')})) * 10000) / 10000"
_STRENGTH = "CASE kind WHEN 'inherit' THEN 1.0::DOUBLE WHEN 'call' THEN 0.65::DOUBLE WHEN 'write' THEN 0.55::DOUBLE WHEN 'read' THEN 0.5::DOUBLE WHEN 'import' THEN 0.4::DOUBLE WHEN 'type_ref' THEN 0.25::DOUBLE WHEN 'annotation' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END"
_COUPLING = f"CASE WHEN relation IN ('inherits', 'implements') THEN 1.0::DOUBLE WHEN relation = 'prototype' THEN greatest({_STRENGTH}, 0.8::DOUBLE) ELSE {_STRENGTH} END"
_DIR = "CASE WHEN regexp_replace({p}, '/?[^/]*$', '') = '' THEN '.' ELSE regexp_replace({p}, '/?[^/]*$', '') END"
_FIT = f"""CASE u.kind WHEN 'import' THEN 30 WHEN 'type_ref' THEN CASE WHEN d.kind IN {_TYPES} THEN 25 ELSE 6 END WHEN 'inherit' THEN CASE WHEN d.kind IN ('class', 'interface', 'trait') THEN 30 ELSE 5 END
  WHEN 'call' THEN CASE WHEN d.kind IN {_CALLABLES} THEN 25 ELSE 6 END WHEN 'write' THEN CASE WHEN d.kind IN ('field', 'variable', 'property') THEN 20 ELSE 7 END
  WHEN 'read' THEN CASE WHEN d.kind IN ('field', 'variable', 'property', 'constant') THEN 15 ELSE 8 END WHEN 'annotation' THEN 12 ELSE 10 END::BIGINT"""
_U = "u AS (SELECT DISTINCT usage_id, project_id, file_id, path, lang, name, kind, context_container, relation, receiver_type, target_type, start_line, start_col, end_line FROM usages)"
_D = "d AS (SELECT DISTINCT def_id, project_id, file_id, path, lang, name, kind, container, start_line, start_col, end_line, end_col FROM definitions)"
_FIRST = f"""first AS (SELECT *, row_number() OVER (PARTITION BY project_id, name, lang ORDER BY {_ORDER}, path, start_line, start_col, def_id) AS r,
  count(*) OVER (PARTITION BY project_id, name, lang) AS candidates FROM d), prime AS (SELECT * FROM first WHERE r = 1)"""
_RESOLVED = f"""pairs AS (SELECT u.usage_id, d.def_id,
  (CASE WHEN u.file_id = d.file_id THEN 12 WHEN {_DIR.format(p="u.path")} = {_DIR.format(p="d.path")} THEN 6 ELSE 4 END)
  * (CASE WHEN u.context_container <> '' AND u.context_container = d.container THEN 3 ELSE 2 END) * {_FIT} AS w, {_ORDER} AS o, d.path, d.start_line, d.start_col
  FROM u JOIN d USING (project_id, name, lang)),
 sums AS (SELECT usage_id, count(*) AS candidates, sum(w) AS total, max(w) AS top FROM pairs GROUP BY usage_id),
 best AS (SELECT usage_id, def_id FROM (SELECT *, row_number() OVER (PARTITION BY usage_id ORDER BY w DESC, o, path, start_line, start_col, def_id) AS r FROM pairs) WHERE r = 1),
 resolved AS (SELECT u.*, coalesce(candidates, 0) AS candidates, coalesce(round(top::DOUBLE / total::DOUBLE * 10000) / 10000, 0.0)::DOUBLE AS confidence, best.def_id AS best_def_id
  FROM u LEFT JOIN sums USING (usage_id) LEFT JOIN best USING (usage_id))"""


def _edges(least: float) -> str:
    return f"""meant AS (SELECT u.*, prime.path AS to_path, round(pairs.w::DOUBLE / sums.total::DOUBLE * 10000) / 10000 AS score FROM u JOIN prime USING (project_id, name, lang) JOIN sums USING (usage_id) JOIN pairs ON pairs.usage_id = u.usage_id AND pairs.def_id = prime.def_id),
 flagged AS (SELECT *, max(score >= {least}) OVER (PARTITION BY project_id, name, lang) AS any_left FROM meant),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id, name, lang, path ORDER BY score DESC, start_line, start_col, usage_id) AS r, count(*) OVER (PARTITION BY project_id, name, lang, path) AS n FROM flagged WHERE score >= {least} OR NOT any_left),
 inbound AS (SELECT project_id, name, lang, path, to_path, CASE WHEN any_left THEN n ELSE 1 END AS n_usages, score AS max_score, kind, relation, receiver_type, target_type FROM numbered WHERE r = 1)"""


_OUT = f"""spans AS (SELECT d.def_id, d.file_id, d.path AS at_path, m.project_id, m.lang, m.name, m.kind, m.relation, m.receiver_type, m.target_type, m.start_line, m.start_col, m.usage_id,
   CASE m.kind WHEN 'inherit' THEN 100 WHEN 'call' THEN 70 WHEN 'write' THEN 60 WHEN 'import' THEN 50 WHEN 'type_ref' THEN 40 WHEN 'read' THEN 30 ELSE 10 END AS p
  FROM d JOIN u m ON m.file_id = d.file_id AND m.start_line BETWEEN d.start_line AND greatest(d.end_line, d.start_line) WHERE m.name <> d.name),
 told AS (SELECT *, row_number() OVER (PARTITION BY def_id, lang, name ORDER BY p DESC, start_line, start_col, usage_id) AS r, count(*) OVER (PARTITION BY def_id, lang, name) AS n_usages FROM spans),
 aims AS (SELECT t.def_id AS from_id, t.name AS used_name, t.n_usages, t.kind, t.relation, t.receiver_type, t.target_type, d.def_id AS target_def_id, d.path AS target_path, t.at_path,
   row_number() OVER (PARTITION BY t.def_id, t.lang, t.name ORDER BY CASE WHEN d.file_id = t.file_id THEN 0 WHEN {_DIR.format(p="d.path")} = {_DIR.format(p="t.at_path")} THEN 1 ELSE 2 END, {_ORDER}, d.path, d.start_line, d.start_col, d.def_id) AS r,
   count(*) OVER (PARTITION BY t.def_id, t.lang, t.name) AS candidates FROM told t JOIN d USING (project_id, name, lang) WHERE t.r = 1),
 outbound AS (SELECT from_id AS def_id, used_name, n_usages, kind, relation, receiver_type, target_type, round(1 / sqrt(candidates), 6) AS score, target_def_id, target_path, at_path FROM aims WHERE r = 1)"""
_LANGUAGE = """CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python'
  WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'cts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' END"""
_LINES = f"""texts AS (SELECT DISTINCT ON (file_id) file_id, project_id, path, {_LANGUAGE} AS language, string_split(replace(replace(decode(content), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM source_files),
 lines AS (SELECT file_id, project_id, path, language, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM texts)"""
_DEFINITIONS = (
    ("go", "function", r"^func (\w+)"),
    ("go", "method", r"^func \([^)]*\) (\w+)"),
    ("go", "struct", r"^type (\w+) struct\b"),
    ("go", "interface", r"^type (\w+) interface\b"),
    ("go", "constant", r"^const (\w+) ="),
    ("go", "variable", r"^var (\w+) ="),
    ("java", "class", r"^(?:public |final |abstract )*class (\w+)"),
    ("java", "interface", r"^(?:public )?interface (\w+)"),
    ("java", "constructor", r"^\s+(?:public |private |protected )?([A-Z]\w*)\([^;=()]*\) (?:throws [\w., ]+ )?\{"),
    ("java", "method", r"^\s+(?:public |private |protected |static |final )*[\w<>,\[\]]+ (\w+)\([^;=]*\) (?:throws [\w., ]+ )?\{"),
    ("java", "enum", r"^\s*(?:public |private |protected |static )*enum (\w+)"),
    ("java", "field", r"^\s+(?:private|public|protected|static) [\w<>,\[\] ]+ (\w+)(?: =|;)"),
    ("java", "variable", r"^\s+(?:final )?[\w.]+(?:<[\w<>,.? ]*>)?(?:\[\])* (\w+) = "),
    ("python", "class", r"^class (\w+)"),
    ("python", "function", r"^(?:async )?def (\w+)"),
    ("python", "method", r"^\s+(?:async )?def (\w+)"),
    ("python", "constant", r"^\s*([A-Z0-9_]*[A-Z][A-Z0-9_]*)(?:: [^=]+)? (?://|\*\*|<<|>>|[-+*/%&|^@])?= "),
    ("python", "variable", r"^\s*([A-Za-z_]\w*)(?:: [^=]+)? (?://|\*\*|<<|>>|[-+*/%&|^@])?= "),
    ("rust", "function", r"^(?:pub(?:\([\w: ]+\))? )?(?:const |async |unsafe )*fn (\w+)"),
    ("rust", "method", r"^\s+(?:pub(?:\([\w: ]+\))? )?(?:const |async |unsafe )*fn (\w+)"),
    ("rust", "struct", r"^(?:pub(?:\([\w: ]+\))? )?struct (\w+)"),
    ("rust", "enum", r"^(?:pub(?:\([\w: ]+\))? )?enum (\w+)"),
    ("rust", "constant", r"^\s*(?:pub(?:\([\w: ]+\))? )?(?:const|static)(?: mut)? (\w+):"),
    ("rust", "trait", r"^\s*(?:pub(?:\([\w: ]+\))? )?(?:unsafe )?trait (\w+)"),
    ("rust", "type_alias", r"^\s*(?:pub(?:\([\w: ]+\))? )?type (\w+)"),
    ("rust", "module", r"^\s*(?:pub(?:\([\w: ]+\))? )?mod (\w+)"),
    ("rust", "variable", r"^\s*let (?:mut )?([a-z_]\w*)"),
    ("javascript", "class", r"^(?:export )?(?:default )?class (\w+)"),
    ("javascript", "function", r"^(?:export )?(?:async )?function (\w+)"),
    ("javascript", "variable", r"^\s*(?:export )?(?:const|let|var) (\w+)(?: =|;)"),
    ("javascript", "constructor", r"^\s+(constructor)\("),
    ("javascript", "method", r"^\s+(?:static |async |get |set )*(#?\w+)\([^()]*\) \{"),
    ("typescript", "class", r"^(?:export )?(?:abstract )?class (\w+)"),
    ("typescript", "interface", r"^(?:export )?interface (\w+)"),
    ("typescript", "type_alias", r"^(?:export )?type (\w+) ="),
    ("typescript", "function", r"^(?:export )?(?:async )?function (\w+)"),
    ("typescript", "enum", r"^\s*(?:export )?(?:declare )?(?:const )?enum (\w+)"),
    ("typescript", "module", r"^\s*(?:export )?(?:declare )?(?:namespace|module) (\w+)"),
    ("typescript", "variable", r"^\s*(?:export )?(?:const|let|var) (\w+)(?::[^=;]*)?(?: =|;)"),
    ("typescript", "constructor", r"^\s+(?:public |private |protected )?(constructor)\("),
    ("typescript", "method", r"^\s+(?:public |private |protected |static |override |async |get |set )*(#?\w+)(?:<[^>]*>)?\([^()]*\)(?:: [^;{]+)? \{"),
    ("typescript", "method", r"^\s+(?:public |protected )?abstract (\w+)(?:<[^>]*>)?\([^()]*\)(?:: [^{]+)?;"),
    ("typescript", "field", r"^\s+(?:public |private |protected |static |readonly |declare )+(#?\w+)[?!]?(?:: [^=;]+)?(?: =|;)"),
)
_CAPTURES = (
    "captures AS (SELECT file_id, path, language, line_no, c.kind AS kind, c.name AS name FROM (SELECT *, CASE "
    + " ".join(f"WHEN language = '{lang}' AND regexp_matches(line, '{p}') THEN {{'kind': '{kind}', 'name': regexp_extract(line, '{p}', 1)}}" for lang, kind, p in _DEFINITIONS)
    + " END AS c FROM lines) WHERE c IS NOT NULL)"
)
_DOC_LINES = {
    "go": r"^(//|/\*|\*)|\*/$", "java": r"^(//|/\*|\*|@)|\*/$", "typescript": r"^(//|/\*|\*|@)|\*/$", "javascript": r"^(//|/\*|\*|@)|\*/$",
    "rust": r"^(///|//!|//|#\[|#!\[)", "python": r"^(#|@)",
}
_DOC = "CASE language " + " ".join(f"WHEN '{lang}' THEN regexp_matches(trim(line), '{p}')" for lang, p in _DOC_LINES.items()) + " ELSE false END"
_DOCS = f"""dl AS (SELECT file_id, line_no, line_no - row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS run FROM lines WHERE {_DOC}),
 runs AS (SELECT file_id, min(line_no) AS a, max(line_no) + 1 AS below FROM dl GROUP BY file_id, run)"""
_CHUNKS = "chunks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_uid, chunk_ordinal ORDER BY indexed_at DESC NULLS LAST, status DESC NULLS LAST, file_status DESC NULLS LAST, title DESC NULLS LAST, chunk_heading DESC NULLS LAST, chunk_text DESC NULLS LAST, symbol_text DESC NULLS LAST) AS r FROM memory_chunks) WHERE r = 1)"
_TERMS = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '')"
_HEAD = "^#{1,6}[ \\t]+(\\S.*)$"

_ON_LINE = f"""(CASE WHEN coalesce(l.line, '') = '' OR NOT contains(l.line, u.name) THEN 10 WHEN regexp_matches(l.line, '\\bnew\\s+[0-9A-Za-z_]+') THEN CASE WHEN d.kind IN {_TYPES} OR d.kind = 'constructor' THEN 20 ELSE 5 END
  WHEN regexp_matches(l.line, '\\b(extends|implements)\\s+[0-9A-Za-z_]+') THEN CASE WHEN d.kind IN {_TYPES} THEN 20 ELSE 5 END WHEN contains(l.line, '.' || u.name) THEN CASE WHEN d.kind IN ('field', 'property', 'method') THEN 20 ELSE 8 END
  WHEN contains(l.line, u.name || '(') THEN CASE WHEN d.kind IN {_CALLABLES} THEN 20 ELSE 7 END WHEN regexp_matches(l.line, ':\\s*[A-Z][0-9A-Za-z_]*|->\\s*[A-Za-z_]') THEN CASE WHEN d.kind IN {_TYPES} THEN 16 ELSE 10 END ELSE 10 END)"""
_RESOLVED_ON_LINE = _RESOLVED.replace(f"{_FIT} AS w", f"{_FIT} * {_ON_LINE} AS w").replace("FROM u JOIN d USING (project_id, name, lang))", "FROM u JOIN d USING (project_id, name, lang) LEFT JOIN lines l ON l.file_id = u.file_id AND l.line_no = u.start_line)")
_MAKES = " OR ".join(f"contains(line, '{a}' || name || '{b}')" for a, b in (("new ", "("), ("new ", "{"), ("new ", " {"), ("&", "{"), ("&", " {"), ("", "{"), ("", " {"), ("", "::new"), ("", "::New")))
_CLEAN = "array_to_string(list_reduce(list_prepend([], list_transform(list_filter(string_split({p}, '/'), lambda s: s NOT IN ('', '.')), lambda s: [s])), lambda a, s: CASE WHEN s[1] = '..' THEN a[:-2] ELSE a || s END), '/')"
_CALLS = "SELECT file_id, path, lang, name, start_line, start_col, min(usage_id) AS id FROM usages WHERE kind = 'call' AND name IN ('get', 'append', 'run') GROUP BY ALL"
_C_TEXT = r'/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
#: Comments and texts of a language, which hold no names.
_TEXTS = {
    "go": r"//[^\n]*|`[^`]*`|" + _C_TEXT, "java": r"//[^\n]*|" + _C_TEXT, "rust": r'//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\.)\'|\'\w+',
    "javascript": r"//[^\n]*|`[^`]*`|" + _C_TEXT, "typescript": r"//[^\n]*|`[^`]*`|" + _C_TEXT,
    "python": r'#[^\n]*|"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'',
}
#: Words that are no names.
_NO_NAMES = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static super switch synchronized this throw throws transient try void volatile while true false null var record",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "javascript": "async await break case catch class const continue debugger default delete do else enum export extends false finally for from function get if import in instanceof let new null of return set static super switch this throw true try typeof undefined var void while with yield",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return self try while with yield",
}
_NO_NAMES["typescript"] = _NO_NAMES["javascript"] + " abstract any as boolean constructor declare implements interface keyof namespace never number object private protected public readonly string type unknown"
_REST = r"\n|[^\S\n]+|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|:=|->|=>|===?|!==?|<=|>=|[-+*/%&|^]=|[^\sA-Za-z0-9_$]"
_CUT = "CASE language " + " ".join("WHEN '{}' THEN regexp_extract_all(t, '{}')".format(k, (v + "|" + _REST).replace("'", "''")) for k, v in _TEXTS.items()) + " END"
_NAMELESS = "CASE language " + " ".join("WHEN '{}' THEN w IN ('{}')".format(k, "', '".join(v.split())) for k, v in _NO_NAMES.items()) + " END"
_USED = f"""src AS (SELECT DISTINCT ON (file_id) file_id, {_LANGUAGE} AS language, regexp_replace(replace(replace(decode(content), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\ufeff', '') AS t FROM source_files),
 cut AS (SELECT file_id, language, {_CUT} AS ws FROM src WHERE language IS NOT NULL), tok AS (SELECT file_id, language, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
 pos AS (SELECT *, sum(length(w)) OVER o - length(w) AS at_char, 1 + sum(length(w) - length(replace(w, chr(10), ''))) OVER o - (length(w) - length(replace(w, chr(10), ''))) AS line,
   sum((w = chr(10))::INT) OVER o AS seg, w LIKE '//%' OR w LIKE '/*%' OR (language = 'python' AND w LIKE '#%') AS comment FROM tok WINDOW o AS (PARTITION BY file_id ORDER BY i)),
 ends AS (SELECT *, coalesce(max(CASE WHEN contains(w, chr(10)) THEN at_char + length(w) - position(chr(10) IN reverse(w)) + 1 END) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM pos),
 near AS (SELECT *, coalesce(lead(w) OVER (PARTITION BY file_id ORDER BY i), '') AS after FROM ends WHERE NOT regexp_full_match(w, '[^\\S\\n]+')),
 told AS (SELECT *, coalesce(lag(w) OVER s, '') AS before, first_value(w) OVER s AS head FROM near WHERE w <> chr(10) AND NOT comment WINDOW s AS (PARTITION BY file_id, seg ORDER BY i)),
 imp AS (SELECT *, CASE language WHEN 'java' THEN head IN ('import', 'package') WHEN 'rust' THEN head IN ('use', 'mod') WHEN 'python' THEN head IN ('import', 'from') ELSE head = 'import' END AS imports FROM told),
 used AS (SELECT file_id, language, w AS name, CASE WHEN imports THEN 'import' WHEN before = '@' OR (language = 'rust' AND head = '#') THEN 'annotation'
   WHEN before IN ('extends', 'implements') OR (language = 'python' AND head = 'class') OR (language = 'rust' AND before = 'impl' AND after = 'for') THEN 'inherit'
   WHEN before IN (':', '->', 'new', '<', 'instanceof') AND regexp_matches(w, '^[A-Z]') THEN 'type_ref' WHEN after = '(' THEN 'call' WHEN after IN ('=', ':=', '+=', '-=', '*=', '/=', '%=', '&=', '|=', '^=') THEN 'write' ELSE 'read' END AS kind,
   line::INTEGER AS start_line, (at_char - begins)::INTEGER AS start_col FROM imp
  WHERE regexp_matches(w, '^[A-Za-z_$]') AND NOT ({_NAMELESS}) AND NOT (NOT imports AND before IN ('func', 'function', 'def', 'fn', 'class', 'struct', 'interface', 'enum', 'trait', 'type', 'mod', 'package', 'namespace', 'const', 'let', 'var', 'static', 'mut', 'record')))"""
_GLOBS = {"tests": "[^/]*_test\\.go", "scripts": "scripts/[^/]*", "internal_one_deep": "internal/[^/]*/[^/]*", "typescript": "[^/]*\\.[mt]s[^/]*", "one_letter": "[^/]ib/[^/]*\\.rs"}

_NEW = f"""new AS (SELECT project_id, path, arg_max(sha256, struct_pack(i := indexed_at, f := file_id)) AS sha, arg_max(file_id, struct_pack(i := indexed_at, f := file_id)) AS file_id FROM (SELECT DISTINCT file_id, project_id, path, sha256, indexed_at, removed_at FROM source_files)
  WHERE indexed_at <= TIMESTAMPTZ '{AFTER}+00' AND (removed_at IS NULL OR removed_at > TIMESTAMPTZ '{AFTER}+00') GROUP BY ALL)"""
_OLD = _NEW.replace("new AS", "old AS").replace(AFTER, BEFORE)

SQL = {
    "reindexed_definitions": f"""WITH {_LINES}, {_CAPTURES}, {_NEW}, {_OLD}, skipped AS (SELECT project_id, path, o.file_id FROM old o JOIN new n USING (project_id, path) WHERE o.sha = n.sha AND n.sha <> ''),
 f AS (SELECT project_id, path, file_id FROM skipped UNION ALL SELECT project_id, path, file_id FROM new WHERE (project_id, path) NOT IN (SELECT project_id, path FROM skipped))
 SELECT f.project_id, f.path, file_id, kind, name, line_no::INTEGER AS line_no FROM captures c JOIN f USING (file_id)""",
    "second_reconcile": f"WITH {_NEW} SELECT CASE WHEN coalesce(sha, '') = '' THEN 'index' ELSE 'skip' END AS action, coalesce(sha, '') <> '' AS has_digest, count(*) AS paths FROM new GROUP BY ALL",
    "definitions_at_cursors": f"""WITH {_U}, {_D}, c AS (SELECT usage_id AS cursor_id, project_id, lang, file_id, path AS at_path, start_line, start_col + 1 AS col FROM u),
 s AS (SELECT file_id, start_line, start_col, end_col, name, 0 AS p FROM definitions UNION SELECT file_id, start_line, start_col, end_col, name, 1 FROM usages),
 m AS (SELECT c.*, s.name, row_number() OVER (PARTITION BY c.cursor_id ORDER BY s.p, s.start_col, s.name) AS r FROM c LEFT JOIN s ON s.file_id = c.file_id AND s.start_line = c.start_line AND c.col BETWEEN s.start_col AND s.end_col),
 k AS (SELECT m.cursor_id, m.name, m.at_path, d.def_id, d.path, d.kind, count(d.def_id) OVER (PARTITION BY m.cursor_id) AS candidates,
   row_number() OVER (PARTITION BY m.cursor_id ORDER BY CASE WHEN d.file_id = m.file_id THEN 0 ELSE 1 END, {_ORDER}, d.path, d.start_line, d.start_col, d.def_id) AS r FROM (SELECT * FROM m WHERE r = 1) m LEFT JOIN d USING (project_id, name, lang))
 SELECT cursor_id, name, def_id, path, candidates, CASE WHEN path IS NOT NULL THEN round(greatest(0.0, least(1.0, 0.5::DOUBLE + {_KIND_WEIGHT} - {_noise('path')} + CASE WHEN path = at_path THEN 0.25::DOUBLE WHEN {_DIR.format(p='path')} = {_DIR.format(p='at_path')} THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END)) * 10000) / 10000 END AS confidence FROM k WHERE r = 1""",
    "source_directories": """WITH f AS (SELECT DISTINCT file_id, project_id, path, string_split(path, '/') AS s FROM source_files WHERE removed_at IS NULL), a AS (SELECT project_id, s, unnest(range(1, len(s))) AS n FROM f)
 SELECT project_id, array_to_string(s[1:n], '/') AS directory, count(*) AS n_files FROM a GROUP BY ALL""",
    "node_names": """SELECT DISTINCT def_id, CASE WHEN length(path) <= 24 THEN path ELSE left(path, 8) || '...' || right(path, 13) END AS short_path,
 CASE WHEN regexp_matches(path, '^[0-9]') THEN 'n' ELSE '' END || regexp_replace(path || ':' || name || ':' || start_line, '[^A-Za-z0-9]', '_', 'g') AS node, name AS symbol FROM definitions""",
    "captured_usages": f"WITH {_USED} SELECT DISTINCT file_id, language, name, kind, start_line, start_col FROM used",
    "undefined_usages": f"""WITH {_USED}, {_LINES}, {_CAPTURES} SELECT u.language, u.kind, count(*) AS n_usages, count(*) FILTER (u.kind <> 'import' AND (u.file_id, u.name) NOT IN (SELECT file_id, name FROM captures)) AS defined_elsewhere
 FROM (SELECT DISTINCT * FROM used) u GROUP BY ALL""",
    "resolution_scores_by_line": f"WITH {_U}, {_D}, {_LINES}, {_RESOLVED_ON_LINE} SELECT usage_id, candidates, confidence, best_def_id FROM resolved",
    "coupling_scores_by_line": f"""WITH {_U}, {_LINES}, s AS (SELECT usage_id, u.name, l.line, {_COUPLING} AS b FROM u LEFT JOIN lines l ON l.file_id = u.file_id AND l.line_no = u.start_line)
 SELECT usage_id, line IS NOT NULL AS has_line, CASE WHEN b >= 0.99 OR coalesce(line, '') = '' THEN b WHEN contains(line, 'extends ' || name) OR contains(line, 'implements ' || name) THEN 1.0 WHEN {_MAKES} THEN greatest(b, 0.95) ELSE b END::DOUBLE AS score FROM s""",
    "definition_code": f"""WITH {_LINES}, {_D}, {_DOCS}, x AS (SELECT d.def_id, d.file_id, d.path, d.name, d.kind, coalesce(r.a, d.start_line) AS a, greatest(d.start_line, d.end_line) AS b FROM d LEFT JOIN runs r ON r.file_id = d.file_id AND r.below = d.start_line),
 r AS (SELECT def_id, any_value('--- ' || x.path || ':' || a || '-' || b || ' (' || x.name || ' ' || x.kind || ') ---') AS h, string_agg(format('{{:6d}}| {{}}', line_no, line), chr(10) ORDER BY line_no) AS c
  FROM x JOIN lines l ON l.file_id = x.file_id AND l.line_no BETWEEN a AND b GROUP BY def_id) SELECT def_id, h || chr(10) || c AS code FROM r""",
    "usage_code": f"""WITH {_LINES}, {_U}, s AS (SELECT DISTINCT file_id, greatest(start_line - 2, 1) AS a, end_line + 2 AS b FROM u), m AS (SELECT file_id, a, max(b) AS b FROM s GROUP BY ALL),
 n AS (SELECT *, max(b) OVER (PARTITION BY file_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m), i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY a) AS island FROM n),
 w AS (SELECT file_id, min(a) AS a, max(b) AS b FROM i GROUP BY file_id, island), r AS (SELECT w.file_id, a, any_value('--- ' || a || '-' || b || ' ---') || chr(10) || string_agg(format('{{:6d}}| {{}}', line_no, line), chr(10) ORDER BY line_no) AS code
  FROM w JOIN lines l ON l.file_id = w.file_id AND l.line_no BETWEEN a AND b GROUP BY w.file_id, a)
 SELECT file_id, a AS first_line, code FROM r""",
    "pattern_matches": f"SELECT file_id, path, lang, name, start_line, start_col, min(def_id) AS id FROM definitions WHERE kind = 'function' AND regexp_matches(name, '^get') AND lang <> 'java' GROUP BY ALL UNION ALL {_CALLS}",
    "capped_matches": f"SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY path, start_line, start_col, name, id) AS r FROM ({_CALLS})) WHERE r <= 100 ORDER BY path, start_line, start_col, name, id LIMIT 500",
    "note_markdown": f"""WITH {_CHUNKS}, b AS (SELECT memory_uid, string_agg(CASE WHEN chunk_heading <> '' THEN '## ' || chunk_heading || chr(10) ELSE '' END || coalesce(chunk_text, ''), chr(10) || chr(10) ORDER BY chunk_ordinal) AS body FROM chunks GROUP BY 1), n AS (SELECT DISTINCT ON (memory_id) * FROM memories ORDER BY memory_id, updated_at DESC, status DESC, file_status DESC), s AS (SELECT memory_symbol_id, arg_max(memory_id, coalesce(last_resolved_at, TIMESTAMPTZ '0001-01-01 00:00:00+00')) AS memory_id FROM memory_symbols GROUP BY 1), c AS (SELECT memory_id, count(*) AS n FROM s GROUP BY 1)
 SELECT n.memory_id, memory_uid AS id, coalesce(nullif(scope, ''), 'project') AS scope, coalesce(file_path, '') AS file, coalesce(title, '') AS title, status, file_status AS "fileStatus", coalesce(c.n, 0)::INTEGER AS n_symbols, CASE WHEN coalesce(b.body, '') = '' THEN '' ELSE regexp_replace(replace(b.body || CASE WHEN right(b.body, 1) = chr(10) THEN '' ELSE chr(10) END, chr(13) || chr(10), chr(10)), '^\\n+', '') END AS body FROM n LEFT JOIN c USING (memory_id) LEFT JOIN b USING (memory_uid)""",
    "note_upserts": f"""SELECT memory_id, max(updated_at) AS updated_at, arg_max(title, updated_at) AS title, arg_max(file_path, updated_at) AS file_path, arg_max(body_hash, updated_at) AS body_hash FROM memories WHERE updated_at < TIMESTAMPTZ '{CHANGED}+00' OR updated_at >= TIMESTAMPTZ '{CHANGED}+00' GROUP BY memory_id""",
    "note_file_status": f"""WITH n AS (SELECT DISTINCT ON (memory_id) * FROM memories ORDER BY memory_id, updated_at DESC, status DESC, file_status DESC), l AS (SELECT DISTINCT project_id, path FROM source_files WHERE removed_at IS NULL)
 SELECT memory_id, file_status, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.project_id = n.project_id AND l.path = {_CLEAN.format(p="n.file_path")}) THEN 'active' ELSE 'deleted' END AS should_be FROM n WHERE scope = 'file' AND file_path <> ''""",
    "primary_definitions": f"WITH {_D}, {_FIRST} SELECT project_id, name, lang, def_id, kind, path, candidates FROM prime",
    "ranked_definitions": f"""WITH {_D}, c AS (SELECT *, {_CONFIDENCE} AS confidence, kind IN {_TYPES} AS t, kind IN {_VALUES} AS v FROM d),
 l AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY project_id, name, lang) AS has FROM c) WHERE NOT (has AND v)),
 f AS (SELECT *, max(confidence >= 0.55) OVER (PARTITION BY project_id, name, lang) AS any_left FROM l) SELECT def_id, confidence FROM f WHERE confidence >= 0.55 OR NOT any_left""",
    "ranked_definitions_with_noise": f"WITH {_D} SELECT def_id, {_CONFIDENCE} AS confidence FROM d",
    "noisy_paths": f"SELECT DISTINCT path, {_noisy('path')} AS noisy, {_noise('path')} AS cost FROM source_files",
    "identifiers_at_cursors": f"""WITH {_U}, {_D}, c AS (SELECT usage_id AS cursor_id, file_id, start_line, start_col + 1 AS col FROM u),
 s AS (SELECT file_id, start_line, start_col, end_col, name, 0 AS p FROM definitions UNION SELECT file_id, start_line, start_col, end_col, name, 1 FROM usages),
 m AS (SELECT c.cursor_id, s.name, s.p, row_number() OVER (PARTITION BY c.cursor_id ORDER BY s.p, s.start_col, s.name) AS r FROM c LEFT JOIN s ON s.file_id = c.file_id AND s.start_line = c.start_line AND c.col BETWEEN s.start_col AND s.end_col)
 SELECT cursor_id, name, CASE p WHEN 0 THEN 'definition' WHEN 1 THEN 'usage' END AS source FROM m WHERE r = 1""",
    "words_at_columns": f"""WITH {_LINES}, {_D} SELECT def_id, CASE WHEN regexp_extract(substr(line, start_col + 1), '^[\\p{{L}}\\p{{Nd}}_]+', 0) = '' THEN ''
 ELSE regexp_extract(substr(line, 1, start_col), '[\\p{{L}}\\p{{Nd}}_]*$', 0) || regexp_extract(substr(line, start_col + 1), '^[\\p{{L}}\\p{{Nd}}_]+', 0) END AS word
 FROM d JOIN lines ON lines.file_id = d.file_id AND lines.line_no = d.start_line WHERE length(line) > start_col""",
    "deduplicated_captures": """WITH r AS (SELECT DISTINCT usage_id, file_id, name, start_line, start_col, kind FROM usages), o AS (SELECT *, row_number() OVER (PARTITION BY file_id, name, start_line, start_col
 ORDER BY CASE kind WHEN 'inherit' THEN 90 WHEN 'annotation' THEN 80 WHEN 'call' THEN 70 WHEN 'write' THEN 60 WHEN 'import' THEN 50 WHEN 'type_ref' THEN 40 WHEN 'read' THEN 30 ELSE 10 END DESC, usage_id) AS i, count(*) OVER (PARTITION BY file_id, name, start_line, start_col) AS captures FROM r) SELECT file_id, name, start_line, start_col, usage_id, kind, captures FROM o WHERE i = 1""",
    "usages_not_definitions": f"WITH {_U} SELECT usage_id FROM u WHERE NOT EXISTS (SELECT 1 FROM definitions d WHERE d.file_id = u.file_id AND d.name = u.name AND d.start_line = u.start_line AND d.start_col = u.start_col)",
    "resolution_scores": f"WITH {_U}, {_D}, {_RESOLVED} SELECT usage_id, candidates, confidence, best_def_id FROM resolved",
    "filtered_usages": f"""WITH {_U}, {_D}, {_FIRST}, {_RESOLVED},
 j AS (SELECT r.*, p.def_id AS primary_def_id, NOT {_noisy("p.path")} AS clean, {_noisy("r.path")} AS noisy FROM resolved r JOIN prime p USING (project_id, name, lang)),
 a AS (SELECT *, max(NOT (clean AND noisy)) OVER (PARTITION BY project_id, name, lang) AS any1 FROM j), b AS (SELECT * FROM a WHERE NOT (clean AND noisy) OR NOT any1),
 c AS (SELECT *, candidates < 2 OR (confidence >= 0.55 AND best_def_id = primary_def_id) AS ok FROM b), e AS (SELECT *, max(ok) OVER (PARTITION BY project_id, name, lang) AS any2 FROM c)
 SELECT usage_id, primary_def_id, confidence FROM e WHERE ok OR NOT any2""",
    "coupling_scores": f"WITH {_U} SELECT usage_id, {_COUPLING} AS score FROM u",
    "find_usages": f"""WITH {_U}, s AS (SELECT *, {_COUPLING} AS score FROM u), m AS (SELECT *, max(end_line) OVER (PARTITION BY project_id, name, lang, file_id ORDER BY start_line, usage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
 i AS (SELECT *, (sum(CASE WHEN before IS NULL OR start_line > before + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, name, lang, file_id ORDER BY start_line, usage_id))::BIGINT AS island FROM m)
 SELECT project_id, name, lang, file_id, island, count(*) AS n_usages, count(DISTINCT start_line) AS n_lines, min(start_line) AS first_line, max(end_line) AS last_line, max(score) AS max_score FROM i GROUP BY ALL""",
    "code_windows": f"""WITH {_U}, s AS (SELECT DISTINCT file_id, greatest(start_line - 2, 1) AS a, end_line + 2 AS b FROM u), l AS (SELECT file_id, a, max(b) AS b FROM s GROUP BY ALL),
 m AS (SELECT *, max(b) OVER (PARTITION BY file_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l), i AS (SELECT *, (sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY a))::BIGINT AS island FROM m)
 SELECT file_id, island, min(a) AS first_line, max(b) AS last_line, count(*) AS windows FROM i GROUP BY ALL""",
    "inbound_edges": f"WITH {_U}, {_D}, {_FIRST}, {_RESOLVED}, {_edges(0.2)} SELECT * FROM inbound",
    "kept_inbound_edges": f"WITH {_U}, {_D}, {_FIRST}, {_RESOLVED}, {_edges(0.4)} SELECT * FROM inbound",
    "outbound_edges": f"WITH {_U}, {_D}, {_OUT} SELECT * EXCLUDE at_path FROM outbound",
    "file_graph": f"""WITH {_U}, {_D}, {_FIRST}, {_RESOLVED}, {_edges(0.2)}, {_OUT}, e AS (SELECT project_id, name, lang, path AS from_path, to_path, n_usages, max_score AS s FROM inbound
  UNION ALL SELECT p.project_id, p.name, p.lang, at_path, target_path, n_usages, score FROM outbound JOIN prime p USING (def_id))
 SELECT project_id, name, lang, from_path, to_path, sum(n_usages)::BIGINT AS n_usages, round(max(s) * 10000) / 10000 AS max_score FROM e WHERE from_path <> to_path GROUP BY ALL""",
    "graph_metrics": f"""WITH {_U}, {_D}, {_FIRST}, {_RESOLVED}, {_edges(0.2)}, {_OUT}, a AS (SELECT project_id, name, lang, count(*) AS f, sum(n_usages)::BIGINT AS n, round(sum(round(max_score * 10000)::BIGINT)::DOUBLE / count(*)) / 10000 AS s FROM inbound GROUP BY ALL),
  b AS (SELECT def_id, count(*) AS n, count(DISTINCT target_path) AS f, round(sum(round(score * 1000000)::BIGINT)::DOUBLE / (count(*) * 100)) / 10000 AS s FROM outbound GROUP BY ALL)
 SELECT p.project_id, p.name, p.lang, coalesce(a.f, 0) AS inbound_files, coalesce(a.n, 0) AS inbound_usages, coalesce(a.s, 0.0)::DOUBLE AS impact, coalesce(b.n, 0) AS outbound_names,
  coalesce(b.f, 0) AS outbound_files, coalesce(b.s, 0.0)::DOUBLE AS coupling FROM prime p LEFT JOIN a USING (project_id, name, lang) LEFT JOIN b USING (def_id)""",
    "index_changes": """WITH f AS (SELECT DISTINCT file_id, project_id, path, sha256, indexed_at, removed_at FROM source_files),
 """
    + ", ".join(
        f"{n} AS (SELECT project_id, path, arg_max(sha256, struct_pack(i := indexed_at, f := file_id)) AS sha FROM f WHERE indexed_at <= TIMESTAMPTZ '{t}+00' AND (removed_at IS NULL OR removed_at > TIMESTAMPTZ '{t}+00') GROUP BY ALL)"
        for n, t in (("old", BEFORE), ("new", AFTER))
    )
    + """ SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.path, o.path) AS path,
 CASE WHEN n.path IS NULL THEN 'delete' WHEN o.path IS NULL OR o.sha <> n.sha OR n.sha = '' THEN 'index' ELSE 'skip' END AS action FROM new n FULL JOIN old o ON n.project_id = o.project_id AND n.path = o.path""",
    "index_stats": """WITH r AS (SELECT DISTINCT run_id, project_id, indexed, skipped, deleted, errors, symbols, refs FROM index_runs),
 t AS (SELECT project_id, count(*) AS runs, sum(indexed)::BIGINT AS indexed, sum(skipped)::BIGINT AS skipped, sum(deleted)::BIGINT AS deleted, sum(coalesce(errors, 0))::BIGINT AS errors, sum(symbols)::BIGINT AS symbols, sum(refs)::BIGINT AS refs FROM r GROUP BY 1),
 f AS (SELECT project_id, count(DISTINCT file_id) AS files FROM source_files WHERE removed_at IS NULL GROUP BY 1), d AS (SELECT project_id, count(DISTINCT def_id) AS definitions FROM definitions GROUP BY 1),
 u AS (SELECT project_id, count(DISTINCT usage_id) AS usages FROM usages GROUP BY 1)
 SELECT p.project_id, coalesce(runs, 0) AS runs, coalesce(indexed, 0) AS indexed, coalesce(skipped, 0) AS skipped, coalesce(deleted, 0) AS deleted, coalesce(errors, 0) AS errors, coalesce(symbols, 0) AS symbols, coalesce(refs, 0) AS refs,
 coalesce(files, 0) AS files, coalesce(definitions, 0) AS definitions, coalesce(usages, 0) AS usages FROM projects p LEFT JOIN t USING (project_id) LEFT JOIN f USING (project_id) LEFT JOIN d USING (project_id) LEFT JOIN u USING (project_id)""",
    "languages": f"SELECT {_LANGUAGE} AS by_extension, lang, count(DISTINCT file_id) AS n_files FROM source_files GROUP BY 1, 2",
    "glob_files": " UNION ALL ".join(
        f"SELECT DISTINCT file_id, '{n}' AS glob FROM source_files WHERE regexp_matches(path, '^{p}$') OR regexp_matches(regexp_extract(path, '[^/]*$', 0), '^{p}$')" for n, p in _GLOBS.items()
    ),
    "extracted_definitions": f"""WITH {_LINES}, {_CAPTURES}, {_DOCS}
 SELECT c.file_id, c.language, c.kind, c.name, c.line_no::INTEGER AS line_no, coalesce(r.a, c.line_no)::INTEGER AS doc_line FROM captures c LEFT JOIN runs r ON r.file_id = c.file_id AND r.below = c.line_no""",
    "structural_matches": f"""WITH {_LINES}, {_CAPTURES}, p AS (SELECT file_id, language, kind, count(*) AS n FROM captures GROUP BY ALL)
 SELECT project_id, p.language, kind, count(*) AS n_files, sum(n)::BIGINT AS n_matches, max(n) AS most FROM p JOIN texts USING (file_id) GROUP BY ALL""",
    "note_sections": f"""WITH s AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM s),
 h AS (SELECT *, regexp_matches(line, '{_HEAD}') AS head FROM x), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
 a AS (SELECT doc_id, sec, trim(coalesce(max(regexp_extract(line, '{_HEAD}', 1)) FILTER (head), '')) AS heading, count(*) AS n_lines, (sum(length(line)) + count(*) - 1)::BIGINT AS n_chars, trim(string_agg(line, '')) AS body FROM g GROUP BY ALL)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INTEGER AS ordinal, heading, n_lines::INTEGER AS n_lines, n_chars::INTEGER AS n_chars FROM a WHERE body <> ''""",
    "note_search": f"""WITH {_CHUNKS}, f AS (SELECT memory_uid, chunk_ordinal, [{", ".join(f"{{'b': {b}::DOUBLE, 't': {_TERMS.format(c=c)}}}" for c, b in (("title", 2.0), ("chunk_heading", 1.5), ("chunk_text", 1.0), ("symbol_text", 1.0)))}] AS fs
  FROM chunks WHERE status = 'active' AND file_status = 'active'),
 q AS (SELECT unnest([{", ".join(repr(t) for t in sorted(set(SEARCHED.split())))}]) AS q), e AS (SELECT memory_uid, chunk_ordinal, unnest(fs) AS f FROM f),
 h AS (SELECT memory_uid, chunk_ordinal, q, f.b AS b, len(list_filter(f.t, lambda t: t = q)) AS tf, len(f.t) AS n FROM e, q WHERE list_contains(f.t, q)),
 df AS (SELECT q, count(DISTINCT (memory_uid, chunk_ordinal)) AS df FROM h GROUP BY q),
 sc AS (SELECT memory_uid, chunk_ordinal, round(sum(b * sqrt(tf) * power(1 + ln((SELECT count(*) FROM f) / df), 2) / sqrt(n)), 6) AS score FROM h JOIN df USING (q) GROUP BY ALL),
 top AS (SELECT * FROM sc ORDER BY score DESC, memory_uid, chunk_ordinal LIMIT 20) SELECT memory_uid, chunk_ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY memory_uid ORDER BY score DESC, chunk_ordinal) AS r FROM top) WHERE r = 1""",
    "note_title_searches": f"""WITH {_CHUNKS}, a AS (SELECT * FROM chunks WHERE status = 'active' AND file_status = 'active'),
 m AS (SELECT DISTINCT ON (memory_id) memory_id, title FROM memories WHERE memory_id % 20 = 0 ORDER BY memory_id, updated_at DESC NULLS LAST, title DESC NULLS LAST), q AS (SELECT DISTINCT memory_id, unnest({_TERMS.format(c="title")}) AS q FROM m),
 l AS ({" UNION ALL ".join(f"SELECT memory_uid, chunk_ordinal, '{c}' AS c, {b}::DOUBLE AS b, {_TERMS.format(c=c)} AS t FROM a" for c, b in (("title", 2.0), ("chunk_heading", 1.5), ("chunk_text", 1.0), ("symbol_text", 1.0)))}),
 h AS (SELECT memory_uid, chunk_ordinal, c, b, n, q, count(*) AS tf FROM (SELECT memory_uid, chunk_ordinal, c, b, len(t) AS n, unnest(t) AS q FROM l) WHERE q IN (SELECT q FROM q) GROUP BY ALL),
 df AS (SELECT q, count(DISTINCT (memory_uid, chunk_ordinal)) AS df FROM h GROUP BY q),
 sc AS (SELECT memory_id, memory_uid, chunk_ordinal, round(sum(b * sqrt(tf) * power(1 + ln((SELECT count(*) FROM a) / df), 2) / sqrt(n)), 6) AS score FROM q JOIN h USING (q) JOIN df USING (q) GROUP BY ALL),
 t AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY score DESC, memory_uid, chunk_ordinal) <= 20)
 SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY memory_id, memory_uid ORDER BY score DESC, chunk_ordinal) = 1""",
    "note_replacements": f"WITH {_CHUNKS} SELECT memory_uid, chunk_ordinal, len(regexp_extract_all(chunk_text, '{PATTERN}'))::INTEGER AS matches, length(regexp_replace(chunk_text, '{PATTERN}', 'NAME', 'g'))::INTEGER AS new_chars FROM chunks WHERE regexp_matches(chunk_text, '{PATTERN}')",
    "note_symbol_status": """WITH live AS (SELECT DISTINCT file_id FROM source_files WHERE removed_at IS NULL), k AS (SELECT DISTINCT project_id, name, lower(trim(lang)) AS language FROM definitions SEMI JOIN live USING (file_id)),
 s AS (SELECT memory_symbol_id, max(struct_pack(t := coalesce(last_resolved_at, TIMESTAMPTZ '0001-01-01 00:00:00+00'), m := memory_id, l := language, n := name, s := coalesce(status, ''))) AS r FROM memory_symbols GROUP BY 1),
 m AS (SELECT DISTINCT memory_id, project_id FROM memories)
 SELECT memory_symbol_id, nullif(r.s, '') AS status, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.project_id = m.project_id AND k.name = s.r.n AND k.language = lower(trim(s.r.l))) THEN 'active' ELSE 'deleted' END AS should_be FROM s JOIN m ON m.memory_id = s.r.m""",
    "note_slugs": "SELECT DISTINCT title, regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 50), '-$', '') AS slug FROM memories WHERE title <> ''",
    "quiet_periods": """WITH m AS (SELECT *, lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events WHERE ts IS NOT NULL), i AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch(date_trunc('second', ts)) - b > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS period FROM m)
 SELECT user_id, period, min(date_trunc('second', ts)) AS first_at, max(date_trunc('second', ts)) AS last_at, count(*) AS n_events FROM i GROUP BY ALL""",
    "streamed_index_state": "SELECT project_id, path, max(file_id) AS file_id, arg_max(sha256, file_id) AS sha256, arg_max(CASE WHEN removed_at IS NULL THEN 1 ELSE 0 END, file_id) = 1 AS in_index FROM source_files GROUP BY ALL",
}
