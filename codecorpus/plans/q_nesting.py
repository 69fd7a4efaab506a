"""Queries over nested conditionals and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.operators import nesting as n
from codecorpus.operators import symbols as y
from codecorpus.plans.duck import ascii_words, count_of, python_skeletons, q
from codecorpus.plans.registry import query

# Lines of the derived sources, numbered from 1; w: non-ASCII letters folded so that \b and \w see Unicode words.
LINES = "SELECT file_id, language, unnest(string_split(content, chr(10))) AS s, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INT) AS i FROM code_files"
FOLDED = f"SELECT *, {ascii_words('s')} AS w FROM ({LINES})"

_WALK = """
WITH RECURSIVE l AS ({lines}),
x AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY i) AS k, * EXCLUDE (file_id) FROM l WHERE {keep}),
r AS (SELECT file_id, CAST(0 AS BIGINT) AS k, 0 AS line, 0 AS depth, CAST([] AS STRUCT(i INT, d INT)[]) AS kept, CAST([] AS STRUCT(i INT, d INT)[]) AS stack FROM (SELECT DISTINCT file_id FROM x)
  UNION ALL SELECT file_id, k, line, depth, {kept} AS kept, stack FROM (
    SELECT r.file_id, x.k, x.i AS line, {depth} AS depth, {stack} AS stack, x.s FROM r JOIN x ON x.file_id = r.file_id AND x.k = r.k + 1))
SELECT file_id, stack[1].i AS line_start, line AS line_end, CAST(len(stack) AS INT) AS depth, {severity} AS severity FROM r WHERE len(stack) >= 3
"""


@query("n1_nested_ifs_indent", "code_files", oracle=_WALK.format(
    lines=FOLDED, keep=r"regexp_matches(w, '\bif\b') AND language IN ('python', 'cpp')", kept="stack", depth="0",
    stack="list_append(list_filter(r.stack, lambda e: e.d < length(x.s) - length(ltrim(x.s))), {'i': x.i, 'd': CAST(length(x.s) - length(ltrim(x.s)) AS INT)})",
    severity="'medium'"))
def _n1(t):
    return n.nested_ifs_indent(t.code_files.filter("language in ('python', 'cpp')"))


_OPENED = f"({count_of('x.s', '{')} - {count_of('x.s', '}')})"


@query("n2_nested_ifs_brace", "code_files", oracle=_WALK.format(
    lines=FOLDED, keep="language IN ('java', 'javascript')", kept="CASE WHEN contains(s, '}') THEN list_filter(stack, lambda e: e.d <= depth) ELSE stack END",
    depth=f"r.depth + {_OPENED}",
    stack=rf"CASE WHEN regexp_matches(x.w, '\bif\s*\(') THEN list_append(r.kept, {{'i': x.i, 'd': r.depth + {_OPENED}}}) ELSE r.kept END",
    severity="CASE WHEN len(stack) >= 4 THEN 'high' ELSE 'medium' END"))
def _n2(t):
    return n.nested_ifs_brace(t.code_files.filter("language in ('java', 'javascript')"))


_PYTHON = python_skeletons(dims.PAIR_NAMES)


@query("n3_nested_ifs_python", oracle=f"""
SELECT file_id, CAST(8 + i AS INT) AS line_start, CAST(8 + d AS INT) AS line_end, CAST(d - i AS INT) AS depth, CASE WHEN d - i >= 4 THEN 'high' ELSE 'medium' END AS severity
FROM {_PYTHON} p, range(0, 8) r(i) WHERE d - i >= 3""")
def _n3(t):
    return n.nested_ifs_python(t.code_files.filter("language = 'python'"))


_FINDINGS = ("SELECT doc_id AS file_id, CASE doc_id % 5 WHEN 0 THEN 'Python' WHEN 1 THEN 'java' WHEN 2 THEN 'javascript' WHEN 3 THEN 'cpp' ELSE 'C#' END AS language, "
             "CAST(1 + doc_id % 7 AS INT) AS line_start, CAST(9 + doc_id % 9 AS INT) AS line_end, CAST(3 + doc_id % 4 AS INT) AS depth FROM documents")


def _case(table: dict, pick) -> str:
    return "CASE lower(language) " + " ".join(f"WHEN {q(k)} THEN {pick(v)}" for k, v in table.items() if k) + f" ELSE {pick(table[''])} END"


@query("n4_nested_if_suggestions", oracle=f"""
SELECT file_id, line_start, line_end, {_case(dims.NESTED_SUGGESTIONS, lambda v: q(v[0]))} AS suggestion_type, {_case(dims.NESTED_SUGGESTIONS, lambda v: q(v[1]))} AS suggestion,
  {_case(dims.NESTED_SUGGESTIONS, lambda v: q('; '.join(v[2])))} AS benefits FROM ({_FINDINGS})""")
def _n4(t):
    out = n.nested_if_suggestions(t.sql(_FINDINGS, "documents"))
    return out.select("file_id", "line_start", "line_end", "suggestion_type", "suggestion", F.array_join("benefits", "; ").alias("benefits"))


@query("n5_refactor_candidates", oracle=f"""
SELECT file_id, depth, {_case(dims.REFACTOR_CANDIDATES, lambda v: q(v[0]))} AS pattern, CAST({_case(dims.REFACTOR_CANDIDATES, lambda v: str(v[1]))} AS DOUBLE) AS confidence,
  {_case(dims.REFACTOR_CANDIDATES, lambda v: q(v[2]))} AS description FROM ({_FINDINGS}) WHERE depth >= 4""")
def _n5(t):
    return n.refactor_candidates(t.sql(_FINDINGS, "documents")).select("file_id", "depth", "pattern", "confidence", "description")


@query("n_nested_ifs_all_languages")
def _nall(t):
    return n.nested_ifs(t.code_files)


@query("n6_enclosing_function")
def _n6(t):
    files = t.code_files
    findings = n.nested_ifs(files).select("file_id", "line_start", "depth").distinct()
    return n.enclosing_function(findings, files)


_BRACE_FINDINGS = _WALK.format(
    lines=FOLDED, keep="language IN ('java', 'javascript')", kept="CASE WHEN contains(s, '}') THEN list_filter(stack, lambda e: e.d <= depth) ELSE stack END",
    depth=f"r.depth + {_OPENED}", stack=rf"CASE WHEN regexp_matches(x.w, '\bif\s*\(') THEN list_append(r.kept, {{'i': x.i, 'd': r.depth + {_OPENED}}}) ELSE r.kept END", severity="''")
_WALKED = _BRACE_FINDINGS[: _BRACE_FINDINGS.rindex("SELECT file_id, stack[1].i")]


@query("n6_functions_of_findings", "code_files", oracle=rf"""{_WALKED},
n AS (SELECT file_id, stack[1].i AS line_start, line AS line_end, CAST(len(stack) AS INT) AS depth FROM r WHERE len(stack) >= 3),
t AS (SELECT file_id, i, {count_of('s', '{')} - {count_of('s', '}')} AS delta, contains(s, '}}') AS close,
  CASE WHEN language = 'java' THEN regexp_matches(w, '(?s)(public|private|protected).*\w+\s*\([^)]*\)\s*\{{?') ELSE regexp_matches(s, '^\s*function ') OR contains(s, '=>') OR regexp_matches(w, '\w+\s*\([^)]*\)\s*\{{') END AS head
  FROM l WHERE language IN ('java', 'javascript')),
a AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY file_id ORDER BY i) AS INT) AS after FROM t),
h AS (SELECT p.file_id, p.i, coalesce((SELECT min(c.i) FROM a c WHERE c.file_id = p.file_id AND c.close AND c.after = p.after - p.delta AND c.i >= p.i), (SELECT max(c.i) FROM a c WHERE c.file_id = p.file_id)) AS stop FROM a p WHERE head)
SELECT n.*, (SELECT max(h.i) FROM h WHERE h.file_id = n.file_id AND h.i <= n.line_start) AS function_start,
  (SELECT arg_max(h.stop, h.i) FROM h WHERE h.file_id = n.file_id AND h.i <= n.line_start) AS function_end FROM n""")
def _n6b(t):
    files = t.code_files.filter("language in ('java', 'javascript')")
    return n.nested_ifs_in_functions(files).select("file_id", "line_start", "line_end", "depth", "function_start", "function_end")


# --- symbols -------------------------------------------------------------------------------------------------------

_EMPTY = "CAST(NULL AS VARCHAR) AS visibility, false AS is_static, {arrow} AS is_arrow, {ret} AS return_type"


def _sym(lang: str, pattern: str, prefix: int, name: int, kind: str, cond: str = "true", extra: str | None = None) -> str:
    p = q("(?s)" + pattern)
    extra = extra or _EMPTY.format(arrow="false", ret="CAST(NULL AS VARCHAR)")
    return (f"SELECT file_id, i AS line_start, i AS line_end, regexp_extract(s, {p}, {name}) AS name, {kind.replace('@p', p)} AS type, CAST(length(regexp_extract(s, {p}, {prefix})) AS INT) AS col_start, "
            f"CAST(length(regexp_extract(s, {p}, {prefix})) + length(regexp_extract(s, {p}, {name})) AS INT) AS col_end, {extra.replace('@p', p)} "
            f"FROM f WHERE language = '{lang}' AND regexp_matches(s, {p}) AND {cond}")


def _re(p: str) -> str:
    return p.replace(r"\w", r"[\p{L}\p{N}_]")


_ARROW = _re(r"^(.*?(?:const|let|var)\s+)(\w+)\s*=\s*\([^)]*\)\s*=>")


@query("y1_symbols_javascript", "code_files", oracle=f"WITH f AS ({FOLDED}) " + " UNION ALL ".join([
    _sym("javascript", _re(r"^(.*?function\s+)(\w+)\s*\("), 1, 2, "'function'"),
    _sym("javascript", _ARROW, 1, 2, "'function'", extra=_EMPTY.format(arrow="true", ret="CAST(NULL AS VARCHAR)")),
    _sym("javascript", _re(r"^(.*?class\s+)(\w+)"), 1, 2, "'class'")]))
def _y1(t):
    return y.symbols_javascript(t.code_files.filter("language = 'javascript'"))


@query("y2_symbols_java", "code_files", oracle=f"WITH f AS ({FOLDED}) " + " UNION ALL ".join([
    _sym("java", _re(r"^(.*?class\s+)(\w+)"), 1, 2, "'class'"),
    _sym("java", _re(r"^(.*?(public|private|protected)?\s*(static)?\s*(\w+)\s+)(\w+)\s*\("), 1, 5, "'method'", r"NOT regexp_matches(w, '\b(class|interface)\b')",
         "coalesce(nullif(regexp_extract(s, @p, 2), ''), 'package') AS visibility, regexp_extract(s, @p, 3) <> '' AS is_static, false AS is_arrow, regexp_extract(s, @p, 4) AS return_type")]))
def _y2(t):
    return y.symbols_java(t.code_files.filter("language = 'java'"))


@query("y3_symbols_cpp", "code_files", oracle=f"WITH f AS ({FOLDED}) " + " UNION ALL ".join([
    _sym("cpp", _re(r"^(.*?(\w+)\s+)(\w+)\s*\([^)]*\)\s*\{"), 1, 3, "'function'", r"NOT regexp_matches(w, '\b(if|while|for|switch)\b')",
         _EMPTY.format(arrow="false", ret="regexp_extract(s, @p, 2)")),
    _sym("cpp", _re(r"^(.*?(class|struct)\s+)(\w+)"), 1, 3, "regexp_extract(s, @p, 2)"),
    _sym("cpp", _re(r"^(.*?#define\s+)(\w+)"), 1, 2, "'macro'")]))
def _y3(t):
    return y.symbols_cpp(t.code_files.filter("language = 'cpp'"))


def _py_symbol(name: str, kind: str, start: str, end: str, columns: tuple[int, int], parent: str, parameters: str, doc: str) -> str:
    return (f"SELECT file_id, {name} AS name, '{kind}' AS type, CAST({start} AS INT) AS line_start, CAST({end} AS INT) AS line_end, {columns[0]} AS col_start, {columns[1]} AS col_end, "
            f"{parent} AS parent, {parameters} AS parameters, {doc} AS docstring, CAST(NULL AS VARCHAR) AS return_type FROM {_PYTHON} p")


_HANDLER = "'Handler' || file_id"


@query("y4_symbols_python", oracle=" UNION ALL ".join([
    _py_symbol(_HANDLER, "class", "5", "13 + d", (0, 19), "NULL", "NULL", "NULL"),
    _py_symbol("'process_' || v", "function", "6", "9 + d", (4, 24), _HANDLER, "'self,' || v || ',limit'", "NULL"),
    _py_symbol("'Describe'", "function", "11 + d", "13 + d", (4, 19), _HANDLER, "'self'", "'Describe it.'"),
    _py_symbol("'load_' || v", "function", "16 + d", "30 + d", (0, 16), "NULL", "'path,mode'", "NULL")]))
def _y4(t):
    return y.symbols_python(t.code_files.filter("language = 'python'")).withColumn("parameters", F.array_join("parameters", ","))


def _fn(lang: str, pattern: str, name: int, params: int, kind: str, signature: str, cond: str = "true", end: str = "i") -> str:
    p = q(_re(pattern))
    g = lambda k: f"regexp_extract(s, {p}, {k})"
    for k in range(1, 6):
        signature, kind, cond = signature.replace(f"@{k}", g(k)), kind.replace(f"@{k}", g(k)), cond.replace(f"@{k}", g(k))
    return (f"SELECT file_id, '{lang}' AS language, {g(name)} AS name, {kind} AS kind, {g(params)} AS params, {signature} AS signature, i AS start_line, CAST({end} AS INT) AS end_line "
            f"FROM f WHERE language = '{lang}' AND regexp_matches(s, {p}) AND {cond}")


_JS_HEADS = [r"^\s*function\s+(\w+)\s*\(([^)]*)\)", r"^\s*const\s+(\w+)\s*=\s*\(([^)]*)\)\s*=>", r"^\s*(\w+)\s*:\s*function\s*\(([^)]*)\)", r"^\s*async\s+function\s+(\w+)\s*\(([^)]*)\)"]
_PY_END = ("coalesce((SELECT min(g.i) - 1 FROM f g WHERE g.file_id = f.file_id AND g.i > f.i AND regexp_matches(g.s, '\\S') AND length(g.s) - length(ltrim(g.s)) <= length(f.s) - length(ltrim(f.s))), "
           "(SELECT max(g.i) FROM f g WHERE g.file_id = f.file_id))")


@query("y5_extract_functions", "code_files", oracle=f"WITH f AS ({FOLDED}) " + " UNION ALL ".join(
    [_fn("python", r"^\s*(def|async def)\s+(\w+)\s*\(([^)]*)\)\s*:", 2, 3, "@1", "@1 || ' ' || @2 || '(' || @3 || ')'", end=_PY_END)]
    + [_fn("javascript", p, 1, 2, "'function'", "'function ' || @1 || '(' || @2 || ')'") for p in _JS_HEADS]
    + [_fn("java", r"^\s*(public|private|protected)?\s*(static)?\s*(\w+)\s+(\w+)\s*\(([^)]*)\)", 4, 5, "'method'",
           "coalesce(nullif(@1, ''), 'package') || ' ' || @2 || ' ' || @3 || ' ' || @4 || '(' || @5 || ')'"),
       _fn("cpp", r"^\s*(\w+(?:\s*\*)?\s+)?(\w+)\s*\(([^)]*)\)\s*\{?", 2, 3, "'function'", "coalesce(nullif(@1, ''), 'void') || @2 || '(' || @3 || ')'",
           "NOT starts_with(trim(s), '//') AND @2 NOT IN ('if', 'for', 'while', 'switch', 'return')")]))
def _y5(t):
    return y.extract_functions(t.code_files.select("file_id", "language", "content"))
