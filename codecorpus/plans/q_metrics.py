"""Queries over metrics and Python facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.operators import metrics as m
from codecorpus.operators import pyfacts
from codecorpus.plans.duck import (
    BROKEN_SKELETONS, python_skeletons,
    ascii_words, clamp, count_any, count_of, count_re, line_total, lines, lines_where, nonblank, q,
)
from codecorpus.plans.registry import query

X = "original_content"


def _texts(t, *extra):
    return t.files.select("file_id", *extra, F.col("original_content").alias("content"))


@query("m1_file_facts", "files", oracle=f"""
SELECT file_id, CAST(strlen({X}) AS INT) AS size_bytes, CAST({line_total(X)} AS INT) AS line_count,
  CAST(strlen({X}) AS DOUBLE) / {line_total(X)} AS avg_line_length, md5({X}) AS file_hash FROM files""")
def _m1(t):
    return m.file_facts(_texts(t)).drop("content")


@query("m2_lines", "files", oracle=f"""
SELECT file_id, CAST(i AS INT) AS line_no, CAST(length(s) - length(ltrim(s)) AS INT) AS indent, NOT regexp_matches(s, '\\S') AS is_blank,
  starts_with(trim(s), '#') OR contains(s, '//') AS is_comment, length(s) > 100 AS is_long, md5(s) AS line_hash
FROM (SELECT file_id, unnest({lines(X)}) AS s, generate_subscripts({lines(X)}, 1) AS i FROM files)""")
def _m2(t):
    return m.lines(_texts(t)).withColumn("line_hash", F.md5("line")).drop("line")


def _sparse(pattern: str, threshold: str) -> str:
    return f"({nonblank(X)} > 0 AND CAST({lines_where(X, f'regexp_matches(s, {q(pattern)})')} AS DOUBLE) / {nonblank(X)} < {threshold})"


def _long(limit: int) -> str:
    return lines_where(X, f"length(s) > {limit}")


_SCORES = {
    "javascript": (
        clamp(f"100 - 3 * {count_any(X, dims.BRANCH_WORDS)}", 65, 100),
        clamp(f"100 - 3 * {_long(120)} - CASE WHEN {_sparse('//|/[*]', '1e-1')} THEN 20 ELSE 0 END", 0, 100),
        clamp(f"100 - CASE WHEN {count_of(X, 'function')} + {count_of(X, '=>')} = 0 THEN 20 ELSE 0 END - 5 * {count_re(ascii_words(X), chr(92) + 'bvar' + chr(92) + 's+')}", 0, 100),
    ),
    "java": (
        clamp(f"100 - 2 * {count_any(X, dims.BRANCH_WORDS)}", 65, 100),
        clamp(f"100 - 2 * {_long(100)} - CASE WHEN {_sparse('//|[*]', '15e-2')} THEN 15 ELSE 0 END", 0, 100),
        clamp(
            f"100 + CASE WHEN regexp_matches({X}, 'class\\s+[A-Z][a-zA-Z0-9]*') THEN 10 ELSE 0 END"
            f" + CASE WHEN regexp_matches({X}, '(public|private|protected)\\s+[\\p{{L}}\\p{{N}}_]+\\s+([a-z][a-zA-Z0-9]*)') THEN 5 ELSE 0 END", 0, 100),
    ),
    "cpp": (
        clamp(f"100 - 2 * {count_any(X, dims.BRANCH_WORDS_C)}", 65, 100),
        clamp(f"100 - 2 * {_long(100)} - CASE WHEN {_sparse('//|/[*]', '1e-1')} THEN 20 ELSE 0 END", 0, 100),
        clamp(
            f"100 - CASE WHEN {lines_where(X, 'starts_with(trim(s), ' + q('#include') + ')')} > 10 THEN 10 ELSE 0 END"
            f" + CASE WHEN regexp_matches({X}, '[\\p{{L}}\\p{{N}}_]+\\s+[\\p{{L}}\\p{{N}}_]+\\s*\\([^)]*\\)\\s*\\{{') THEN 10 ELSE 0 END", 0, 100),
    ),
    "generic": (
        clamp(f"100 - {nonblank(X)} // 10", 65, 100),
        clamp(f"90 - 5 * {_long(120)}", 40, 100),
        clamp(f"85 - {nonblank(X)} // 20", 45, 100),
    ),
}


def _score_sql(lang: str) -> str:
    c, r, mt = _SCORES[lang]
    return f"CAST({c} AS INT) AS complexity, CAST({r} AS INT) AS readability, CAST({mt} AS INT) AS maintainability"


def _score_oracle(lang: str) -> str:
    return f"SELECT file_id, {_score_sql(lang)} FROM files"


@query("m3_score_javascript", "files", oracle=_score_oracle("javascript"))
def _m3(t):
    return m.score_javascript(_texts(t)).drop("content")


@query("m4_score_java", "files", oracle=_score_oracle("java"))
def _m4(t):
    return m.score_java(_texts(t)).drop("content")


@query("m5_score_cpp", "files", oracle=_score_oracle("cpp"))
def _m5(t):
    return m.score_cpp(_texts(t)).drop("content")


@query("m6_score_generic", "files", oracle=_score_oracle("generic"))
def _m6(t):
    return m.score_generic(_texts(t)).drop("content")


_PYTHON = python_skeletons(dims.PAIR_NAMES)
_HASH_SHARE = f"CAST({lines_where('content', chr(39).join(['regexp_matches(s, ', '^[ ]*#', ')']))} AS DOUBLE) / {nonblank('content')}"


@query("m7_score_python", "code_files", oracle=f"""
SELECT file_id, CAST(greatest(65, 100 - 2 * (d + 6)) AS INT) AS complexity,
  CAST(greatest(0, least(100, 97 - 2 * {lines_where('content', 'length(s) > 100')} + CASE WHEN {_HASH_SHARE} < 1e-1 THEN -15 WHEN {_HASH_SHARE} > 3e-1 THEN 10 ELSE 0 END)) AS INT) AS readability, 85 AS maintainability
FROM {_PYTHON} p JOIN code_files USING (file_id)
UNION ALL SELECT file_id, 65, 20, 25 FROM {BROKEN_SKELETONS} b""")
def _m7(t):
    return m.score_python(t.code_files.filter("language = 'python'").select("file_id", "content")).drop("content")


# Stored files without Python, which needs a parser; display names such as C++ take the generic path.
@query("m8_score", "files", oracle=" UNION ALL ".join(
    f"SELECT file_id, language, {_score_sql(k)} FROM files WHERE {cond}" for k, cond in {
        "javascript": "language = 'JavaScript'", "java": "language = 'Java'", "cpp": "language = 'C'",
        "generic": "language NOT IN ('JavaScript', 'Java', 'C', 'Python')"}.items()))
def _m8(t):
    return m.score(_texts(t, "language").filter("language <> 'Python'")).drop("content")


@query("m8_score_every_language")
def _m8b(t):
    """With Python files, whose parse tree SQL cannot state."""
    return m.score(_texts(t, "language")).drop("content")


@query("m9_overall", "files", oracle="""
SELECT file_id, CAST(round_even(complexity_score * 4e-1 + readability_score * 3e-1 + maintainability_score * 3e-1, 0) AS INT) AS overall FROM files""")
def _m9(t):
    c = {"complexity_score": "complexity", "readability_score": "readability", "maintainability_score": "maintainability"}
    return m.overall(t.files.select("file_id", *c).withColumnsRenamed(c)).select("file_id", "overall")


@query("m10_counts_javascript", "files", oracle=f"""
SELECT file_id, 1 + {count_any(X, dims.COUNT_WORDS + dims.COUNT_OPERATORS)} AS cyclomatic_complexity, CAST({nonblank(X)} AS INT) AS lines_of_code,
  {count_of(X, 'function ')} + {count_of(X, '=>')} AS function_count, {count_of(X, 'class ')} AS class_count FROM files""")
def _m10(t):
    return m.counts_javascript(_texts(t)).drop("content")


def _whole(words: list[str]) -> str:
    parts = [count_re("w", rf"\b{k}\b") for k in words] + [count_of("w", o) for o in dims.COUNT_OPERATORS]
    return " + ".join(parts)


_WORDS = f"(SELECT file_id, {ascii_words(X)} AS w FROM files)"


@query("m11_counts_java", "files", oracle=rf"""
SELECT file_id, CAST(1 + {_whole(dims.COUNT_WORDS + ['catch'])} AS INT) AS cyclomatic_complexity,
  CAST({lines_where('w', r"regexp_matches(s, '\S') AND NOT regexp_matches(s, '^\s*//')")} AS INT) AS lines_of_code,
  CAST({count_re('w', r'\b(public|private|protected)?\s*(static)?\s*\w+\s+\w+\s*\(')} AS INT) AS method_count,
  CAST({count_re('w', r'\bclass\s+\w+')} AS INT) AS class_count FROM {_WORDS}""")
def _m11(t):
    return m.counts_java(_texts(t)).drop("content")


@query("m12_counts_cpp", "files", oracle=rf"""
SELECT file_id, CAST(1 + {_whole(dims.COUNT_WORDS)} AS INT) AS cyclomatic_complexity,
  CAST({lines_where('w', r"regexp_matches(s, '\S') AND NOT regexp_matches(s, '^\s*(//|/[*])')")} AS INT) AS lines_of_code,
  CAST({count_re('w', r'\w+\s+\w+\s*\([^)]*\)\s*\{')} AS INT) AS function_count,
  CAST({count_re('w', r'\b(class|struct)\s+\w+')} AS INT) AS class_count FROM {_WORDS}""")
def _m12(t):
    return m.counts_cpp(_texts(t)).drop("content")


@query("m13_counts_python", "code_files", oracle=f"""
SELECT file_id, CAST(d + 6 AS INT) AS cyclomatic_complexity, CAST({line_total('content')} AS INT) AS lines_of_code, 3 AS function_count, 1 AS class_count, CAST(d + 2 AS INT) AS max_nesting_depth
FROM {_PYTHON} p JOIN code_files USING (file_id)
UNION ALL SELECT file_id, NULL, NULL, NULL, NULL, NULL FROM {BROKEN_SKELETONS} b""")
def _m13(t):
    return m.counts_python(t.code_files.filter("language = 'python'").select("file_id", "content")).drop("content")


def _issue(cond: str, name: str, value: str, detail: str = "NULL") -> str:
    return f"SELECT file_id, '{name}' AS issue, CAST({value} AS DOUBLE) AS value, CAST({detail} AS VARCHAR) AS detail FROM e WHERE {cond}"


@query("m14_quality_issues", "files", oracle=f"""
SELECT * FROM (WITH e AS (SELECT file_id, c, low, len(long) AS n_long, array_to_string(list_slice(long, 1, 3), ', ') AS first_long,
    comments, total, control, todo, runs
  FROM (SELECT file_id, {X} AS c, lower({X}) AS low, {nonblank(X)} AS total, {count_any(f'lower({X})', dims.ISSUE_WORDS)} AS control,
      {count_any(X, ['TODO', 'FIXME'])} AS todo, CAST((strlen({X}) - strlen(replace({X}, chr(10) || chr(10) || chr(10), ''))) / 3 AS INT) AS runs,
      {lines_where(X, "starts_with(trim(s), '#') OR contains(s, '//')")} AS comments,
      list_filter(list_transform({lines(X)}, lambda s, i: CASE WHEN length(s) > 100 THEN i END), lambda x: x IS NOT NULL) AS long FROM files))
{' UNION ALL '.join([
    _issue('n_long > 0', 'long_lines', 'n_long', 'first_long'),
    _issue('total > 0 AND CAST(comments AS DOUBLE) / total < 1e-1', 'low_comment_ratio', 'CAST(comments AS DOUBLE) / total'),
    _issue('control > 20', 'high_complexity', 'control'), _issue('todo > 0', 'todo', 'todo'), _issue('runs > 0', 'blank_runs', 'runs')])})""")
def _m14(t):
    return m.quality_issues(_texts(t, "original_path"))


@query("m14_quality_issues_code")
def _m14b(t):
    return m.quality_issues(t.code_files)


def _light(x: str) -> dict[str, str]:
    return {
        "lines_of_code": f"CASE WHEN {x} = '' THEN 0 ELSE {line_total(x)} - CAST(ends_with({x}, chr(10)) AS INT) END",
        "character_count": f"length({x})",
        "functions_count": f"CASE language WHEN 'Python' THEN {count_of(x, 'def ')} WHEN 'JavaScript' THEN {count_of(x, 'function ')} + {count_of(x, '=>')}"
                           f" ELSE {count_any(x, ['public ', 'private ', 'protected '])} END",
        "classes_count": count_of(x, "class "),
        "complexity_estimate": count_any(x, ["if ", "for ", "while "]),
    }


_B, _A = _light(X), _light("refactored_content")


@query("m15_metric_change", "files", oracle="SELECT *, CAST(after - before AS DOUBLE) / before * 100e0 AS change_pct FROM (" + " UNION ALL ".join(
    f"SELECT file_id, '{k}' AS metric, CAST({_B[k]} AS INT) AS before, CAST({_A[k]} AS INT) AS after FROM files WHERE language IN ('Python', 'JavaScript', 'Java')"
    for k in _B) + ") WHERE before <> 0")
def _m15(t):
    return m.metric_change(t.files)


def _diff(x: str, a: str, b: str) -> str:
    return f"({count_of(x, a)} - {count_of(x, b)})"


@query("m16_delimiter_check", "files", oracle=f"""
SELECT file_id, CASE WHEN {_diff(X, '{', '}')} <> 0 THEN 'Unbalanced braces: ' || {_diff(X, '{', '}')}
  WHEN {_diff(X, '(', ')')} <> 0 THEN 'Unbalanced parentheses: ' || {_diff(X, '(', ')')}
  WHEN language <> 'Java' AND {_diff(X, '[', ']')} <> 0 THEN 'Unbalanced brackets: ' || {_diff(X, '[', ']')} END AS delimiter_error
FROM (SELECT file_id, language, replace(replace({X}, 'ea', '['), 'th', '(') AS {X} FROM files)""")
def _m16(t):
    df = t.files.select("file_id", "language", F.expr("replace(replace(original_content, 'ea', '['), 'th', '(')").alias("content"))
    return m.delimiter_check(df).select("file_id", "delimiter_error")


_OK_HEAD = ["//", "/*", "@", "package", "import", "public class", "private class", "class"]
_OK_TAIL = ["*/", "{", "}", ";"]


@query("m17_missing_semicolon", "files", oracle=f"""
SELECT file_id, CAST(min(i) AS INT) AS line_no, arg_min(s, i) AS line FROM (
  SELECT file_id, trim(unnest({lines(X)})) AS s, generate_subscripts({lines(X)}, 1) AS i FROM files)
WHERE s <> '' AND NOT ({' OR '.join([f"starts_with(s, {q(h)})" for h in _OK_HEAD] + [f"ends_with(s, {q(e)})" for e in _OK_TAIL])})
GROUP BY file_id""")
def _m17(t):
    return m.missing_semicolon(_texts(t))


_PY_LINES = f"""SELECT file_id, unnest({lines('content')}) AS s, CAST(generate_subscripts({lines('content')}, 1) AS INT) AS i FROM code_files WHERE language = 'python'"""


@query("m18_long_functions", "code_files", oracle=rf"""
WITH l AS (SELECT *, length(s) - length(ltrim(s)) AS ind, starts_with(trim(s), 'def ') AS head FROM ({_PY_LINES})),
h AS (SELECT *, lead(i) OVER (PARTITION BY file_id ORDER BY i) AS nxt FROM l WHERE head),
e AS (SELECT h.file_id, h.i, any_value(h.s) AS s, min(l.i) AS stop FROM h JOIN l ON l.file_id = h.file_id AND l.i > h.i AND l.i < coalesce(h.nxt, 1000000) AND l.ind <= h.ind AND regexp_matches(l.s, '\S') GROUP BY 1, 2)
SELECT file_id, regexp_extract(s, 'def\s+([\p{{L}}\p{{N}}_]+)', 1) AS name, i AS line_no, CAST(stop - i AS INT) AS following_lines FROM e WHERE stop - i > 8""")
def _m18(t):
    return m.long_functions(t.code_files.filter("language = 'python'"), limit=8)


_MAGIC = rf"""SELECT file_id, i AS line_no, unnest(regexp_extract_all(w, '\b(?:[2-9]|[1-9][0-9]+)(?:[.][0-9]+)?\b')) AS literal FROM (
  SELECT file_id, s, i, {ascii_words('s')} AS w FROM (SELECT file_id, unnest({lines('content')}) AS s, CAST(generate_subscripts({lines('content')}, 1) AS INT) AS i FROM code_files))
WHERE NOT starts_with(trim(s), '#') AND NOT contains(s, repeat(chr(34), 3)) AND NOT contains(s, chr(39) || chr(39) || chr(39)) AND NOT contains(s, 'import ') AND regexp_matches(s, '[-=+*/%<>]')"""
_MAGIC = f"SELECT *, 'CONSTANT_' || replace(literal, '.', '_') AS constant FROM ({_MAGIC}) WHERE literal NOT IN ('2', '3', '4', '5', '10', '100') AND floor(CAST(literal AS DOUBLE)) > 5"


@query("m19_magic_numbers", "code_files", oracle=_MAGIC)
def _m19(t):
    return m.magic_numbers(t.code_files)


@query("m19_magic_number_totals", "code_files", oracle=f"SELECT literal, count(*) AS occurrences, count(DISTINCT file_id) AS files FROM ({_MAGIC}) GROUP BY literal")
def _m19b(t):
    return m.magic_number_totals(m.magic_numbers(t.code_files))


@query("m20_snippet", "files", oracle=f"""
SELECT file_id, CASE WHEN {line_total(X)} <= 5 THEN {X} ELSE array_to_string(list_slice({lines(X)}, 1, 5), chr(10)) || chr(10) || chr(10) || '# ... ('
  || ({line_total(X)} - 5) || ' more lines truncated)' END AS snippet FROM files""")
def _m20(t):
    return m.snippet(_texts(t), 5).select("file_id", "snippet")


@query("p1_python_facts")
def _p1(t):
    return pyfacts.python_facts(t.code_files).drop("args")


@query("p2_structure_info", oracle=f"""
SELECT file_id, 1 AS n_classes, 3 AS n_functions, 'os,typing.List' AS imports, FALSE AS has_main, 1 AS n_docstrings, CAST(d + 9 AS INT) AS complexity_score, CAST(NULL AS VARCHAR) AS error FROM {_PYTHON} p
UNION ALL SELECT file_id, 0, 0, '', FALSE, 0, 0, 'Syntax error at line ' || (32 + d) || ': invalid syntax' FROM {BROKEN_SKELETONS} b""")
def _p2(t):
    return pyfacts.structure_info(t.code_files).select(
        "file_id", F.size("classes").alias("n_classes"), F.size("functions").alias("n_functions"), F.array_join("imports", ",").alias("imports"),
        "has_main", F.size("docstrings").alias("n_docstrings"), "complexity_score", "error",
    )


@query("p3_python_validity")
def _p3(t):
    return pyfacts.python_validity(t.code_files)
