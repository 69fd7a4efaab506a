"""Queries over rewrite rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions.dims import PAIR_NAMES
from codecorpus.operators import metrics
from codecorpus.operators import rules as r
from codecorpus.plans.duck import q
from codecorpus.plans.registry import query


def _apply(t, language: str, *names: str):
    out = r.apply_rules(t.code_files.filter(F.col("language") == language), list(names))
    hits = F.aggregate(F.map_values("hits"), F.lit(0), lambda acc, v: acc + v)
    return out.select("file_id", F.md5("new_content").alias("content_hash"), hits.alias("hits"))


def _chain(language: str, *steps: tuple[str, str]) -> str:
    """Oracle of a rule chain: each step counts its matches on the text so far and replaces them."""
    sql = f"SELECT file_id, content, 0 AS hits FROM code_files WHERE language = '{language}'"
    for pattern, replacement in steps:
        p = q(pattern.replace(r"[\w.]", r"[\p{L}\p{N}_.]").replace(r"\w", r"[\p{L}\p{N}_]"))
        sql = f"SELECT file_id, regexp_replace(content, {p}, {q(replacement)}, 'g') AS content, hits + len(regexp_extract_all(content, {p})) AS hits FROM ({sql})"
    return f"SELECT file_id, md5(content) AS content_hash, CAST(hits AS INT) AS hits FROM ({sql})"


@query("r1_simplify_booleans", "code_files", oracle=_chain(
    "python", (r"if\s+([\w.]+)\s*==\s*True\b", r"if \1"), (r"if\s+([\w.]+)\s*==\s*False\b", r"if not \1"),
    (r"if\s+([\w.]+)\s*!=\s*True\b", r"if not \1"), (r"if\s+([\w.]+)\s*!=\s*False\b", r"if \1")))
def _r1(t):
    return _apply(t, "python", "bool_eq_true", "bool_eq_false", "bool_ne_true", "bool_ne_false")


# RE2 has no back-references; in the derived sources the appended list is always ``items``.
@query("r2_list_comprehension", "code_files", oracle=_chain(
    "python", (r"(\s*)(items)\s*=\s*\[\]\s*\n\s*for\s+(\w+)\s+in\s+(\w+):\s*\n\s*items\.append\(([^)]+)\)", r"\1\2 = [\5 for \3 in \4]")))
def _r2(t):
    return _apply(t, "python", "list_comprehension")


@query("r3_type_hints", "code_files", oracle=_chain("python", (r"def\s+(\w+)\(([^)]+)\):", r"def \1(\2) -> Any:")))
def _r3(t):
    # The derived sources already import from typing, so no import line is added.
    return _apply(t, "python", "type_hints")


@query("r4_except_exception", "code_files", oracle=_chain("python", (r"(?m)except:\s*$", "except Exception:"), (r"(?m)(except\s+\w+:\s*$)", "\\1\n    pass")).replace("content_hash, CAST(hits AS INT) AS hits", "content_hash"))
def _r4(t):
    return _apply(t, "python", "except_exception").drop("hits")


@query("r5_var_to_const", "code_files", oracle=_chain("javascript", (r"(?m)^([ \t]*)var ([ \t]*\w+[ \t]*=)", r"\1const \2")))
def _r5(t):
    return _apply(t, "javascript", "js_var_const")


@query("r5_var_to_const_any", "code_files", oracle=_chain("javascript", (r"\bvar\s+(\w+)\s*=", r"const \1 =")))
def _r5b(t):
    return _apply(t, "javascript", "js_var_const_any")


@query("r5_var_to_let", "code_files", oracle=_chain("javascript", (r"(?m)^([ \t]*)var[ \t]+", r"\1let ")))
def _r5c(t):
    return _apply(t, "javascript", "js_var_let")


@query("r6_arrow_functions", "code_files", oracle=_chain("javascript", (r"function\s*\(([^)]*)\)\s*\{\s*return\s+([^;]+);?\s*\}", r"(\1) => \2")))
def _r6(t):
    return _apply(t, "javascript", "js_arrow")


@query("r7_template_literals", "code_files", oracle=_chain("javascript", (r'"([^"]*?)"\s*\+\s*(\w+)\s*\+\s*"([^"]*?)"', r"`\1${\2}\3`")))
def _r7(t):
    return _apply(t, "javascript", "js_template_literal")


@query("r8_private_fields", "code_files", oracle=_chain("java", (r"(?m)^(\s*)(\w+\s+\w+\s*;)", r"\1private \2")))
def _r8(t):
    return _apply(t, "java", "java_private_field")


@query("r9_diamond", "code_files", oracle=_chain("java", (r"(\w+)<([^>]+)>\s+(\w+)\s*=\s*new\s+\w+<[^>]+>\(", r"\1<\2> \3 = new \1<>(")))
def _r9(t):
    return _apply(t, "java", "java_diamond")


@query("r10_for_each", "code_files", oracle=_chain(
    "java", (r"for\s*\(\s*(\w+)\s+(\w+)\s*:\s*(\w+)\s*\)\s*\{[^}]*System\.out\.println[^}]*\}", r"\3.forEach(System.out::println);")))
def _r10(t):
    return _apply(t, "java", "java_for_each")


@query("r11_modern_cpp", "code_files", oracle=_chain(
    "cpp", (r"\bNULL\b", "nullptr"), (r"typedef\s+(.+)\s+(\w+);", r"using \2 = \1;"), (r"\((\w+)\*?\)\s*(\w+)", r"static_cast<\1>(\2)")))
def _r11(t):
    return _apply(t, "cpp", "cpp_nullptr", "cpp_using", "cpp_static_cast")


@query("r12_unique_ptr", "code_files", oracle=_chain(
    "cpp", (r"(\w+)\*\s+(\w+)\s*=\s*new\s+\w+\s*\([^)]*\)", r"std::unique_ptr<\1> \2 = std::make_unique<\1>()")))
def _r12(t):
    return _apply(t, "cpp", "cpp_unique_ptr")


@query("r13_range_for", "code_files", oracle=_chain(
    "cpp", (r"for\s*\(\s*\w+\s+\w+\s*=\s*0\s*;\s*\w+\s*<\s*(\w+)\.size\(\)\s*;\s*\+\+\w+\s*\)", r"for(const auto& item : \1)")))
def _r13(t):
    return _apply(t, "cpp", "cpp_range_for")


_FILLED = "CASE file_id % 16 " + " ".join(f"WHEN {i} THEN {q(n)}" for i, n in enumerate(PAIR_NAMES)) + " END"


@query("r14_const_members", "code_files", oracle=f"""
SELECT file_id, md5(replace(replace(content, 'get_' || v || '() {{', 'get_' || v || '() const {{'), 'run_' || v || '(char* p) {{', 'run_' || v || '(char* p) const {{')) AS content_hash, 2 AS hits
FROM (SELECT file_id, content, {_FILLED} AS v FROM code_files WHERE language = 'cpp')""")
def _r14(t):
    return _apply(t, "cpp", "cpp_const_member")


# Kept lines: non-blank, or blank after a non-blank (or at the start); then trailing white space goes.
@query("r15_tidy", "files", oracle=r"""
SELECT file_id, md5(array_to_string(list_transform(list_filter(l, lambda s, i: regexp_matches(s, '\S') OR i = 1 OR regexp_matches(l[i - 1], '\S')), lambda s: rtrim(s)), chr(10))) AS content_hash
FROM (SELECT file_id, string_split(original_content, chr(10)) AS l FROM files)""")
def _r15(t):
    df = t.files.select("file_id", "language", F.col("original_content").alias("content"))
    return r.apply_rules(df, ["tidy"]).select("file_id", F.md5("new_content").alias("content_hash"))


_LONG = "concat('    total_', file_id, ' = ', repeat('value + ', CAST(4 + file_id % 9 AS INT)), '1', chr(10), content)"


@query("r16_break_assignment", "code_files", oracle=f"""
SELECT file_id, md5(array_to_string(list_transform(string_split(c, chr(10)), lambda s: CASE
  WHEN length(s) > 100 AND NOT starts_with(trim(s), '#') AND len(string_split(s, ' = ')) = 2 AND length(string_split(s, ' = ')[1]) < 50 AND length(string_split(s, ' = ')[2]) > 50
  THEN string_split(s, ' = ')[1] || ' = (' || chr(10) || repeat(' ', length(s) - length(ltrim(s)) + 4) || string_split(s, ' = ')[2] || chr(10) || repeat(' ', length(s) - length(ltrim(s))) || ')' ELSE s END), chr(10))) AS content_hash
FROM (SELECT file_id, {_LONG} AS c FROM code_files WHERE language = 'python')""")
def _r16(t):
    df = t.code_files.filter("language = 'python'").select("file_id", "language", F.expr(_LONG).alias("content"))
    return r.apply_rules(df, ["break_assignment"]).select("file_id", F.md5("new_content").alias("content_hash"))


def _doc_oracle(language: str, head: str, what: str) -> str:
    pad = "repeat(' ', length(s) - length(ltrim(s)))"
    return f"""
SELECT file_id, md5(array_to_string(list_transform(l, lambda s, i: CASE WHEN {head} AND contains(s, '{{')
    AND NOT starts_with(trim(coalesce(l[i - 1], '')), '//') AND NOT starts_with(trim(coalesce(l[i - 1], '')), '*')
  THEN {pad} || '/**' || chr(10) || {pad} || ' * TODO: Add {what} description' || chr(10) || {pad} || ' */' || chr(10) || s ELSE s END), chr(10))) AS content_hash
FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM code_files WHERE language = '{language}')"""


@query("r17_js_doc", "code_files", oracle=_doc_oracle("javascript", "(starts_with(trim(s), 'function ') OR contains(s, ' function ') OR contains(s, '=>'))", "function"))
def _r17(t):
    return _apply(t, "javascript", "js_doc").drop("hits")


@query("r17_java_doc", "code_files", oracle=_doc_oracle("java", "(contains(s, 'public ') OR contains(s, 'private ') OR contains(s, 'protected ')) AND contains(s, '(')", "method"))
def _r17b(t):
    return _apply(t, "java", "java_doc").drop("hits")


@query("r17_python_docstrings")
def _r17c(t):
    out = r.python_docstrings(t.code_files.filter("language = 'python'"))
    return out.select("file_id", F.md5("new_content").alias("content_hash"), F.array_join("documented", ",").alias("documented"))


_NAMES = "SELECT doc_id AS file_id, 1 AS position, CASE doc_id % 4 WHEN 1 THEN concat('process', n) WHEN 2 THEN concat('label_', n) ELSE concat('run_', n) END AS function_name, concat('About ', n) AS comment, 'names' AS variable FROM (SELECT *, CASE doc_id % 16 WHEN 1 THEN 'value' WHEN 2 THEN 'data' WHEN 3 THEN 'input' ELSE 'other' END AS n FROM documents) d"


@query("r18_add_comments")
def _r18(t):
    out = r.add_comments(t.code_files.filter("language <> 'python'"), t.sql(_NAMES, "documents"))
    return out.select("file_id", F.md5("new_content").alias("content_hash"), (F.length("new_content") - F.length("content")).alias("added_chars"))


@query("r18_add_annotations")
def _r18b(t):
    s = t.sql(_NAMES, "documents").withColumn("annotations", F.array(F.lit("Override"), F.lit("Deprecated")))
    out = r.add_annotations(t.code_files.filter("language = 'java'"), s)
    return out.select("file_id", F.md5("new_content").alias("content_hash"), (F.length("new_content") - F.length("content")).alias("added_chars"))


@query("r19_null_checks", "code_files", oracle=r"""
SELECT file_id, md5(regexp_replace(content, '(names\.[\p{L}\p{N}_]+\([^)]*\))', 'if (names != null) { \1; }', 'g')) AS content_hash
FROM (SELECT file_id, replace(content, 'return 0', 'names.size()') AS content FROM code_files WHERE language = 'java')""")
def _r19(t):
    df = t.code_files.filter("language = 'java'").withColumn("content", F.replace("content", F.lit("return 0"), F.lit("names.size()")))
    return r.add_null_checks(df, t.sql(_NAMES, "documents")).select("file_id", F.md5("new_content").alias("content_hash"))


@query("r20_add_async", "code_files", oracle=f"""
SELECT c.file_id, md5(regexp_replace(content, '(function\\s+' || function_name || '\\s*\\([^)]*\\))', 'async \\1', 'g')) AS content_hash
FROM code_files c JOIN ({_NAMES}) n USING (file_id) WHERE language = 'javascript'""")
def _r20(t):
    return r.add_async(t.code_files.filter("language = 'javascript'"), t.sql(_NAMES, "documents")).select("file_id", F.md5("new_content").alias("content_hash"))


@query("r_apply_rules_all")
def _rall(t):
    out = r.apply_rules(t.code_files)
    hits = F.array_join(F.transform(F.map_entries("hits"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("file_id", F.md5("new_content").alias("content_hash"), hits.alias("hits"))


@query("r_rule_totals")
def _rtot(t):
    return r.rule_totals(r.apply_rules(t.code_files))


@query("j11_reprocess")
def _j11(t):
    stored = t.code_files.select(
        "file_id", "session_id", "original_path", "language", F.col("content").alias("original_content"), F.lit("").alias("refactored_content"),
        F.expr("CASE file_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'processing' END").alias("status"),
        F.expr("CASE file_id % 3 WHEN 0 THEN 'LLM service error' ELSE '' END").alias("error_message"), F.lit(0).alias("complexity_score"),
        F.lit(0).alias("readability_score"), F.lit(0).alias("maintainability_score"), F.lit(0).alias("overall_quality_score"),
    )
    return r.reprocess(stored).select("file_id", "status", "error_message", "updated", "complexity_score", "overall_quality_score", F.md5("refactored_content").alias("content_hash"))


@query("r21_extract_constants")
def _r21(t):
    out = metrics.extract_constants(t.code_files.filter("language = 'python'"))
    return out.select("file_id", "constants", F.md5("new_content").alias("content_hash"))


@query("r22_long_function_notes")
def _r22(t):
    out = metrics.note_long_functions(t.code_files.filter("language = 'python'"))
    return out.select("file_id", F.md5("new_content").alias("content_hash"), (F.length("new_content") - F.length("content")).alias("added_chars"))
