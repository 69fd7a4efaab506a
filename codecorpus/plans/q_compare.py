"""Queries over version comparison and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.operators import compare as c
from codecorpus.plans.duck import has_any, line_total, lines, q
from codecorpus.plans.registry import query

B, A = "original_content", "refactored_content"


def _both(t, *extra):
    return t.files.filter("refactored_content <> ''").select("file_id", B, A, *extra)


@query("j1_session_files", "sessions", "files", oracle="""
SELECT session_id, file_id, original_path, f.status, s.status AS session_status FROM files f JOIN sessions s USING (session_id)""")
def _j1(t):
    return c.session_files(t.sessions, t.files).select("session_id", "file_id", "original_path", "status", "session_status")


def _versions(t):
    """Python sources and a rewritten version: a function renamed, branches removed, or broken, by id."""
    after = F.expr(
        "CASE file_id % 12 WHEN 0 THEN replace(content, 'def load_', 'def fetch_') WHEN 4 THEN regexp_replace(content, '(?m)^ +if .*:$', '            pass') "
        "ELSE concat(content, chr(10), 'class Extra:', chr(10), '    pass', chr(10)) END"
    )
    return t.code_files.filter("language = 'python'").select("file_id", F.col("content").alias(B), after.alias(A))


@query("j2_compare_structure")
def _j2(t):
    out = c.compare_structure(_versions(t))
    arrays = ["removed_classes", "added_classes", "removed_functions", "added_functions", "warnings"]
    return out.withColumns({x: F.array_join(x, "|") for x in arrays})


@query("j3_changed_lines_positional", "files", oracle=f"""
SELECT file_id, CAST(len(list_filter(range(1, greatest({line_total(B)}, {line_total(A)}) + 1),
  lambda i: coalesce({lines(B)}[i], '') <> coalesce({lines(A)}[i], ''))) AS INT) AS changed_lines FROM files WHERE refactored_content <> ''""")
def _j3(t):
    return c.changed_lines_positional(_both(t)).select("file_id", "changed_lines")


_DIFF = f"""(SELECT file_id, CAST(sum(abs(w)) AS INT) AS changed FROM (SELECT file_id, s, sum(w) AS w FROM (
  SELECT file_id, unnest({lines(B)}) AS s, 1 AS w FROM files WHERE {A} <> '' UNION ALL SELECT file_id, unnest({lines(A)}), -1 FROM files WHERE {A} <> '') GROUP BY 1, 2) GROUP BY 1)"""


@query("j4_diff_stats", "files", oracle=f"""
SELECT file_id, CAST({line_total(B)} AS INT) AS lines_before, CAST({line_total(A)} AS INT) AS lines_after, CAST({line_total(A)} - {line_total(B)} AS INT) AS lines_added,
  changed AS lines_changed, md5({B}) AS hash_before, md5({A}) AS hash_after FROM files JOIN {_DIFF} USING (file_id)""")
def _j4(t):
    return c.diff_stats(_both(t)).drop(B, A)


@query("j5_similarity", "files", oracle=f"""
SELECT file_id, CAST({line_total(B)} + {line_total(A)} - changed AS DOUBLE) / ({line_total(B)} + {line_total(A)}) AS similarity FROM files JOIN {_DIFF} USING (file_id)""")
def _j5(t):
    return c.similarity(_both(t)).select("file_id", "similarity")


_SHORT = f"CASE WHEN file_id % 6 = 0 THEN '  ' WHEN file_id % 6 = 1 THEN substr({B}, 1, CAST(length({B}) / 3 AS INT)) ELSE {A} END"


@query("j6_acceptance_warnings", "files", oracle=f"""
SELECT file_id, CASE WHEN NOT regexp_matches(a, '\\S') THEN 'Refactored code is empty' WHEN length(a) < length({B}) * 5e-1
  THEN 'Refactored code is significantly shorter than original' ELSE '' END AS warnings FROM (SELECT file_id, {B}, {_SHORT} AS a FROM files)""")
def _j6(t):
    df = t.files.select("file_id", "language", B, F.expr(_SHORT).alias(A))
    return c.acceptance_warnings(df, python=False).select("file_id", F.array_join("warnings", "; ").alias("warnings"))


@query("j6_acceptance_warnings_python")
def _j6b(t):
    df = _versions(t).withColumn("language", F.lit("Python"))
    return c.acceptance_warnings(df).select("file_id", F.array_join("warnings", "; ").alias("warnings"))


_WARN = "CASE file_id % 4 WHEN 0 THEN 'Syntax error at line 3' WHEN 1 THEN 'Style: long line' WHEN 2 THEN 'Unexpected EOF while parsing' ELSE '' END"


@query("j7_decide_outcome", "files", oracle=f"""
SELECT file_id, CASE WHEN blank THEN 'completed' WHEN syn THEN 'failed' ELSE 'completed' END AS outcome,
  CASE WHEN blank THEN 'Refactoring returned empty code, kept original' WHEN syn THEN 'Refactored code has syntax errors: ' || w || '; note' ELSE w || '; note' END AS outcome_message,
  md5(CASE WHEN blank OR syn THEN {B} ELSE {A} END) AS content_hash
FROM (SELECT *, NOT regexp_matches({A}, '\\S') AS blank, {has_any('lower(w)', dims.SYNTAX_WARNING_WORDS)} AS syn FROM (SELECT file_id, {B}, {A}, {_WARN} AS w FROM files))""")
def _j7(t):
    df = t.files.select("file_id", B, A, F.array(F.expr(_WARN), F.lit("note")).alias("warnings"))
    return c.decide_outcome(df).select("file_id", "outcome", "outcome_message", F.md5("outcome_content").alias("content_hash"))


_SUGGESTIONS = """
SELECT file_id, CAST(k AS INT) AS position, CASE WHEN (file_id + k) % 3 = 0 THEN 'transformation' ELSE 'rename' END AS kind,
  CASE k WHEN 0 THEN 'items' WHEN 1 THEN 'path' ELSE 'names' END AS old_name,
  CASE (file_id + k) % 4 WHEN 0 THEN 'new_items' WHEN 1 THEN 'filePath' WHEN 2 THEN 'allNames' ELSE 'bad name' END AS new_name,
  CAST((file_id + k * 3) % 11 AS DOUBLE) / 10 AS confidence, CASE file_id % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'moderate' ELSE 'risky' END AS safety_level,
  CASE file_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' ELSE 'cpp' END AS language
FROM (SELECT doc_id AS file_id, 0 AS k FROM documents UNION ALL SELECT doc_id, 1 FROM documents UNION ALL SELECT doc_id, 2 FROM documents) s
"""


def suggestions(t):
    return t.sql(_SUGGESTIONS, "documents")


def _rename_sql() -> str:
    """Accepted renames applied one after the other; the derived names are plain ASCII words."""
    sql, n = "content", "0"
    for k, old in enumerate(("items", "path", "names")):
        ok = f"((file_id + {k}) % 3 <> 0 AND CAST((file_id + {k * 3}) % 11 AS DOUBLE) / 10 >= 7e-1)"
        new = f"CASE (file_id + {k}) % 4 WHEN 0 THEN 'new_items' WHEN 1 THEN 'filePath' WHEN 2 THEN 'allNames' ELSE 'bad name' END"
        sql = f"CASE WHEN {ok} THEN regexp_replace({sql}, '\\b{old}\\b', {new}, 'g') ELSE {sql} END"
        n += f" + CAST({ok} AS INT)"
    return f"SELECT file_id, CAST({n} AS INT) AS n_renames, md5({sql}) AS content_hash FROM code_files"


@query("j8_apply_renames", "code_files", oracle=_rename_sql())
def _j8(t):
    out = c.apply_renames(t.code_files, suggestions(t))
    return out.select("file_id", F.coalesce(F.size("renames"), F.lit(0)).alias("n_renames"), F.md5("renamed_content").alias("content_hash"))


@query("j9_filter_suggestions", oracle=rf"""
SELECT file_id, position, reason AS skip_reason, reason IS NULL AS accepted FROM (SELECT *, CASE WHEN kind = 'transformation' AND safety_level NOT IN ('safe', 'moderate') THEN 'Safety check failed'
  WHEN (kind = 'transformation' AND NOT confidence > 6e-1) OR (kind = 'rename' AND NOT confidence > 7e-1) THEN 'Low confidence: ' || confidence
  WHEN kind = 'rename' AND NOT (regexp_matches(replace(replace(new_name, '_', ''), '-', ''), '^[a-zA-Z0-9]+$') AND CASE language WHEN 'python' THEN new_name = lower(new_name) OR contains(new_name, '_')
    WHEN 'cpp' THEN true ELSE NOT contains(new_name, '_') END) THEN 'Invalid name' END AS reason FROM ({_SUGGESTIONS}))""")
def _j9(t):
    return c.filter_suggestions(suggestions(t)).select("file_id", "position", "skip_reason", "accepted")


@query("j10_related_files", "files", oracle="""
WITH p AS (SELECT file_id, original_path AS path, regexp_extract(original_path, '([.][^./]*)$', 1) AS e, row_number() OVER (PARTITION BY regexp_extract(original_path, '([.][^./]*)$', 1) ORDER BY original_path) AS rn FROM files)
SELECT a.file_id, string_agg(b.path, ',' ORDER BY b.path) AS related FROM p a JOIN p b ON a.e = b.e AND b.file_id <> a.file_id AND b.rn <= CASE WHEN a.rn <= 20 THEN 21 ELSE 20 END GROUP BY 1""")
def _j10(t):
    return c.related_files(t.files).select("file_id", F.array_join("related", ",").alias("related"))


@query("j10_folder_context", "scan", oracle=f"""
WITH u AS (SELECT file_id, relative_path AS path, language, size_bytes, line_count, regexp_replace(relative_path, '/[^/]*$', '') AS folder, content FROM scan
  WHERE language IN ({', '.join(q(x) for x in dims.REFACTORABLE)}) AND NOT is_binary AND size_bytes BETWEEN 1 AND 524288),
s AS (SELECT file_id, language, regexp_replace(relative_path, '/[^/]*$', '') AS folder FROM scan),
f AS (SELECT DISTINCT folder FROM s),
m AS (SELECT f.folder, u.* EXCLUDE (folder) FROM f JOIN u ON starts_with(u.path, f.folder || '/')),
n AS (SELECT folder, count(*) AS total_files FROM m GROUP BY folder),
k AS (SELECT folder, language, count(*) AS language_files, CAST(sum(size_bytes) AS BIGINT) AS language_bytes, CAST(sum(line_count) AS BIGINT) AS language_lines FROM m GROUP BY 1, 2),
r AS (SELECT a.file_id, m.path, m.size_bytes, md5(substr(m.content, 1, 2048)) AS h, row_number() OVER (PARTITION BY a.file_id ORDER BY m.size_bytes, m.path) AS rn
  FROM s a JOIN m ON m.folder = a.folder AND m.language = a.language AND m.file_id <> a.file_id)
SELECT s.file_id, s.folder, coalesce(total_files, 0) AS total_files, coalesce(language_files, 0) AS language_files, coalesce(language_bytes, 0) AS language_bytes, coalesce(language_lines, 0) AS language_lines,
  coalesce((SELECT string_agg(r.path || ':' || h, ',' ORDER BY rn) FROM r WHERE r.file_id = s.file_id AND rn <= 5), '') AS related
FROM s LEFT JOIN n USING (folder) LEFT JOIN k ON k.folder = s.folder AND k.language = s.language""")
def _j10b(t):
    out = c.folder_context(t.scan)
    entries = F.transform("related_files", lambda x: F.concat(x["path"], F.lit(":"), F.md5(x["content_preview"])))
    return out.select("file_id", "folder", "total_files", "language_files", "language_bytes", "language_lines", F.array_join(entries, ",").alias("related"))


_PATHS = "SELECT original_path AS path FROM files WHERE file_id % 2 = 0"


@query("j12_mark_fixed", "files", oracle=f"""
SELECT file_id, CASE WHEN original_path IN ({_PATHS}) AND contains(lower(error_message), 'syntax') THEN replace(error_message, 'Syntax error', 'Syntax error (FIXED)')
  ELSE error_message END AS error_message FROM files""")
def _j12(t):
    return c.mark_fixed(t.files, t.sql(_PATHS, "files")).select("file_id", "error_message")


@query("j12_remaining_syntax_errors", "files", oracle=f"""
SELECT count(*) AS remaining FROM files WHERE contains(lower(error_message), 'syntax') AND NOT (original_path IN ({_PATHS}) AND contains(error_message, 'Syntax error'))""")
def _j12b(t):
    return c.remaining_syntax_errors(c.mark_fixed(t.files, t.sql(_PATHS, "files")))


_FIXED = "CASE file_id % 4 WHEN 0 THEN concat(original_content, original_content, original_content, '!') WHEN 1 THEN upper(original_content) ELSE refactored_content END"


@query("j13_plausible_fix", "files", oracle=f"""
SELECT file_id, length(fixed) <= length({B}) * 3 AND ({' OR '.join(f"(contains({B}, {q(w)}) AND contains(fixed, {q(w)}))" for w in dims.FIX_KEYWORDS)}) AS plausible
FROM (SELECT file_id, {B}, {_FIXED} AS fixed FROM files)""")
def _j13(t):
    df = t.files.select("file_id", F.col(B).alias("broken"), F.expr(_FIXED).alias("fixed"))
    return c.plausible_fix(df).select("file_id", "plausible")
