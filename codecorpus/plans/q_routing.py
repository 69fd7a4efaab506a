"""Queries over routing and filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.operators import routing as r
from codecorpus.plans.duck import ext, q
from codecorpus.plans.registry import query


def _in(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


_PARENT = r"list_slice(string_split({p}, '/'), 1, len(string_split({p}, '/')) - 1)"


def _parents(p: str) -> str:
    return _PARENT.replace("{p}", p)


def _paths(df):
    return df.select("file_id", "relative_path")


@query("f1_skip_dirs", "scan", oracle=f"""
SELECT file_id, relative_path FROM scan
WHERE NOT list_has_any({_parents('relative_path')}, [{', '.join(q(d) for d in dims.SKIP_DIRECTORIES)}])""")
def _f1(t):
    return r.skip_dirs(_paths(t.scan))


@query("f2_glob_filter", "scan", oracle="""
SELECT file_id, relative_path FROM scan
WHERE regexp_matches(relative_path, '^src/.*[.](py|java|js.*)$') AND NOT regexp_matches(relative_path, '^src/f?r/.*$|^.*node_modules.*$')""")
def _f2(t):
    return r.glob_filter(_paths(t.scan), ["src/*.py", "src/*.java", "src/*.js*"], ["src/fr/*", "src/r/*", "*node_modules*"])


@query("f3_code_files", "scan", oracle=f"""
SELECT file_id, relative_path FROM scan
WHERE NOT regexp_matches(relative_path, '(^|/)[.]') AND {ext('relative_path')} IN {_in(dims.CODE_EXTENSIONS)}
  AND NOT list_has_any({_parents('relative_path')}, [{', '.join(q(d) for d in dims.BUILD_DIRECTORIES)}])""")
def _f3(t):
    return r.code_files(_paths(t.scan))


_MESSY = "CASE file_id % 5 WHEN 0 THEN concat('/', relative_path) WHEN 1 THEN concat('../', relative_path) WHEN 2 THEN concat(repeat('d/', CAST(file_id % 400 AS INT)), relative_path) ELSE relative_path END"


@query("f4_safe_paths", "scan", oracle=f"""
SELECT file_id, relative_path FROM (SELECT file_id, {_MESSY} AS relative_path FROM scan)
WHERE NOT contains(relative_path, '..') AND NOT starts_with(relative_path, '/') AND length(relative_path) <= 500""")
def _f4(t):
    return r.safe_paths(t.scan.select("file_id", F.expr(_MESSY).alias("relative_path")))


@query("f5_by_language", "scan", oracle=f"SELECT file_id, language FROM scan WHERE language IN {_in(dims.REFACTORABLE)}")
def _f5(t):
    return r.by_language(t.scan.select("file_id", "language"))


@query("f6_by_size", "scan", oracle="SELECT file_id, size_bytes FROM scan WHERE size_bytes BETWEEN 500 AND 5000")
def _f6(t):
    return r.by_size(t.scan.select("file_id", "size_bytes"), 500, 5000)


@query("f7_by_complexity", "scan", oracle="SELECT file_id, complexity_estimate FROM scan WHERE complexity_estimate BETWEEN 70 AND 90")
def _f7(t):
    return r.by_complexity(t.scan.select("file_id", "complexity_estimate"), 70, 90)


@query("f8_route_scan", "scan", oracle=f"""
SELECT file_id, CASE WHEN is_binary THEN 'binary' WHEN size_bytes = 0 THEN 'empty' WHEN size_bytes > 8000 THEN 'large'
  WHEN language IN {_in(dims.REFACTORABLE)} THEN 'supported' ELSE 'unsupported' END AS category FROM scan""")
def _f8(t):
    return r.route_scan(t.scan.select("file_id", "is_binary", "size_bytes", "language"), 8000).select("file_id", "category")


@query("f9_route_processing", "files", oracle=f"""
SELECT file_id, CASE WHEN language NOT IN {_in(dims.PROCESSED_LANGUAGES)} OR length(original_content) > 6000 THEN 'skipped'
    WHEN NOT regexp_matches(original_content, '\\S') THEN 'completed' ELSE 'process' END AS route,
  CASE WHEN language NOT IN {_in(dims.PROCESSED_LANGUAGES)} THEN 'Language "' || language || '" is not supported for refactoring'
    WHEN length(original_content) > 6000 THEN 'File is too large for processing (maximum 50KB allowed)'
    WHEN NOT regexp_matches(original_content, '\\S') THEN 'File is empty' ELSE '' END AS route_message
FROM files""")
def _f9(t):
    return r.route_processing(t.files.select("file_id", "language", "original_content"), limit=6000).drop("language", "original_content")


@query("f10_in_window", "sessions", "files", oracle="""
SELECT file_id, session_id, status FROM files WHERE session_id IN (SELECT session_id FROM sessions
  WHERE created_at BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-12')""")
def _f10(t):
    start, end = (F.lit(d).cast("timestamp") for d in ("2024-01-04", "2024-01-12"))
    _, files = r.in_window(t.sessions, t.files.select("file_id", "session_id", "status"), start, end)
    return files.select("file_id", "session_id", "status")


@query("f11_worklist", "files", oracle="""
SELECT file_id, original_path FROM files WHERE lower(language) = 'python' AND status = 'completed' AND original_content <> ''
ORDER BY file_id LIMIT 25""")
def _f11(t):
    return r.worklist(t.files, language="PYTHON", status="completed", limit=25).select("file_id", "original_path")


@query("f12_search_errors", "files", oracle="""
SELECT file_id, error_message FROM files WHERE lower(error_message) LIKE '%syntax%' AND lower(error_message) NOT LIKE '%fixed%'
UNION ALL SELECT file_id, error_message FROM files WHERE lower(error_message) LIKE '%enhanced:%'""")
def _f12(t):
    files = t.files.select("file_id", "error_message")
    return r.search_errors(files, "Syntax", "FIXED").unionByName(r.search_errors(files, "Enhanced:"))


@query("f13_changed_files", "changes", oracle=f"""
SELECT DISTINCT path FROM changes WHERE change_type IN ('A', 'C', 'M')
  AND ({' OR '.join(f"ends_with(path, {q(e)})" for e in dims.COMMIT_EXTENSIONS)})""")
def _f13(t):
    return r.changed_files(t.changes)


@query("f14_list_files", "files", "sessions", oracle="""
SELECT file_id, original_path, original_filename FROM files JOIN sessions USING (session_id)
WHERE files.status = 'completed' AND (contains(lower(original_path), 'f1') OR contains(lower(original_filename), 'src1'))""")
def _f14(t):
    return r.list_files(t.files, t.sessions, status="completed", text="f1").select("file_id", "original_path", "original_filename").unionByName(
        r.list_files(t.files, t.sessions, status="completed", text="SRC1").filter(~F.lower("original_path").contains("f1"))
        .select("file_id", "original_path", "original_filename")
    )


@query("f15_preview", "scan", oracle="""
SELECT file_id, CASE WHEN size_bytes > 100000 THEN 'Skip (Large)' WHEN size_bytes = 0 THEN 'Skip (Empty)' ELSE 'Ready' END AS preview FROM scan""")
def _f15(t):
    return r.preview(t.scan.select("file_id", "size_bytes")).select("file_id", "preview")


