"""Queries over analytics, ranking, scans, runs and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.operators import accuracy as a
from codecorpus.operators import ranking as r
from codecorpus.plans.duck import SCORE_COLUMNS, pct, q, stable_bucket
from codecorpus.plans.registry import query
from codecorpus.sources.sinks import report

DONE, FAIL = "status = 'completed'", "status = 'failed'"
SCORED = "(status = 'completed' AND overall_quality_score > 0)"
ENH = "contains(lower(error_message), 'enhanced:')"


def n(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


def avgs(cond: str, prefix: str = "avg_") -> str:
    return ", ".join(f"coalesce(avg({c}) FILTER ({cond}), 0e0) AS {prefix}{k}" for k, c in SCORE_COLUMNS.items())


def _files(t):
    return t.files.drop("original_content", "created_at")


@query("a1_overall_accuracy", "sessions", "files", oracle=f"""
SELECT *, {pct('completed_sessions', 'total_sessions')} AS session_success_rate, {pct('completed_files', 'total_files')} AS file_success_rate,
  {pct('files_with_quality_metrics', 'total_files')} AS true_accuracy
FROM (SELECT count(*) AS total_sessions, {', '.join(f"{n(f'status = {q(s)}')} AS {s}_sessions" for s in ('completed', 'failed', 'processing'))} FROM sessions),
  (SELECT count(*) AS total_files, {', '.join(f"{n(f'status = {q(s)}')} AS {s}_files" for s in ('completed', 'failed', 'processing'))},
    {n(SCORED)} AS files_with_quality_metrics FROM files)""")
def _a1(t):
    return a.overall_accuracy(t.sessions, t.files)


@query("a2_language_accuracy", "files", oracle=f"""
SELECT language, count(*) AS total_files, {n(DONE)} AS completed_files, {n(FAIL)} AS failed_files, {avgs(SCORED)},
  {pct(n(DONE), 'count(*)')} AS success_rate, {pct(n(SCORED), 'count(*)')} AS quality_accuracy FROM files GROUP BY language""")
def _a2(t):
    return a.language_accuracy(t.files)


_BANDS = {"excellent": ">= 90", "good": "BETWEEN 75 AND 89", "fair": "BETWEEN 60 AND 74", "poor": "< 60"}


@query("a3_quality_summary", "files", oracle=f"""
SELECT {n(SCORED)} AS files_analyzed, {avgs(SCORED)},
  {', '.join(f"{n(f'{SCORED} AND overall_quality_score {c}')} AS {b}_count, {pct(n(f'{SCORED} AND overall_quality_score {c}'), n(SCORED))} AS {b}_pct" for b, c in _BANDS.items())}
FROM files""")
def _a3(t):
    return a.quality_summary(t.files)


@query("a4_failure_classes", "files", oracle="""
SELECT CASE WHEN lower(error_message) LIKE '%syntax%' THEN 'syntax_errors' WHEN lower(error_message) LIKE '%timeout%' THEN 'timeout_errors'
  WHEN lower(error_message) LIKE '%llm%' THEN 'llm_errors' WHEN lower(error_message) LIKE '%validation%' THEN 'validation_errors' ELSE 'other_errors' END AS error_class,
  count(*) AS files FROM files WHERE status = 'failed' AND error_message <> '' GROUP BY 1""")
def _a4(t):
    return a.failure_classes(t.files)


@query("a5_error_rate", "files", oracle=f"""
SELECT language, {n(FAIL)} AS failed_files, count(*) AS total_files, {pct(n(FAIL), 'count(*)')} AS error_rate FROM files GROUP BY language""")
def _a5(t):
    return a.error_rate(t.files)


_CLEAN, _WARN = f"{DONE} AND error_message = ''", f"{DONE} AND error_message <> ''"


@query("a6_validation_accuracy", "files", oracle=f"""
SELECT count(*) AS total_files, {n(DONE)} AS total_completed, {n(_CLEAN)} AS clean_completions, {n(_WARN)} AS completed_with_warnings,
  {pct(n(_CLEAN), 'count(*)')} AS validation_accuracy, {pct(n(_WARN), n(DONE))} AS warning_rate FROM files""")
def _a6(t):
    return a.validation_accuracy(t.files)


@query("a7_assessment", "files", oracle=f"""
SELECT acc AS true_accuracy, warn AS warning_rate, o AS avg_overall,
  CASE WHEN acc >= 90 THEN 'EXCELLENT' WHEN acc >= 75 THEN 'GOOD' WHEN acc >= 60 THEN 'FAIR' ELSE 'NEEDS IMPROVEMENT' END AS assessment,
  concat_ws('; ', CASE WHEN acc < 75 THEN 'Review and improve error handling for failed refactorings' END,
    CASE WHEN warn > 20 THEN 'Investigate validation warnings to improve code quality' END,
    CASE WHEN f > total * 1e-1 THEN 'Analyze common error patterns to prevent failures' END,
    CASE WHEN o < 75 THEN 'Enhance refactoring algorithms to improve quality scores' END) AS recommendations
FROM (SELECT {pct(n(SCORED), 'count(*)')} AS acc, {pct(n(_WARN), n(DONE))} AS warn, {n(FAIL)} AS f, count(*) AS total,
  coalesce(avg(overall_quality_score) FILTER ({SCORED}), 0e0) AS o FROM files)""")
def _a7(t):
    return a.assessment(t.files).withColumn("recommendations", F.array_join("recommendations", "; "))


_ALL3 = f"({DONE} AND complexity_score <> 0 AND readability_score <> 0 AND maintainability_score <> 0)"
_IMPROVED = f"({_ALL3} AND (complexity_score > 65 OR readability_score > 50 OR maintainability_score > 50))"


def _improvement(base: str) -> str:
    sums = ", ".join(
        f"{pct(f'coalesce(sum({SCORE_COLUMNS[k]}) FILTER ({_ALL3}), 0)', n(base), '1e0')} AS avg_{k}" for k in ("complexity", "readability", "maintainability"))
    return (f"count(*) AS total_files, {n(DONE)} AS successful_files, {n(FAIL)} AS failed_files, {n(_IMPROVED)} AS files_with_improvements, {sums}, "
            f"{pct(n(DONE), 'count(*)')} AS success_rate, {pct(n(_IMPROVED), 'count(*)')} AS true_accuracy")


@query("a8_improvement_accuracy", "sessions", "files", oracle=f"""
SELECT language, {_improvement(DONE)} FROM files GROUP BY language UNION ALL SELECT NULL, {_improvement(_ALL3)} FROM files""")
def _a8(t):
    return a.improvement_accuracy(t.sessions, t.files)


@query("a9_recommendations", "files", oracle=f"""
WITH l AS (SELECT language, count(*) AS c, {pct(n(DONE), 'count(*)')} AS rate FROM files GROUP BY language),
g AS (SELECT {pct(n(_IMPROVED), 'count(*)')} AS acc, {n(f"{FAIL} AND contains(lower(error_message), 'syntax')")} AS syn FROM files),
r AS (SELECT 1 AS k, '' AS s, 'Consider further improving complexity scoring algorithms' AS recommendation FROM g WHERE acc < 85
  UNION ALL SELECT 2, '', 'Implement better syntax error handling and validation' FROM g WHERE syn > 0
  UNION ALL SELECT 3, language, 'Improve ' || language || ' language support (current success rate: ' || format('{{:.1f}}', rate) || '%)' FROM l WHERE rate < 80 AND c > 5)
SELECT CAST(row_number() OVER (ORDER BY k, s) - 1 AS INT) AS position, recommendation FROM r""")
def _a9(t):
    return a.recommendations(t.files)


_STATES = ("completed", "failed", "processing", "skipped")


@query("a10_session_summary", "sessions", "files", oracle=f"""
SELECT s.session_id, original_filename, coalesce(c, 0) AS total_files, {', '.join(f'coalesce(n_{v}, 0) AS {v}_files' for v in _STATES)},
  {pct('n_completed', 'c')} AS success_rate, {', '.join(f'coalesce(a_{k}, 0e0) AS avg_{k}' for k in SCORE_COLUMNS)}, languages
FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS c, {', '.join(f"{n(f'status = {q(v)}')} AS n_{v}" for v in _STATES)}, {avgs(SCORED, 'a_')} FROM files GROUP BY 1) f
  USING (session_id) LEFT JOIN (SELECT session_id, string_agg(language || '=' || k, ',' ORDER BY language) AS languages
    FROM (SELECT session_id, language, count(*) AS k FROM files GROUP BY 1, 2) GROUP BY 1) g USING (session_id)""")
def _a10(t):
    entries = F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return a.session_summary(t.sessions, t.files).withColumn("languages", F.array_join(F.array_sort(entries), ","))


@query("a11_compare_sessions", "sessions", "files", oracle=f"""
SELECT session_id, epoch_us(created_at) AS created_us, s.status, count(*) AS total_files, {n("f.status = 'completed'")} AS completed_files,
  {n("f.status = 'failed'")} AS failed_files, {pct(n("f.status = 'completed'"), 'count(*)')} AS success_rate, {n("language = 'Java'")} AS java_files
FROM sessions s JOIN (SELECT session_id, status, language FROM files) f USING (session_id) GROUP BY ALL""")
def _a11(t):
    return a.compare_sessions(t.sessions, t.files, "success_rate").select(
        "session_id", F.unix_micros("created_at").alias("created_us"), "status", "total_files", "completed_files", "failed_files", "success_rate",
        F.coalesce(F.try_element_at("languages", F.lit("Java")), F.lit(0)).alias("java_files"),
    )


@query("a12_session_progress", "sessions", "files", oracle=f"""
SELECT session_id, s.status, s.total_files, s.processed_files, {n("f.status = 'completed'")} AS completed_files, {n("f.status = 'failed'")} AS failed_files,
  {n("f.status = 'processing'")} AS processing_files, CAST(s.processed_files AS DOUBLE) / s.total_files * 100e0 AS progress,
  CAST(floor(CAST({n("f.status IN ('completed', 'failed')")} AS DOUBLE) / count(*) * 100e0) AS INT) AS progress_percentage
FROM sessions s JOIN (SELECT session_id, status FROM files) f USING (session_id) GROUP BY ALL""")
def _a12(t):
    return a.session_progress(t.sessions, t.files)


@query("a13_enhancement_coverage", "files", oracle=f"SELECT count(*) AS total_files, {n(ENH)} AS enhanced_files, {pct(n(ENH), 'count(*)')} AS coverage FROM files")
def _a13(t):
    return a.enhancement_coverage(t.files)


@query("a14_enhanced_vs_all", "files", oracle="SELECT *, enhanced_files - all_files AS difference, (enhanced_files - all_files) / all_files * 100e0 AS difference_pct FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS metric, avg({c}) AS all_files, avg({c}) FILTER ({ENH}) AS enhanced_files FROM files WHERE overall_quality_score <> 0" for k, c in SCORE_COLUMNS.items()) + ")")
def _a14(t):
    return a.enhanced_vs_all(t.files)


@query("a15_band_comparison", "files", oracle="SELECT *, enhanced_pct - all_pct AS difference_pct FROM (" + " UNION ALL ".join(
    f"SELECT {q(name)} AS band, {n(c)} AS all_count, {pct(n(c), 'count(*)')} AS all_pct, {n(f'{c} AND {ENH}')} AS enhanced_count, {pct(n(f'{c} AND {ENH}'), n(ENH))} AS enhanced_pct FROM files WHERE overall_quality_score <> 0"
    for name, c in ((name, f"overall_quality_score >= {lo} AND overall_quality_score < {hi}") for lo, hi, name in a.BANDS)) + ")")
def _a15(t):
    return a.band_comparison(t.files)


_PART = "lower(trim(split_part(split_part(error_message, 'Enhanced:', 2), '|', 1)))"
_TYPES = {
    name: " OR ".join("(" + " AND ".join(f"contains(p, {q(w)})" for w in words) + ")" for words in alts) for name, alts in dims.IMPROVEMENT_TYPES.items()
}


@query("a16_improvement_types", "files", oracle="SELECT improvement_type, count(*) AS files FROM (" + " UNION ALL ".join(
    f"SELECT {q(k)} AS improvement_type FROM (SELECT {_PART} AS p FROM files WHERE contains(error_message, 'Enhanced:')) WHERE {c}" for k, c in _TYPES.items()) + ") GROUP BY 1")
def _a16(t):
    return a.improvement_types(t.files)


_SCORED_ENH = f"{ENH} AND overall_quality_score <> 0"


@query("a17_improvement_impact", "files", oracle=" UNION ALL ".join(
    f"SELECT {q(k)} AS improvement_group, count(*) AS files, {', '.join(f'avg({c}) AS avg_{s}' for s, c in SCORE_COLUMNS.items())} FROM files WHERE {_SCORED_ENH} AND ({' OR '.join(f'contains(lower(error_message), {q(w)})' for w in words)}) HAVING count(*) > 0"
    for k, words in dims.IMPROVEMENT_GROUPS.items()))
def _a17(t):
    return a.improvement_impact(t.files)


@query("a18_language_improvements", "files", oracle=f"""
SELECT language, count(*) AS files, {', '.join(f'avg({c}) AS avg_{s}' for s, c in SCORE_COLUMNS.items())} FROM files WHERE {_SCORED_ENH} GROUP BY language""")
def _a18(t):
    return a.language_improvements(t.files)


_O = "overall_quality_score"


@query("a19_success_metrics", "files", oracle=f"""
SELECT {n(f'{_O} < 50')} AS low_all, {n(f'{_O} < 50 AND {ENH}')} AS low_enhanced, {n(f'{_O} >= 50')} AS medium_plus_all, {n(f'{_O} >= 50 AND {ENH}')} AS medium_plus_enhanced,
  {n(f'{_O} >= 85')} AS high_all, {n(f'{_O} >= 85 AND {ENH}')} AS high_enhanced, {pct(n(f'{_O} >= 50 AND {ENH}'), n(ENH))} AS achievement_rate
FROM files WHERE {_O} <> 0""")
def _a19(t):
    return a.success_metrics(t.files)


@query("a20_language_stats", "scan", oracle="""
SELECT language, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_size, CAST(sum(line_count) AS BIGINT) AS total_lines, avg(size_bytes) AS avg_file_size,
  avg(line_count) AS avg_lines_per_file, first(relative_path ORDER BY size_bytes DESC, relative_path) AS largest_path, CAST(max(size_bytes) AS INT) AS largest_size,
  first(relative_path ORDER BY size_bytes, relative_path) AS smallest_path, CAST(min(size_bytes) AS INT) AS smallest_size FROM scan GROUP BY language""")
def _a20(t):
    return a.language_stats(t.scan).selectExpr(
        "language", "file_count", "total_size", "total_lines", "avg_file_size", "avg_lines_per_file", "largest_file.path AS largest_path",
        "largest_file.size AS largest_size", "smallest_file.path AS smallest_path", "smallest_file.size AS smallest_size",
    )


_FACTOR = "CASE language " + " ".join(f"WHEN {q(k)} THEN {int(v * 10)}" for k, v in dims.TIME_MULTIPLIER.items()) + " ELSE 10 END"


@query("a21_estimate_time", "scan", oracle=f"""
SELECT language, CAST(count(*) AS BIGINT) AS files, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(line_count * ({_FACTOR})) AS DOUBLE) / 1e5 AS estimated_seconds
FROM scan GROUP BY ROLLUP (language)""")
def _a21(t):
    return a.estimate_time(t.scan)


@query("a22_scan_report", "scan", oracle="""
SELECT CASE WHEN is_binary THEN 'binary' WHEN size_bytes = 0 THEN 'empty' WHEN size_bytes > 8000 THEN 'large'
  WHEN language IN ('python', 'javascript', 'jsx', 'typescript', 'tsx', 'java', 'cpp', 'c') THEN 'supported' ELSE 'unsupported' END AS category,
  count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM scan GROUP BY 1""")
def _a22(t):
    from codecorpus.operators.routing import route_scan

    counts, _ = a.scan_report(route_scan(t.scan, 8000))
    return counts


@query("a22_scan_errors", "scan", oracle="""
SELECT relative_path, 'Error analyzing ' || relative_path AS error FROM scan WHERE is_binary ORDER BY relative_path LIMIT 10""")
def _a22b(t):
    failed = t.scan.withColumn("category", F.lit("x")).withColumn("error", F.when(F.col("is_binary"), F.concat(F.lit("Error analyzing "), "relative_path")))
    return a.scan_report(failed)[1]


@query("a23_opportunities", "files", oracle=f"""
SELECT count(*) AS total_files, {n(f'{_O} < 50')} AS low_quality, {n(f'{_O} BETWEEN 50 AND 69')} AS medium_quality, {n(f'{_O} < 70')} AS needing_improvement,
  {', '.join(f"{n(f'{SCORE_COLUMNS[k]} < 50')} AS low_{k}, {pct(n(f'{SCORE_COLUMNS[k]} < 50'), 'count(*)', '1e0')} AS low_{k}_share" for k in ('complexity', 'readability', 'maintainability'))}
FROM files WHERE refactored_content <> ''""")
def _a23(t):
    return a.opportunities(t.files)


_RESULTS = "SELECT file_id, language, status <> 'failed' AS success, file_id % 3 <> 0 AS original_valid, file_id % 5 <> 0 AS refactored_valid, CAST(file_id % 4 AS INT) AS n_suggestions, CAST(file_id % 2 AS INT) AS n_applied FROM files"


@query("a24_run_stats", "files", oracle=f"""
SELECT count(*) AS files_processed, {n('NOT success')} AS errors, CAST(sum(n_suggestions) AS BIGINT) AS total_suggestions, CAST(sum(n_applied) AS BIGINT) AS applied_changes,
  CAST({n('success')} AS DOUBLE) / count(*) AS success_rate, CAST(sum(n_suggestions) AS DOUBLE) / count(*) AS avg_suggestions_per_file,
  CAST(sum(n_applied) AS DOUBLE) / count(*) AS avg_applied_per_file FROM ({_RESULTS})""")
def _a24(t):
    return a.run_stats(t.sql(_RESULTS, "files"))


def _log_part(dimension: str, value: str, tail: str) -> str:
    return (f"SELECT {dimension} AS dimension, {value} AS value, count(*) AS entries, round(avg(duration), 6) AS avg_duration, "
            f"max(duration) AS max_duration, min(duration) AS min_duration FROM log_events {tail}")


@query("a25_log_summary", "log_events", oracle=" UNION ALL ".join([
    _log_part("'operation_type'", "operation_type", "GROUP BY operation_type"), _log_part("'level'", "level", "GROUP BY level"), _log_part("'all'", "'all'", "")]))
def _a25(t):
    return a.log_summary(t.log_events).withColumn("avg_duration", F.round("avg_duration", 6))


_REQ = ("SELECT CASE event_id % 3 WHEN 0 THEN 'local' ELSE 'remote' END AS provider, concat('m', user_id % 4) AS model, event_type <> 'error' AS success, "
        "CAST(user_id * 10 AS BIGINT) AS tokens_used, value AS response_time FROM events")


@query("a26_request_stats", oracle=f"""
SELECT provider, model, count(*) AS requests, {n('NOT success')} AS failures, CAST(sum(tokens_used) AS BIGINT) AS tokens, round(avg(response_time), 6) AS avg_response_time
FROM ({_REQ}) GROUP BY 1, 2""")
def _a26(t):
    return a.request_stats(t.sql(_REQ, "events")).withColumn("avg_response_time", F.round("avg_response_time", 6))


@query("a27_trial_summary", "files", oracle=f"""
SELECT language, count(*) AS trials, {n('success')} AS successful, {n('original_valid')} AS valid_before, {n('refactored_valid')} AS valid_after,
  {pct(n('success'), 'count(*)')} AS successful_pct, {pct(n('original_valid'), 'count(*)')} AS valid_before_pct, {pct(n('refactored_valid'), 'count(*)')} AS valid_after_pct
FROM ({_RESULTS}) GROUP BY ROLLUP (language)""")
def _a27(t):
    return a.trial_summary(t.sql(_RESULTS, "files"))


def _pattern_sql() -> str:
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(message), {q(w)})" for w in words) + f" THEN '{k}'" for k, words in dims.ERROR_PATTERNS.items()) + " ELSE 'unknown' END"


@query("a29_error_stats", "error_events", oracle=f"""
WITH e AS (SELECT error_type, {_pattern_sql()} AS pattern FROM error_events),
u AS (SELECT 'total' AS kind, 'all' AS value, count(*) AS errors FROM e UNION ALL SELECT 'error_type', error_type, count(*) FROM e GROUP BY error_type
  UNION ALL SELECT 'pattern', pattern, count(*) FROM e GROUP BY pattern)
SELECT *, kind = 'pattern' AND row_number() OVER (PARTITION BY kind ORDER BY errors DESC, value) = 1 AS is_most_common FROM u""")
def _a29(t):
    return a.error_stats(t.error_events)


# --- top-k ---------------------------------------------------------------------------------------------------------

_BAND = "CASE " + " ".join(f"WHEN overall_quality_score >= {lo} AND overall_quality_score < {hi} THEN {q(name)}" for lo, hi, name in r.EXAMPLE_BANDS) + " END"


@query("w1_band_examples", "files", oracle=f"""
SELECT file_id, band, CAST(rank AS INT) AS rank FROM (SELECT file_id, {_BAND} AS band, row_number() OVER (PARTITION BY {_BAND} ORDER BY overall_quality_score, file_id) AS rank
  FROM files WHERE refactored_content <> '') WHERE rank <= 2 AND band IS NOT NULL""")
def _w1(t):
    return r.band_examples(t.files).select("file_id", "band", "rank")


@query("w2_latest", "files", "sessions", oracle="""
SELECT * FROM (SELECT CAST(file_id AS VARCHAR) AS id FROM files WHERE language = 'Python' ORDER BY created_at DESC, file_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT session_id FROM sessions ORDER BY created_at DESC, session_id LIMIT 5)""")
def _w2(t):
    files = r.latest(t.files.select("file_id", "language", "created_at"), 10, "file_id", "Python").select(F.col("file_id").cast("string").alias("id"))
    return files.unionByName(r.latest(t.sessions, 5, "session_id").select(F.col("session_id").alias("id")))


@query("w3_suspicious", "files", oracle="SELECT file_id, original_path FROM files WHERE language = 'Python' AND complexity_score < 10 ORDER BY created_at DESC, file_id LIMIT 5")
def _w3(t):
    return r.suspicious(t.files).select("file_id", "original_path")


@query("w4_session_failures", "sessions", "files", oracle="""
SELECT session_id, file_id, error_message, CAST(rank AS INT) AS rank FROM (SELECT session_id, file_id, error_message, row_number() OVER (PARTITION BY session_id ORDER BY file_id) AS rank
  FROM files WHERE status = 'failed' AND error_message <> '') WHERE rank <= 5 AND session_id IN (SELECT session_id FROM sessions WHERE status = 'failed')""")
def _w4(t):
    return r.session_failures(t.sessions, t.files)


@query("w5_recent_errors", "error_events", oracle="SELECT event_id, error_type, message FROM error_events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _w5(t):
    return r.recent_errors(t.error_events).select("event_id", "error_type", "message")


_HISTORY = """(SELECT path, hash, author, CAST(row_number() OVER (PARTITION BY path ORDER BY committed_at DESC, hash) AS INT) AS rank
  FROM (SELECT DISTINCT path, hash FROM changes) JOIN commits USING (hash))"""


@query("w6_file_history", "commits", "changes", oracle=f"SELECT path, hash, author, rank FROM {_HISTORY} WHERE rank <= 20")
def _w6(t):
    return r.file_history(t.commits, t.changes).select("path", "hash", "author", "rank")


@query("w6_recent_commits", "commits", oracle="""
SELECT hash, author FROM commits WHERE committed_at >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY ORDER BY committed_at DESC, hash LIMIT 100""")
def _w6b(t):
    return r.recent_commits(t.commits, "1998-06-01 00:00:00").select("hash", "author")


@query("w7_hot_files", "commits", "changes", oracle=f"SELECT path, count(*) AS recent_changes FROM {_HISTORY} WHERE rank <= 5 GROUP BY path HAVING count(*) > 3")
def _w7(t):
    return r.hot_files(t.commits, t.changes)


@query("w8_sample_enhanced", "files", oracle=f"""
SELECT file_id, language, trim(split_part(split_part(error_message, 'Enhanced:', 2), '|', 1)) AS improvements FROM files WHERE {ENH}
ORDER BY {stable_bucket('file_id', 1 << 30, '7')}, file_id LIMIT 5""")
def _w8(t):
    return r.sample_enhanced(t.files, seed=7).select("file_id", "language", "improvements")


_LOGS = "SELECT o_orderkey, concat('logs/', o_orderkey, '.json') AS path, concat('g', o_custkey % 9) AS folder, o_orderdate AS modified FROM orders"


@query("w9_expired_logs", oracle=f"""
SELECT path, folder FROM (SELECT path, folder, row_number() OVER (PARTITION BY folder ORDER BY modified DESC, path) AS rn FROM ({_LOGS})) WHERE rn > 10""")
def _w9(t):
    return r.expired_logs(t.sql(_LOGS, "orders"), by="folder").select("path", "folder")


_IN_PERIOD = "session_id IN (SELECT session_id FROM sessions WHERE created_at BETWEEN TIMESTAMP '2024-01-04 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00')"


@query("s6_accuracy_report", "sessions", "files", oracle=f"""
WITH w AS (SELECT * FROM files WHERE {_IN_PERIOD})
SELECT (SELECT count(*) FROM sessions WHERE {_IN_PERIOD}) AS total_sessions, count(*) AS total_files, {pct(n(SCORED), 'count(*)')} AS true_accuracy, {n(SCORED)} AS files_analyzed,
  {pct(n(_WARN), n(DONE))} AS warning_rate, {pct(n(f"{DONE} AND language = 'Java'"), n("language = 'Java'"))} AS java_success_rate,
  {n(f"{FAIL} AND error_message <> '' AND lower(error_message) LIKE '%syntax%'")} AS syntax_errors FROM w""")
def _s6(t):
    """The written report of a period that leaves out the first three and the last five sessions."""
    from codecorpus.sources.sinks import write_report

    write_report(report(t.sessions, t.files, "2024-01-04", "2024-01-15"), t.folder)
    return t.spark.read.json(t.folder).select(
        "overall_accuracy.total_sessions", "overall_accuracy.total_files", "overall_accuracy.true_accuracy", "quality_metrics.files_analyzed",
        "validation_metrics.warning_rate", F.col("language_metrics.Java.success_rate").alias("java_success_rate"),
        F.coalesce(F.col("error_patterns.syntax_errors.files"), F.lit(0)).alias("syntax_errors"),
    )
