"""Queries over sources and sinks: each writes a folder in the shared work area from the given tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.operators import accuracy
from codecorpus.plans.q_pairs import pairs
from codecorpus.plans.registry import query
from codecorpus.sources import corpus, sinks, tables


def text_tree(t) -> str:
    """Every document as a text file of its own, one folder per language (the writer ends a file with a line feed)."""
    sinks.write_tree(t.documents, "text", "lang", t.folder)
    return t.folder


@query("s1_scan_corpus", oracle="""
SELECT 'lang=' || lang AS folder, '.txt' AS extension, strlen(text) + 1 AS size_bytes, md5(text || chr(10)) AS content_md5 FROM documents""")
def _s1(t):
    out = corpus.scan_corpus(t.spark, text_tree(t), pattern="*.txt")
    return out.select(F.regexp_extract("relative_path", "^([^/]*)", 1).alias("folder"), "extension", "size_bytes", F.md5("raw").alias("content_md5"))


@query("s1_scanned_languages")
def _s1b(t):
    out = corpus.scanned(corpus.scan_corpus(t.spark, text_tree(t), pattern="*.txt"))
    return out.groupBy("language", "is_binary").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))


@query("s2_decode_text", oracle="SELECT doc_id, md5(text) AS text_hash FROM documents")
def _s2(t):
    raw = F.expr("CASE doc_id % 3 WHEN 0 THEN encode(text, 'UTF-8') WHEN 1 THEN encode(text, 'UTF-16') ELSE encode(text, 'UTF-8') END")
    return corpus.decode_text(t.documents.select("doc_id", raw.alias("raw"))).select("doc_id", F.md5("content").alias("text_hash"))


@query("s3_read_sessions", "sessions", oracle="""
SELECT session_id, status, processing_mode, 'comprehensive' AS refactor_type, true AS preserve_comments, false AS follow_conventions, total_files, '' AS error_message FROM sessions""")
def _s3(t):
    """Sessions of an older schema version get the defaults of the later columns."""
    t.sessions.select("session_id", "original_filename", "created_at", "status", "processing_mode", "total_files", "processed_files").write.parquet(t.folder)
    return tables.read_sessions(t.spark, t.folder).select(
        "session_id", "status", "processing_mode", "refactor_type", "preserve_comments", "follow_conventions", "total_files", "error_message")


@query("s3_read_files", "files", oracle="""
SELECT file_id, session_id, language, status, CASE WHEN file_id % 2 = 0 THEN complexity_score ELSE 0 END AS complexity_score, CASE WHEN file_id % 2 = 0 THEN refactored_content ELSE '' END AS refactored_content FROM files""")
def _s3b(t):
    """Two schema versions in one folder, merged on read."""
    old = ["file_id", "session_id", "original_path", "language", "original_content", "status", "created_at"]
    t.files.filter("file_id % 2 = 1").select(*old).write.parquet(f"{t.folder}/v=1")
    t.files.filter("file_id % 2 = 0").write.parquet(f"{t.folder}/v=2")
    return tables.read_files(t.spark, t.folder).select("file_id", "session_id", "language", "status", "complexity_score", "refactored_content")


@query("s5_read_log_exports", "log_events", oracle="""
SELECT session_id, operation_type, level, count(*) AS entries FROM log_events GROUP BY ALL""")
def _s5(t):
    """Log documents of one session chunk each, exported as JSON and exploded again."""
    entry = F.struct(F.unix_micros("ts").cast("double").alias("timestamp"), "level", "operation_type", F.lit("m").alias("message"), "file_path")
    chunk = (F.col("event_id") / 500).cast("int")
    docs = t.log_events.groupBy("session_id", chunk.alias("chunk")).agg(F.collect_list(entry).alias("log_entries"))
    docs.select(F.struct("session_id", F.size("log_entries").alias("total_log_entries")).alias("session_summary"), "log_entries").write.json(t.folder)
    lines = tables.read_log_exports(t.spark, t.folder)
    return lines.groupBy("session_id", "operation_type", "level").agg(F.count("*").alias("entries"))


@query("s7_write_results", "files", oracle="SELECT file_id, language, status, overall_quality_score FROM files")
def _s7(t):
    sinks.write_results(t.files.select("file_id", "language", "status", "overall_quality_score"), t.folder)
    return t.spark.read.parquet(t.folder)


@query("s7_run_statistics", "files", oracle="SELECT count(*) AS files_processed, count(*) FILTER (status = 'failed') AS errors FROM files")
def _s7b(t):
    sinks.write_results(t.files.select("file_id", "language", "status"), t.folder)
    back = t.spark.read.parquet(t.folder).select((F.col("status") != "failed").alias("success"), F.lit(0).alias("n_suggestions"), F.lit(0).alias("n_applied"))
    return accuracy.run_stats(back).select("files_processed", "errors")


@query("s8_export_corpus", "sessions", "files", oracle="""
SELECT session_id, original_path AS path, md5(CASE WHEN refactored_content <> '' THEN refactored_content ELSE original_content END) AS content_hash FROM files
WHERE session_id IN (SELECT session_id FROM sessions WHERE status = 'completed')""")
def _s8(t):
    sinks.export_corpus(t.files, t.folder, t.sessions)
    return t.spark.read.parquet(t.folder).select("session_id", "path", F.md5("content").alias("content_hash"))


@query("s9_write_dataset")
def _s9(t):
    sinks.write_dataset(pairs(t), t.folder)
    meta = t.spark.read.json(f"{t.folder}/metadata")
    examples = t.spark.read.schema("id bigint").json(f"{t.folder}/examples").agg(F.count("*").alias("examples"))
    return accuracy.one_row(meta, examples).select("total_examples", "examples", F.array_join("languages", ",").alias("languages"), F.array_join("patterns", ",").alias("patterns"))


