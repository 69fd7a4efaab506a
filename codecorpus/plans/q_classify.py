"""Queries over language detection and name classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions import dims, language as lang
from codecorpus.plans.duck import ascii_words, ext, q, values
from codecorpus.plans.registry import query

# A path per document that covers the special names and many extensions, derived from the id.
_EXTS = [e for e, _ in dims.extension_pairs(dims.DISPLAY_EXTENSIONS)] + [".unknown", ""]
_PATH = (
    "CASE doc_id % 12 WHEN 0 THEN 'tools/Makefile' WHEN 1 THEN 'docker/Dockerfile.dev' WHEN 2 THEN 'conf/.gitignore' WHEN 3 THEN '.bashrc' "
    "WHEN 4 THEN concat('run', doc_id, '.txt') WHEN 5 THEN concat('bin/start', doc_id) ELSE concat('Src/F', doc_id, CASE doc_id % "
    f"{len(_EXTS)} " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTS)) + " END) END"
)
_TEXT = "CASE WHEN doc_id % 12 IN (4, 5) THEN concat('#!/usr/bin/env ', CASE doc_id % 4 WHEN 0 THEN 'python3' WHEN 1 THEN 'node' WHEN 2 THEN 'bash' ELSE 'perl' END, chr(10), text) ELSE text END"


def _paths(t):
    return t.documents.select("doc_id", F.expr(_PATH).alias("path"), F.expr(_TEXT).alias("content"))


_CTE = f"WITH p AS (SELECT doc_id, {_PATH} AS path, {_TEXT} AS content FROM documents)"


@query("c1_language_by_ext", oracle=f"""{_CTE}
SELECT doc_id, v.language FROM p LEFT JOIN {values(dims.extension_pairs(dims.DISPLAY_EXTENSIONS), 'v(e, language)')} ON v.e = {ext('path')}""")
def _c1(t):
    return lang.language_by_ext(_paths(t)).select("doc_id", "language")


def _content_sql(language: str, order: int) -> str:
    hits = " + ".join(
        f"len(regexp_extract_all(w, {q('(?im)' + p.replace('(?<!' + chr(92) + 'w)', ''))}))" for p in dims.CONTENT_PATTERNS[language])
    return f"SELECT file_id, {q(language)} AS language, {hits} AS hits, {order} AS k FROM s"


@query("c2_language_by_content", "code_files", oracle=f"""
WITH s AS (SELECT file_id, {ascii_words("array_to_string(list_slice(string_split(content, chr(10)), 1, 50), chr(10))")} AS w FROM code_files)
SELECT file_id, arg_max(language, hits * 100 - k) FILTER (hits > 0) AS detected FROM ({' UNION ALL '.join(_content_sql(x, i) for i, x in enumerate(dims.CONTENT_PATTERNS))}) GROUP BY file_id""")
def _c2(t):
    return lang.language_by_content(t.code_files.drop("language"), out="detected").select("file_id", "detected")


@query("c3_detect_language")
def _c3(t):
    df = t.code_files.select("file_id", "content", F.expr("concat('a/b', file_id, CASE file_id % 7 WHEN 0 THEN '.h' WHEN 1 THEN '' WHEN 2 THEN '.m' WHEN 3 THEN '.xyz' WHEN 4 THEN '.py' WHEN 5 THEN '.s' ELSE '.js' END)").alias("path"))
    return lang.detect_language(df).select("file_id", "path", "language")


@query("c4_scan_language", oracle=f"""{_CTE}, n AS (SELECT *, regexp_extract(lower(path), '[^/]*$') AS name, {ext('path')} AS ext,
  trim(string_split(content, chr(10))[1]) AS head FROM p)
SELECT doc_id, CASE WHEN v.language IS NOT NULL THEN v.language
  WHEN name IN ('makefile', 'gnumakefile') OR starts_with(name, 'makefile.') THEN 'makefile'
  WHEN name = 'dockerfile' OR starts_with(name, 'dockerfile.') THEN 'dockerfile'
  WHEN name IN ('.gitignore', '.dockerignore') THEN 'gitignore'
  WHEN ext IN ('', '.txt') AND starts_with(head, '#!') AND contains(head, 'python') THEN 'python'
  WHEN ext IN ('', '.txt') AND starts_with(head, '#!') AND (contains(head, 'node') OR contains(head, 'javascript')) THEN 'javascript'
  WHEN ext IN ('', '.txt') AND starts_with(head, '#!') AND contains(head, 'sh') THEN 'shell' ELSE 'unknown' END AS language
FROM n LEFT JOIN {values(dims.extension_pairs(dims.SCAN_EXTENSIONS), 'v(e, language)')} ON v.e = n.ext""")
def _c4(t):
    return lang.scan_language(_paths(t)).select("doc_id", "language")


@query("c5_adapter_language", oracle=f"""{_CTE}
SELECT doc_id, CASE WHEN v.a IS NOT NULL THEN v.a WHEN contains(content, 'def ') AND contains(content, 'import ') THEN 'python'
  WHEN contains(content, 'function ') OR contains(content, 'const ') OR contains(content, 'let ') THEN 'javascript'
  WHEN contains(content, 'public class ') OR contains(content, 'private ') THEN 'java'
  WHEN contains(content, '#include') OR contains(content, 'std::') THEN 'cpp' END AS adapter
FROM p LEFT JOIN {values(dims.extension_pairs(dims.ADAPTER_EXTENSIONS), 'v(e, a)')} ON v.e = {ext('path')}""")
def _c5(t):
    return lang.adapter_language(_paths(t)).select("doc_id", "adapter")


@query("c6_jsx_override", "files", oracle="""
SELECT file_id, CASE WHEN language = 'JavaScript' AND (contains(lower(original_path), '.jsx') OR contains(lower(substr(original_content, 1, 1000)), 'es'))
  THEN 'JSX' ELSE language END AS language FROM (SELECT file_id, language, original_path, replace(original_content, 'jsx', 'es') AS original_content FROM files)""")
def _c6(t):
    files = t.files.select("file_id", "language", "original_path", F.regexp_replace("original_content", "es|ES|Es|eS", "jsx").alias("c"))
    return lang.jsx_override(files, "original_path", "c").select("file_id", "language")


@query("c7_prompt_language", "files", oracle=f"""
SELECT file_id, CASE language {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in dims.PROMPT_NAMES.items())} ELSE language END AS prompt_language FROM files""")
def _c7(t):
    return t.files.select("file_id", lang.prompt_language(F.col("language")).alias("prompt_language"))


# UTF-16 text (every 8th) holds NUL bytes; otherwise the share of printable bytes decides, of the text without its ASCII
# letters in every 5th document.
_BYTES = "CASE WHEN doc_id % 5 = 0 THEN regexp_replace(text, '[a-zA-Z0-9 ]', '') ELSE text END"


@query("c8_is_binary", oracle=f"""
SELECT doc_id, doc_id % 9 = 0 OR doc_id % 8 = 0 AND len(text) > 0 OR (len(h) > 0 AND CAST(len(list_filter(h, lambda b: b IN ('09', '0A', '0D') OR b >= '20' AND b <= '7E')) AS DOUBLE) / len(h) < 7e-1) AS is_binary
FROM (SELECT doc_id, text, regexp_extract_all(substr(hex(encode({_BYTES.replace("'')", "'', 'g')")})), 1, 2048), '..') AS h FROM documents)""")
def _c8(t):
    raw = t.documents.select("doc_id", F.concat(F.lit("f"), "doc_id", F.expr("CASE WHEN doc_id % 9 = 0 THEN '.png' ELSE '.txt' END")).alias("path"),
                             F.when(F.col("doc_id") % 8 == 0, F.encode("text", "UTF-16BE")).otherwise(F.encode(F.expr(_BYTES), "UTF-8")).alias("content"))
    return lang.is_binary(raw).select("doc_id", "is_binary")


# Names derived from the parts table: spaces become underscores, dashes, or a capital letter.
_NAME = (
    "CASE p_partkey % 5 WHEN 0 THEN replace(lower(p_name), ' ', '_') WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN replace(p_name, ' ', '-') "
    "WHEN 3 THEN concat(lower(substr(p_name, 1, 1)), replace(p_type, ' ', '')) ELSE concat(upper(replace(p_name, ' ', '_')), '!') END"
)
_LANG = "CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'cpp' END"


@query("c9_valid_name", oracle=rf"""
SELECT p_partkey, name, regexp_matches(replace(replace(name, '_', ''), '-', ''), '^[\p{{L}}\p{{N}}]+$') AND CASE language
    WHEN 'python' THEN (name = lower(name) AND name <> upper(name)) OR contains(name, '_')
    WHEN 'java' THEN substr(name, 1, 1) = lower(substr(name, 1, 1)) AND substr(name, 1, 1) <> upper(substr(name, 1, 1)) AND NOT contains(name, '_')
    ELSE true END AS valid
FROM (SELECT p_partkey, {_NAME} AS name, {_LANG} AS language FROM part)""")
def _c9(t):
    df = t.part.select("p_partkey", F.expr(_NAME).alias("name"), F.expr(_LANG).alias("language"))
    return df.select("p_partkey", "name", lang.valid_name(F.col("name"), F.col("language")).alias("valid"))


@query("c10_naming_style", oracle=f"""
SELECT p_partkey, name, CASE WHEN contains(name, '_') AND name = lower(name) THEN 'snake'
  WHEN NOT contains(name, '_') AND substr(name, 2) <> lower(substr(name, 2)) THEN 'camel' ELSE 'other' END AS style
FROM (SELECT p_partkey, {_NAME} AS name FROM part)""")
def _c10(t):
    df = t.part.select("p_partkey", F.expr(_NAME).alias("name"))
    return df.select("p_partkey", "name", lang.naming_style(F.col("name")).alias("style"))
