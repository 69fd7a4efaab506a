"""Queries over error messages and model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions import dims, responses as x
from codecorpus.plans.duck import has_any, q
from codecorpus.plans.registry import query


def _case(cases, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


PATTERN = _case([(has_any("lower(message)", w), q(k)) for k, w in dims.ERROR_PATTERNS.items()], "'unknown'")


@query("t1_error_pattern", "error_events", oracle=f"SELECT event_id, {PATTERN} AS pattern FROM error_events")
def _t1(t):
    return t.error_events.select("event_id", x.error_pattern(F.col("message")).alias("pattern"))


@query("t2_messages", "error_events", oracle=f"""
SELECT event_id, {_case([(f"pattern = {q(k)}", q(v)) for k, v in dims.FRIENDLY_MESSAGES.items()], q(dims.FRIENDLY_MESSAGES['unknown']))} AS friendly,
  {_case([(has_any('lower(message)', w), q(v)) for w, v in dims.SESSION_MESSAGES], q(dims.SESSION_DEFAULT))} AS session_text,
  {_case([(has_any('lower(message)', w), q('|'.join(v))) for w, v in dims.HINTS], q('|'.join(dims.HINTS_DEFAULT)))} AS hints
FROM (SELECT *, {PATTERN} AS pattern FROM error_events)""")
def _t2(t):
    m = F.col("message")
    return t.error_events.select(
        "event_id", x.friendly_message(x.error_pattern(m)).alias("friendly"), x.session_message(m).alias("session_text"), F.array_join(x.hints(m), "|").alias("hints")
    )


# Responses around the derived sources: fenced, with instruction tags, in prose, or corrupt, by id.
RESPONSES = """
SELECT file_id, language, CASE (file_id % 20) / 4 - (file_id % 4) / 20e0 WHEN 0 THEN concat('Here is the code:', chr(10), '```', language, chr(10), content, chr(10), '```', chr(10), 'Done.')
  WHEN 1 THEN concat('[INST] rewrite this', chr(10), 'please [/INST]', content, chr(10), 'Note: all good')
  WHEN 2 THEN concat('The result follows.', chr(10), content, chr(10), 'This keeps behaviour.')
  WHEN 3 THEN concat(chr(34), chr(10), '```', chr(10), 'nothing here -->', chr(10), 'sorry') ELSE concat('<<SYS>>be brief<</SYS>>', content) END AS content FROM code_files
"""
RESPONSES = RESPONSES.replace("(file_id % 20) / 4 - (file_id % 4) / 20e0", "CAST(floor((file_id % 20) / 4) AS INT)")


def responses(t):
    return t.sql(RESPONSES, "code_files")


@query("t3_clean_response")
def _t3(t):
    return x.clean_response(responses(t)).select("file_id", F.md5("code").alias("code_hash"), F.length("code").alias("code_length"))


_MARK = {k: v.replace(r"\w", r"[\p{L}\p{N}_]") for k, v in x.CODE_MARKS.items()}


@query("t4_looks_like_code", "code_files", oracle=rf"""
SELECT file_id, regexp_matches(content, '\S') AND {_case([(f"language = '{k}'", f"regexp_matches(content, {q(v)})") for k, v in _MARK.items()], 'true')} AS code
FROM ({RESPONSES})""")
def _t4(t):
    return responses(t).select("file_id", x.looks_like_code(F.col("content"), F.col("language")).alias("code"))


@query("t5_trim_trailing_prose", "code_files", oracle=rf"""
SELECT file_id, md5(trim(array_to_string(list_slice(l, 1, coalesce(list_max(list_transform(l, lambda s, i: CASE WHEN regexp_matches(s, '\S') AND NOT starts_with(trim(s), '#')
  AND NOT starts_with(trim(s), 'Note:') AND NOT starts_with(trim(s), 'This') THEN i END)), len(l))), chr(10)), ' ' || chr(10))) AS code_hash
FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM ({RESPONSES}))""")
def _t5(t):
    return responses(t).select("file_id", F.md5(x.trim_trailing_prose(F.col("content"))).alias("code_hash"))


_JSON = """
SELECT doc_id AS file_id, CASE doc_id % 5 WHEN 0 THEN 'no json here' WHEN 1 THEN concat('x {"renames": [{"old_name": "a', doc_id, '"') ELSE
  concat('Sure: {"renames": [{"old_name": "a', doc_id, '", "new_name": "b"}, {"old_name": "c", "new_name": "d', doc_id, '", "reason": "r", "confidence": 0.9}, {"old_name": "x"}], "transformations": [{"transformation_type": "t", "confidence": 0.5, "safety_level": "safe"}]} end') END AS content FROM documents
"""


@query("t6_parse_suggestions", oracle="""
SELECT file_id, old_name, new_name, reason, confidence FROM (
  SELECT doc_id AS file_id, 'a' || doc_id AS old_name, 'b' AS new_name, 'Improved naming' AS reason, 7e-1 AS confidence FROM documents WHERE doc_id % 5 >= 2
  UNION ALL SELECT doc_id, 'c', 'd' || doc_id, 'r', 9e-1 FROM documents WHERE doc_id % 5 >= 2)""")
def _t6(t):
    return x.parse_suggestions(t.sql(_JSON, "documents")).select("file_id", F.inline("suggestions.renames"))


@query("t7_clean_fix_response")
def _t7(t):
    return x.clean_fix_response(responses(t)).select("file_id", F.md5("code").alias("code_hash"), F.length("code").alias("code_length"))
