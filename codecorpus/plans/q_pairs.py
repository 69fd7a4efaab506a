"""Queries over example pairs and request tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.operators import accuracy
from codecorpus.operators import pairs as p
from codecorpus.operators.nesting import nested_if_delta, nested_if_summary
from codecorpus.plans.duck import q, stable_bucket
from codecorpus.plans.q_responses import responses
from codecorpus.plans.registry import query


def pairs(t):
    """One pair per document id."""
    return p.synth_pairs(t.documents.select("doc_id"), "doc_id", seed=1)


def _list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


PARAMS = f"""SELECT doc_id AS id, {_list(dims.PAIR_LANGUAGES)}[doc_id % 4 + 1] AS language, {_list(dims.PAIR_PATTERNS)}[{stable_bucket('doc_id', 5, '1-pattern')} + 1] AS pattern,
  {stable_bucket('doc_id', 6, '1-depth')} + 3 AS depth, {_list(dims.PAIR_NAMES)}[{stable_bucket('doc_id', 16, '1-name')} + 1] AS name FROM documents"""


def _per(f) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {f(v)}" for k, v in p.FORMULAS.items()) + " END"


METRICS = f"""SELECT *, {_per(lambda v: f"depth * {v['c']}")} AS complexity_before, {_per(lambda v: f"depth * {v['l']} + {v['lo']}")} AS lines_before,
  {_per(lambda v: f"greatest(1, depth - {v['drop']})")} AS depth_after, {_per(lambda v: f"greatest({v['floor']}, depth * {v['ca']})")} AS complexity_after,
  {_per(lambda v: f"depth * {v['la']} + {v['lao']}")} AS lines_after, {_per(lambda v: f"depth * {v['red']}")} AS complexity_reduction, {_per(lambda v: f"least({v['drop']}, depth - 1)")} AS depth_reduction
FROM ({PARAMS})"""


def _nested_sql(language: str) -> str:
    """The nested text of a language rebuilt with list functions."""
    head, level, middle, back, foot = p.NESTED[language]
    unit = "  " if language == "javascript" else "    "
    family = "java" if language == "csharp" else language

    def fill(text: str, extra: dict[str, str]) -> str:
        slots = {"{v}": "name", "{V}": "upper(name[1]) || name[2:]", "{t}": q(unit), "{D}": f"repeat({q(unit)}, depth + 1)"} | extra
        sql = q(text)
        for slot, value in slots.items():
            if slot in text:
                sql = f"replace({sql}, {q(slot)}, CAST({value} AS VARCHAR))"
        return sql

    numbers = {"{i}": "i", "{a}": "i * 10", "{b}": "100 - i * 5", "{c}": "i * 15", "{e}": "90 - i * 3", "{m}": "i + 2"}
    cond = "CASE i % 5 " + " ".join(f"WHEN {k} THEN {fill(c, numbers)}" for k, c in enumerate(p.CONDITIONS[family])) + " END"
    slots = numbers | {"{q}": cond, "{n}": f"repeat({q(unit)}, i + 1)", "{N}": f"repeat({q(unit)}, i + 2)"}
    up, down = "range(0, depth)", "list_reverse(range(0, depth))"
    each = lambda text, order: f"array_to_string(list_transform({order}, lambda i: {fill(text, slots)}), '')"
    return f"rtrim({fill(head, {})} || {each(level, up)} || {fill(middle, {})} || {each(back, down)} || {fill(foot, {})}, chr(10))"




@query("g1_synth_pairs", oracle="SELECT id, language, pattern, CAST(depth AS INT) AS depth, md5(CASE language " + " ".join(
    f"WHEN '{k}' THEN {_nested_sql(k)}" for k in p.NESTED) + f" END) AS original_hash FROM ({PARAMS})")
def _g1(t):
    return pairs(t).select("id", "language", "pattern", "depth", F.md5("original_code").alias("original_hash"))


@query("g1_refactored_text")
def _g1b(t):
    return pairs(t).select("id", "language", "pattern", F.md5("refactored_code").alias("refactored_hash"), F.length("refactored_code").alias("n_chars"))


@query("g2_pair_metrics", oracle=f"SELECT * EXCLUDE (name, pattern) FROM ({METRICS})")
def _g2(t):
    out = p.with_metrics(p.pair_parameters(t.documents.select("doc_id"), "doc_id", seed=1))
    return out.select(
        "id", "language", "depth", F.col("metrics_before.complexity").alias("complexity_before"), F.col("metrics_before.lines").alias("lines_before"),
        F.col("metrics_after.depth").alias("depth_after"), F.col("metrics_after.complexity").alias("complexity_after"),
        F.col("metrics_after.lines").alias("lines_after"), "complexity_reduction", "depth_reduction",
    )


_TEXTS = ("SELECT doc_id AS id, {language} AS language, 'guard_clauses' AS pattern, text AS original_code, replace(text, 'e', 'E') AS refactored_code, concat('About ', doc_id) AS description, "
          "CAST(doc_id % 9 AS INT) AS complexity_reduction, CAST(doc_id % 3 AS INT) AS depth_reduction FROM documents").format(language="CASE doc_id % 2 WHEN 0 THEN 'python' ELSE 'java' END")


def _sql_concat(*parts: str) -> str:
    """Parts starting with ``=`` are SQL, others literal text whose newlines become chr(10)."""
    out = []
    for part in parts:
        out.append(part[1:] if part.startswith("=") else " || chr(10) || ".join(q(x) for x in part.split("\n")))
    return " || ".join(out)


_INSTRUCTION = _sql_concat(
    "### Instruction:\nRefactor the following ", "=language", " code to reduce nested if statements using the ", "=pattern",
    " pattern. The goal is to improve readability and reduce complexity.\n\n### Input Code:\n```", "=language", "\n", "=original_code",
    "\n```\n\n### Expected Output:\n```", "=language", "\n", "=refactored_code", "\n```\n\n### Explanation:\n", "=description",
    "\nComplexity reduction: ", "=complexity_reduction", "\nDepth reduction: ", "=depth_reduction", "\n")
_SIMPLE = _sql_concat("// Original nested code:\n", "=original_code", "\n\n// Refactored using ", "=pattern", ":\n", "=refactored_code")
_EVAL = _sql_concat("### Instruction:\nRefactor the following ", "=language", " code to reduce nested if statements.\n\n### Input Code:\n```", "=language", "\n",
                    "=original_code", "\n```\n\n### Refactored Code:\n```", "=language", "\n")


@query("g3_render_prompts", oracle=" UNION ALL ".join(
    f"SELECT id, '{k}' AS style, md5({v}) AS prompt_hash FROM ({_TEXTS})" for k, v in (("instruction", _INSTRUCTION), ("simple", _SIMPLE), ("eval", _EVAL))))
def _g3(t):
    rows = t.sql(_TEXTS, "documents")
    parts = [p.render_prompts(rows, s).select("id", F.lit(s).alias("style"), F.md5("prompt").alias("prompt_hash")) for s in ("instruction", "simple", "eval")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("g4_split_pairs", oracle=f"SELECT doc_id AS id, CASE WHEN {stable_bucket('doc_id', 10000, '42')} < 2000 THEN 'eval' ELSE 'train' END AS split FROM documents")
def _g4(t):
    return p.split_pairs(t.documents.select(F.col("doc_id").alias("id")))


@query("g5_evaluate_pairs")
def _g5(t):
    rows = pairs(t)
    # Generated text: the expected one, the original, or the expected one with its second line doubled.
    generated = F.expr("CASE id % 3 WHEN 0 THEN refactored_code WHEN 1 THEN original_code ELSE concat(refactored_code, chr(10), 'done') END")
    return p.evaluate_pairs(rows, rows.select("id", generated.alias("generated")))


_FOCUS = "CASE refactor_type " + " ".join(f"WHEN {q(k)} THEN {_sql_concat(v)}" for k, v in p.PROMPT_FOCUS.items() if k) + f" ELSE {_sql_concat(p.PROMPT_FOCUS[''])} END"


def _either(flag: str, texts) -> str:
    return f"(CASE WHEN {flag} THEN {_sql_concat(texts[0])} ELSE {_sql_concat(texts[1])} END)"


@query("g6_refactor_requests", "sessions", "files", oracle=f"""
SELECT file_id, md5({_sql_concat(p.PROMPT_HEAD)} || ({_FOCUS}) || {_either('preserve_comments', p.PROMPT_COMMENTS)} || {_either('add_documentation', p.PROMPT_DOCS)}
  || (CASE WHEN follow_conventions THEN {_sql_concat(p.PROMPT_STYLE[0].split('{}')[0])} || language || {_sql_concat(p.PROMPT_STYLE[0].split('{}')[1])} ELSE {_sql_concat(p.PROMPT_STYLE[1])} END)
  || {_sql_concat(p.PROMPT_TAIL)}) AS system_hash, md5(original_content) AS user_hash FROM files JOIN sessions USING (session_id)""")
def _g6(t):
    return p.refactor_requests(t.sessions, t.files).select("file_id", F.md5("system_prompt").alias("system_hash"), F.md5("user_prompt").alias("user_hash"))


@query("g7_correction_requests")
def _g7(t):
    rows = responses(t).withColumn("round", (F.col("file_id") % 4).cast("int") + F.when(F.col("file_id") % 28 == 0, 0).otherwise(1))
    originals = t.code_files.select("file_id", F.col("content").alias("original_content"))
    return p.correction_requests(rows, originals).select("file_id", "round", "error", F.md5("user_prompt").alias("user_hash"))


@query("n7_nested_if_delta")
def _n7(t):
    return nested_if_summary(nested_if_delta(pairs(t)), "language", "pattern")


@query("a28_dataset_stats", oracle=f"""
WITH m AS (SELECT * FROM ({METRICS}))
SELECT language, pattern, count(*) AS examples, avg(complexity_reduction) AS avg_complexity_reduction, avg(depth_reduction) AS avg_depth_reduction FROM m GROUP BY GROUPING SETS ((language), (pattern), ())""")
def _a28(t):
    return accuracy.dataset_stats(p.with_metrics(p.pair_parameters(t.documents.select("doc_id"), "doc_id", seed=1)))
