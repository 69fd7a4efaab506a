"""Before/after example pairs: generation from ids, prompt text, stable splits, evaluation and correction rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.functions.patterns import first_match, stable_bucket
from codecorpus.functions.responses import clean_response
from codecorpus.operators.compare import multiset_changes, positional_changes
from codecorpus.functions.patterns import line_total
from codecorpus.operators.nesting import nested_if_delta
from codecorpus.operators.pyfacts import error_message, facts_column

# --- fixed values: conditions by level modulo 5 --------------------------------------------------------------------
# {v} variable, {i} level, {a} 10*level, {b} 100-5*level, {c} 15*level, {e} 90-3*level, {m} level+2
CONDITIONS = {
    "python": ["{v} is not None", "{v} > {a}", "{v} < {b}", "len(str({v})) > {i}", "{v} % {m} == 0"],
    "javascript": ["{v} != null", "{v} > {a}", "{v} < {b}", "{v}.toString().length > {i}", "{v} % {m} === 0"],
    "java": ["{v} > {a}", "{v} < {b}", "{v} >= {c}", "{v} <= {e}", "{v} % {m} == 0"],
}
# --- fixed values: text layouts ------------------------------------------------------------------------------------
# head, one line block per level, middle, one block per level in reverse, foot. {t} one indent, {n} level+1 indents,
# {N} level+2 indents, {D} depth+1 indents, {q} condition, {V} capitalised variable.
NESTED = {
    "python": ("def process_{v}({v}):\n", "{n}if {q}:\n", "{D}return 'success'\n", "{n}else:\n{N}return 'failed_at_level_{i}'\n", ""),
    "java": ("public String process{V}(int {v}) {\n", "{n}if ({q}) {\n", '{D}return "success";\n',
             '{n}} else {\n{N}return "failed_at_level_{i}";\n{n}}\n', "}\n"),
    "javascript": ("function process{V}({v}) {\n", "{n}if ({q}) {\n", "{D}return 'success';\n",
                   "{n}} else {\n{N}return 'failed_at_level_{i}';\n{n}}\n", "}\n"),
    "csharp": ("public string Process{V}(int {v})\n{\n", "{n}if ({q})\n{n}{\n", '{D}return "success";\n',
               '{n}}\n{n}else\n{n}{\n{N}return "failed_at_level_{i}";\n{n}}\n', "}\n"),
}
FLAT = {
    "python_guard": ("def process_{v}({v}):\n", "{t}if not ({q}):\n{t}{t}return 'failed_at_level_{i}'\n\n",
                     "{t}# Main processing logic\n{t}return 'success'\n", "", ""),
    "python_early": ("def process_{v}({v}):\n", "{t}if not {q}:\n{t}{t}return 'failed_at_level_{i}'\n", "{t}return 'success'\n", "", ""),
    "java_guard": ("public String process{V}(int {v}) {\n", '{t}if (!({q})) {\n{t}{t}return "failed_at_level_{i}";\n{t}}\n\n',
                   '{t}return "success";\n}\n', "", ""),
    "java_early": ("public String process{V}(int {v}) {\n", '{t}if (!({q})) {\n{t}{t}return "failed_at_level_{i}";\n{t}}\n',
                   '{t}return "success";\n}\n', "", ""),
    "javascript": ("function process{V}({v}) {\n", "{t}if (!({q})) {\n{t}{t}return 'failed_at_level_{i}';\n{t}}\n",
                   "{t}return 'success';\n}\n", "", ""),
    "csharp": ("public string Process{V}(int {v})\n{\n", '{t}if (!({q}))\n{t}{\n{t}{t}return "failed_at_level_{i}";\n{t}}\n\n',
               '{t}return "success";\n}\n', "", ""),
    "python_extract": [
        ("", "def validate_level_{i}({v}):\n{t}return {q}\n\n", "", "", ""),
        ("def process_{v}({v}):\n", "{t}if not validate_level_{i}({v}):\n{t}{t}return 'failed_at_level_{i}'\n", "{t}return 'success'\n", "", ""),
    ],
    "java_strategy": [
        ("interface ValidationStrategy {\n{t}boolean validate(int {v});\n{t}String getErrorMessage();\n}\n\n",
         "class Level{i}Validator implements ValidationStrategy {\n{t}public boolean validate(int {v}) {\n{t}{t}return {q};\n{t}}\n"
         '{t}public String getErrorMessage() {\n{t}{t}return "failed_at_level_{i}";\n{t}}\n}\n\n', "", "", ""),
        ("public String process{V}(int {v}) {\n{t}ValidationStrategy[] validators = {\n", "{t}{t}new Level{i}Validator(),\n",
         "{t}};\n\n{t}for (ValidationStrategy validator : validators) {\n{t}{t}if (!validator.validate({v})) {\n"
         '{t}{t}{t}return validator.getErrorMessage();\n{t}{t}}\n{t}}\n\n{t}return "success";\n}\n', "", ""),
    ],
}
# --- fixed values: metric formulas per language --------------------------------------------------------------------
# complexity and line factors before, (depth drop, complexity floor, line factor and offset) after, complexity reduction factor
FORMULAS = {
    "python": dict(c=10, l=3, lo=5, drop=2, floor=10, ca=8, la=2, lao=8, red=2),
    "java": dict(c=12, l=4, lo=8, drop=3, floor=15, ca=8, la=3, lao=12, red=4),
    "javascript": dict(c=11, l=3, lo=6, drop=2, floor=12, ca=7, la=2, lao=10, red=4),
    "csharp": dict(c=12, l=4, lo=8, drop=2, floor=15, ca=8, la=3, lao=10, red=4),
}


_NO_PART = ("", "", "", "", "")


def _parts(layout) -> list[tuple]:
    """First and second part of a layout; most have a single part."""
    return layout if isinstance(layout, list) else [_NO_PART, layout]


def _layout(cases: list[tuple[Column, tuple]]) -> Column:
    """Struct of the five texts of the layout chosen by the first true condition (the last case is the default)."""
    made = [(c, F.struct(*[F.lit(x).alias(f) for f, x in zip(("head", "level", "middle", "back", "foot"), texts)])) for c, texts in cases]
    return first_match(made[:-1], made[-1][1])


# --- fixed values: number slots of a level -------------------------------------------------------------------------
_SLOTS = {"i": "i", "a": "i * 10", "b": "100 - i * 5", "c": "i * 15", "e": "90 - i * 3", "m": "i + 2"}


def _block(template: str, order: str) -> str:
    """SQL: the template once per level, with condition, numbers and indents filled in."""
    text = f"replace({template}, '{{q}}', conditions[i % 5])"
    for slot, value in _SLOTS.items():
        text = f"replace({text}, '{{{slot}}}', string({value}))"
    text = f"replace(replace({text}, '{{n}}', repeat(unit, i + 1)), '{{N}}', repeat(unit, i + 2))"
    return f"array_join(transform({order}, i -> {text}), '')"


def _text(layout: str) -> str:
    """SQL: one layout struct as text."""
    up, down = "sequence(0, depth - 1)", "sequence(depth - 1, 0)"
    return f"concat({layout}.head, {_block(layout + '.level', up)}, {layout}.middle, {_block(layout + '.back', down)}, {layout}.foot)"


def _named(text: str) -> Column:
    """Fill the slots of the whole text and drop the final newline."""
    filled = f"replace(replace(replace(replace({text}, '{{v}}', name), '{{V}}', initcap(name)), '{{t}}', unit), '{{D}}', repeat(unit, depth + 1))"
    return F.regexp_replace(F.expr(filled), r"\n\z", "")


def pair_parameters(ids: DataFrame, id_col: str = "id", seed: int = 0) -> DataFrame:
    """(id, language, pattern, depth, name): languages in equal shares by id, the rest by seeded hash."""
    key = F.col(id_col)

    def choice(values: list[str], salt: str) -> Column:
        pick = stable_bucket(key, len(values), f"{seed}-{salt}")
        return F.get(F.array(*map(F.lit, values)), pick)

    return ids.select(
        key.cast("long").alias("id"),
        F.get(F.array(*map(F.lit, dims.PAIR_LANGUAGES)), F.pmod(key, F.lit(4)).cast("int")).alias("language"),
        choice(dims.PAIR_PATTERNS, "pattern").alias("pattern"),
        (stable_bucket(key, 6, f"{seed}-depth") + 3).alias("depth"),
        choice(dims.PAIR_NAMES, "name").alias("name"),
    )


def with_metrics(params: DataFrame) -> DataFrame:
    """Annotated metrics before and after and the reductions, from language and depth."""
    d, lang = F.col("depth"), F.col("language")

    def per(f) -> Column:
        return first_match([(lang == k, f(v).cast("int")) for k, v in FORMULAS.items()], F.lit(None).cast("int"))

    before = F.struct(d.alias("depth"), per(lambda v: d * v["c"]).alias("complexity"), per(lambda v: d * v["l"] + v["lo"]).alias("lines"))
    after = F.struct(
        per(lambda v: F.greatest(F.lit(1), d - v["drop"])).alias("depth"), per(lambda v: F.greatest(F.lit(v["floor"]), d * v["ca"])).alias("complexity"),
        per(lambda v: d * v["la"] + v["lao"]).alias("lines"),
    )
    return params.withColumns(
        {
            "metrics_before": before, "metrics_after": after, "complexity_reduction": per(lambda v: d * v["red"]),
            "depth_reduction": per(lambda v: F.least(F.lit(v["drop"]), d - 1)),
            "description": F.concat(F.lit("Refactor "), d.cast("string"), F.lit("-level nested if using "), "pattern"),
        }
    )


def synth_pairs(ids: DataFrame, id_col: str = "id", seed: int = 0) -> DataFrame:
    """One before/after pair per input id; each row is built on its own, so the work splits like the input.

    Language and pattern choose a layout (a few texts with slots); one expression then fills any layout.
    """
    rows = with_metrics(pair_parameters(ids, id_col, seed))
    lang, pattern = F.col("language"), F.col("pattern")
    flat = [
        ((lang == "python") & (pattern == "early_return"), "python_early"), ((lang == "python") & (pattern == "method_extraction"), "python_extract"),
        (lang == "python", "python_guard"), ((lang == "java") & (pattern == "guard_clauses"), "java_guard"),
        ((lang == "java") & (pattern == "strategy_pattern"), "java_strategy"), (lang == "java", "java_early"), (lang == "javascript", "javascript"),
        (F.lit(True), "csharp"),
    ]
    family = F.when(lang == "csharp", "java").otherwise(lang)
    keep = rows.columns
    rows = rows.withColumns(
        {
            "unit": F.when(lang == "javascript", "  ").otherwise("    "),
            "conditions": first_match([(family == k, F.array(*map(F.lit, v))) for k, v in CONDITIONS.items()], F.array(*map(F.lit, CONDITIONS["java"]))),
            "nested": _layout([(lang == k, v) for k, v in NESTED.items()]),
            "first": _layout([(c, _parts(FLAT[k])[0]) for c, k in flat]),
            "second": _layout([(c, _parts(FLAT[k])[1]) for c, k in flat]),
        }
    )
    return rows.select(
        *keep, _named(_text("nested")).alias("original_code"), _named(f"concat({_text('first')}, {_text('second')})").alias("refactored_code")
    )


# --- prompts and splits --------------------------------------------------------------------------------------------


def render_prompts(pairs: DataFrame, style: str = "instruction") -> DataFrame:
    """Add ``prompt``: ``instruction`` (task, input, output, explanation), ``simple`` (before and after) or ``eval``."""
    lang, old, new = F.col("language"), F.col("original_code"), F.col("refactored_code")
    fence = F.concat(F.lit("```"), lang, F.lit("\n"))
    if style == "simple":
        text = F.concat(F.lit("// Original nested code:\n"), old, F.lit("\n\n// Refactored using "), "pattern", F.lit(":\n"), new)
    elif style == "eval":
        text = F.concat(
            F.lit("### Instruction:\nRefactor the following "), lang, F.lit(" code to reduce nested if statements.\n\n### Input Code:\n"), fence, old,
            F.lit("\n```\n\n### Refactored Code:\n"), fence,
        )
    else:
        text = F.concat(
            F.lit("### Instruction:\nRefactor the following "), lang, F.lit(" code to reduce nested if statements using the "), "pattern",
            F.lit(" pattern. The goal is to improve readability and reduce complexity.\n\n### Input Code:\n"), fence, old,
            F.lit("\n```\n\n### Expected Output:\n"), fence, new, F.lit("\n```\n\n### Explanation:\n"), "description",
            F.lit("\nComplexity reduction: "), F.col("complexity_reduction").cast("string"),
            F.lit("\nDepth reduction: "), F.col("depth_reduction").cast("string"), F.lit("\n"),
        )
    return pairs.withColumn("prompt", text)


def split_pairs(pairs: DataFrame, frac: float = 0.2, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Add ``split``: ``eval`` for a seeded share of the ids, else ``train``; an id never changes sides."""
    bucket = stable_bucket(F.col(id_col), 10_000, str(seed))
    return pairs.withColumn("split", F.when(bucket < int(round(frac * 10_000)), "eval").otherwise("train"))


def evaluate_pairs(pairs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Expected against generated text per pair: line changes, similarity, and nested-if and score deltas to the original.

    ``outputs``: (id, generated). Pairs without an output are kept with NULLs.
    """
    rows = pairs.join(outputs.select("id", "generated"), "id", "left")
    total = line_total(F.col("refactored_code")) + line_total(F.col("generated"))
    rows = rows.withColumns(
        {
            "lines_off": positional_changes(F.col("refactored_code"), F.col("generated")),
            "similarity": (total - multiset_changes(F.col("refactored_code"), F.col("generated"))).cast("double") / total,
        }
    )
    delta = nested_if_delta(rows, "original_code", "generated")
    reduction = F.col("max_depth_before") - F.col("max_depth_after")
    return delta.select(
        "id", "language", "pattern", "lines_off", "similarity", "nested_ifs_before", "nested_ifs_after", "max_depth_before", "max_depth_after",
        "complexity_before", "complexity_after", reduction.alias("actual_depth_reduction"), F.col("depth_reduction").alias("expected_depth_reduction"),
        F.col("complexity_reduction").alias("expected_complexity_reduction"),
    )


# --- batch request tables ------------------------------------------------------------------------------------------

# --- fixed values: prompt sentences --------------------------------------------------------------------------------
PROMPT_HEAD = (
    "You are an expert code refactoring engine.\n\nYour job is to take code written in any language and return only the refactored version. "
    "Follow these rules strictly:\n\n1. Do not explain anything. Do not use any comments or markdown.\n2. Keep the original structure and language.\n"
)
PROMPT_FOCUS = {
    "performance": "3. Focus primarily on PERFORMANCE optimizations: optimize loops, reduce complexity, improve algorithms, eliminate redundant operations.\n",
    "readability": "3. Focus primarily on READABILITY improvements: better naming, clearer logic flow, simplified expressions, consistent formatting.\n",
    "security": "3. Focus primarily on SECURITY improvements: fix vulnerabilities, secure data handling, input validation, safe coding practices.\n",
    "": "3. Provide COMPREHENSIVE refactoring: improve naming, simplify logic, remove duplication, add typing (if language supports it), and make code modern and clean.\n",
}
PROMPT_COMMENTS = (
    "4. PRESERVE all existing comments and maintain their placement.\n",
    "4. Remove unnecessary comments but keep essential ones.\n",
)
PROMPT_DOCS = (
    "5. ADD clear docstrings/documentation for functions and classes where missing.\n",
    "5. Do not add new documentation unless absolutely necessary.\n",
)
PROMPT_STYLE = ("6. STRICTLY follow {} coding conventions and style guidelines.\n", "6. Maintain existing code style while making improvements.\n")
PROMPT_TAIL = (
    "7. NEVER output text like 'Here is the refactored code:' — only output the code.\n\nYour output must be clean, minimal, and production-ready."
)
FIX_PROMPT = (
    "You are a syntax error correction specialist for {0} code.\n\nYour ONLY job is to fix syntax errors in the provided code while preserving all "
    "functionality and logic.\n\nRules:\n1. Fix ONLY syntax errors - do not refactor or improve the code\n2. Preserve all variable names, function "
    "names, and logic exactly as they are\n3. Output ONLY the corrected code - no explanations, no markdown, no comments\n4. Do not add or remove "
    "functionality\n5. Ensure the output is valid {0} syntax\n\nYou will receive the broken code and the specific error message. Fix only what's broken."
)


def refactor_requests(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """(file, session, system prompt from the session's options, user prompt = the text)."""
    options = sessions.select("session_id", "refactor_type", "preserve_comments", "add_documentation", "follow_conventions")
    rows = files.select("file_id", "session_id", "language", F.col("original_content").alias("user_prompt")).join(options, "session_id")

    def either(flag: str, texts: tuple[str, str]) -> Column:
        return F.when(F.col(flag), texts[0]).otherwise(texts[1])

    focus = first_match([(F.col("refactor_type") == k, v) for k, v in PROMPT_FOCUS.items() if k], PROMPT_FOCUS[""])
    lead, trail = PROMPT_STYLE[0].split("{}")
    style = F.when(F.col("follow_conventions"), F.concat(F.lit(lead), "language", F.lit(trail))).otherwise(PROMPT_STYLE[1])
    prompt = F.concat(F.lit(PROMPT_HEAD), focus, either("preserve_comments", PROMPT_COMMENTS), either("add_documentation", PROMPT_DOCS), style, F.lit(PROMPT_TAIL))
    return rows.select("file_id", "session_id", "language", prompt.alias("system_prompt"), "user_prompt")


def correction_requests(responses: DataFrame, originals: DataFrame, max_rounds: int = 3, key: str = "file_id") -> DataFrame:
    """Next-round requests for Python responses that still do not parse after round ``round`` (< ``max_rounds``).

    ``responses``: (file, round, language, content); ``originals``: (file, original_content).
    """
    open_rounds = responses.filter((F.col("round") < max_rounds) & (F.lower("language") == "python"))
    cleaned = clean_response(open_rounds).withColumn("error", error_message(facts_column(F.col("code"))))
    broken = cleaned.filter(F.col("error").isNotNull()).join(originals.select(key, "original_content"), key)
    lead = FIX_PROMPT.split("{0}")
    system = F.concat(F.lit(lead[0]), "language", F.lit(lead[1]), "language", F.lit(lead[2]))
    user = F.concat(
        F.lit("BROKEN CODE:\n```\n"), "code", F.lit("\n```\n\nERROR MESSAGE:\n"), "error", F.lit("\n\nORIGINAL CODE (for reference):\n```\n"),
        "original_content", F.lit("\n```\n\nFix the syntax error in the broken code. Output only the corrected code."),
    )
    return broken.select(key, (F.col("round") + 1).alias("round"), "language", "error", system.alias("system_prompt"), user.alias("user_prompt"))
