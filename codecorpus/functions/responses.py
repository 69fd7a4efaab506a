"""Text functions over error messages and model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.functions.patterns import first_match, has_any, is_blank, rx, search, split_lines, strip, sub


def error_pattern(message: Column) -> Column:
    """Keyword class of an error message; the first class with a hit wins, else ``unknown``."""
    low = F.lower(message)
    return first_match([(has_any(low, words), name) for name, words in dims.ERROR_PATTERNS.items()], "unknown")


def friendly_message(pattern: Column) -> Column:
    return first_match([(pattern == k, v) for k, v in dims.FRIENDLY_MESSAGES.items()], dims.FRIENDLY_MESSAGES["unknown"])


def session_message(message: Column) -> Column:
    """User message for a failed session."""
    low = F.lower(message)
    return first_match([(has_any(low, words), text) for words, text in dims.SESSION_MESSAGES], dims.SESSION_DEFAULT)


def hints(message: Column) -> Column:
    """Array of hints for an error message."""
    low = F.lower(message)
    return first_match(
        [(has_any(low, words), F.array(*map(F.lit, lines))) for words, lines in dims.HINTS], F.array(*map(F.lit, dims.HINTS_DEFAULT))
    )


# --- fixed values: patterns that mark code in a response -----------------------------------------------------------
CODE_MARKS = {
    "python": r"def\s+\w+|class\s+\w+|import\s+\w+|return\s+",
    "javascript": r"function\s+\w+|const\s+\w+|let\s+\w+|var\s+\w+",
    "java": r"public\s+class|private\s+\w+|public\s+\w+",
}
CODE_PREFIXES = {
    "python": ["def ", "class ", "import ", "from ", "    ", "return ", "print("],
    "javascript": ["function ", "const ", "let ", "var ", "    "],
    "java": ["public ", "private ", "class ", "    "],
}
INSTRUCTION_TAGS = [
    r"\[INST\].*?\[/INST\]", r"<<INST>>.*?<</INST>>", r"<<SYS>>.*?<</SYS>>", r"\[SYS\].*?\[/SYS\]",
]
CORRUPT_HEADS = [r'^"\s*\n```.*?-->', r'^".*?-->']
BOILERPLATE = [r"no refactoring performed.*?syntax itself", r"It's already as simple.*?language syntax"]
FENCE = r"```(?:\w+)?\s*\n(.*?)\n```"
PROSE_HEADS = ["Here", "The", "I", "This", "Fixed", "Corrected", "#"]
CODE_HINTS = ["def ", "import ", "print(", "return "]
NOTE_WORDS = ["Fixed", "Calling", "because"]


def _language_group(language: Column) -> Column:
    low = F.lower(language)
    return F.when(low == "jsx", "javascript").otherwise(low)


def looks_like_code(text: Column, language: Column) -> Column:
    """Per-language test; any non-blank text passes for languages without a pattern."""
    lang = _language_group(language)
    return ~is_blank(text) & first_match([(lang == k, search(text, p)) for k, p in CODE_MARKS.items()], F.lit(True))


def _code_lines(text: Column, language: str) -> Column:
    def keep(line: Column) -> Column:
        low = F.lower(line)
        skip = strip(line).startswith('"') | low.contains("no refactoring performed")
        if language == "python":
            skip = skip | low.contains("already as simple") | strip(line).startswith("-->")
            code = line.contains("=") & ~strip(line).startswith("#")
        else:
            code = line.contains("=")
        for p in CODE_PREFIXES[language]:
            code = code | line.startswith(p)
        return ~skip & (code | is_blank(line))

    return strip(F.array_join(F.filter(split_lines(text), keep), "\n"))


def clean_response(df: DataFrame, content: str = "content", language: str = "language", out: str = "code") -> DataFrame:
    """Code of a model response: drop instruction tags and boilerplate, take the first fenced block when it looks like code,
    else the code-looking lines of the language, else the cleaned text."""
    raw, lang = F.col(content), _language_group(F.col(language))
    text = raw
    for p in INSTRUCTION_TAGS:
        text = sub(text, p, "", "(?ds)")
    for p in CORRUPT_HEADS:
        text = sub(text, p, "", "(?dm)")
    for p in BOILERPLATE:
        text = sub(text, p, "", "(?dsiu)")
    corrupt = strip(raw).startswith('"\n```') & ~search(raw, r"def\s+\w+|class\s+\w+|function\s+\w+|public\s+class")
    df = df.withColumn("__t", text)
    df = df.withColumn("__b", strip(F.regexp_extract("__t", "(?ds)" + rx(FENCE), 1)))
    fenced = F.col("__t").rlike("(?ds)" + rx(FENCE)) & looks_like_code(F.col("__b"), F.col(language))
    picked = first_match([(lang == k, _code_lines(F.col("__t"), k)) for k in CODE_PREFIXES], strip(F.col("__t")))
    return df.withColumn(out, F.when(corrupt, "").when(fenced, F.col("__b")).otherwise(picked)).drop("__t", "__b")


def trim_trailing_prose(text: Column) -> Column:
    """Keep everything up to the last line that is neither blank, a ``#`` comment nor a note."""
    lines = split_lines(text)
    mark = F.transform(
        lines,
        lambda s, i: F.when(~is_blank(s) & ~strip(s).startswith("#") & ~strip(s).startswith("Note:") & ~strip(s).startswith("This"), i + 1),
    )
    last = F.coalesce(F.array_max(mark), F.size(lines))
    return strip(F.array_join(F.slice(lines, 1, last), "\n"))


RESPONSE_SCHEMA = (
    "struct<renames:array<struct<old_name:string,new_name:string,reason:string,confidence:double>>,"
    "docstrings:array<struct<target_type:string,target_name:string,docstring:string,style:string>>,"
    "transformations:array<struct<transformation_type:string,description:string,location:string,confidence:double,safety_level:string>>>"
)


def parse_suggestions(df: DataFrame, content: str = "content", out: str = "suggestions") -> DataFrame:
    """First ``{`` to last ``}`` as JSON; malformed or missing JSON gives empty lists; renames need both names."""
    parsed = F.from_json(F.regexp_extract(F.col(content), r"(?s)\{.*\}", 0), RESPONSE_SCHEMA, {"mode": "PERMISSIVE"})
    df = df.withColumn("__j", parsed)

    def items(field: str, kind: str) -> Column:
        return F.coalesce(F.col(f"__j.{field}"), F.expr(f"cast(array() as {kind})"))

    renames = F.transform(
        F.filter(items("renames", "array<struct<old_name:string,new_name:string,reason:string,confidence:double>>"),
                 lambda r: r["old_name"].isNotNull() & r["new_name"].isNotNull()),
        lambda r: F.struct(
            r["old_name"].alias("old_name"), r["new_name"].alias("new_name"),
            F.coalesce(r["reason"], F.lit("Improved naming")).alias("reason"), F.coalesce(r["confidence"], F.lit(0.7)).alias("confidence"),
        ),
    )
    return df.withColumn(
        out,
        F.struct(
            renames.alias("renames"),
            items("docstrings", "array<struct<target_type:string,target_name:string,docstring:string,style:string>>").alias("docstrings"),
            items("transformations",
                  "array<struct<transformation_type:string,description:string,location:string,confidence:double,safety_level:string>>").alias("transformations"),
        ),
    ).drop("__j")


def clean_fix_response(df: DataFrame, content: str = "content", out: str = "code") -> DataFrame:
    """Code of a correction response: the lines inside the first fence; code-looking lines before it (or everywhere without a
    fence) count too unless they open like prose; explanatory comment lines are dropped; the stripped text when nothing is left."""
    text = F.col(content)
    lines = split_lines(text)
    # 1-based positions of the opening fence and of the closing one behind it; the array size + 1 stands for "none".
    size = F.size(lines)
    opening = F.coalesce(F.array_min(F.transform(lines, lambda s, i: F.when(strip(s).startswith("```"), i + 1))), size + 1)
    df = df.withColumns({"__l": lines, "__o": opening})
    # Every later fence line that starts with ``` reopens the block, so only the end of the text closes it.
    inside = F.slice("__l", F.col("__o") + 1, F.greatest(F.size("__l") - F.col("__o"), F.lit(0)))
    inside = F.filter(inside, lambda s: ~strip(s).startswith("```"))

    def codey(s: Column) -> Column:
        prose = F.lit(False)
        for p in PROSE_HEADS:
            prose = prose | strip(s).startswith(p)
        return ~is_blank(s) & ~prose & has_any(s, CODE_HINTS)

    before = F.filter(F.slice("__l", 1, F.least(F.col("__o") - 1, F.size("__l"))), codey)
    df = df.withColumn("__k", F.concat(before, F.when(F.col("__o") <= F.size("__l"), inside).otherwise(F.expr("cast(array() as array<string>)"))))
    body = F.filter(split_lines(strip(F.array_join("__k", "\n"))), lambda s: ~(strip(s).startswith("#") & has_any(s, NOTE_WORDS)))
    return df.withColumn(out, F.when(F.size("__k") > 0, strip(F.array_join(body, "\n"))).otherwise(strip(text))).drop("__l", "__o", "__k")
