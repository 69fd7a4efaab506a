"""File and line metrics. A file is one row, so every per-file measure is a narrow column expression without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.functions.patterns import (
    clamp, count_any, count_of, count_re, first_match, indent_of, is_blank, line_total, lines_containing, lines_starting,
    long_lines, nonblank_lines, rx, search, split_lines, strip, word_count,
)
from codecorpus.operators.pyfacts import facts_column


def file_facts(df: DataFrame, content: str = "content") -> DataFrame:
    """Size in bytes, line count, average line length and md5 of the text."""
    text = F.col(content)
    size, lines = F.octet_length(text), line_total(text)
    return df.withColumns(
        {
            "size_bytes": size,
            "line_count": lines,
            "avg_line_length": size.cast("double") / lines,
            "file_hash": F.md5(text),
        }
    )


def lines(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """One row per line: 1-based number, text, indent, blank / comment / long flags."""
    rows = df.select(key, F.posexplode(split_lines(F.col(content))).alias("pos", "line"))
    body = strip(F.col("line"))
    return rows.select(
        key,
        (F.col("pos") + 1).alias("line_no"),
        "line",
        indent_of(F.col("line")).alias("indent"),
        (body == "").alias("is_blank"),
        (body.startswith("#") | F.col("line").contains("//")).alias("is_comment"),
        (F.length("line") > 100).alias("is_long"),
    )


def _scores(complexity: Column, readability: Column, maintainability: Column) -> Column:
    return F.struct(
        complexity.cast("int").alias("complexity"),
        readability.cast("int").alias("readability"),
        maintainability.cast("int").alias("maintainability"),
    )


def _sparse_comments(text: Column, pattern: str, threshold: float) -> Column:
    """True when the share of comment lines among non-blank lines is below the threshold."""
    total = nonblank_lines(text)
    return (total > 0) & (lines_containing(text, pattern).cast("double") / total < threshold)


def javascript_scores(text: Column) -> Column:
    functions = count_of(text, "function") + count_of(text, "=>")
    return _scores(
        clamp(100 - 3 * count_any(text, dims.BRANCH_WORDS), 65, 100),
        clamp(100 - 3 * long_lines(text, 120) - F.when(_sparse_comments(text, "//|/\\*", 0.1), 20).otherwise(0), 0, 100),
        clamp(100 - F.when(functions == 0, 20).otherwise(0) - 5 * count_re(text, r"var(?<!\wvar)\s+"), 0, 100),
    )


def java_scores(text: Column) -> Column:
    bonus = F.when(search(text, r"class\s+[A-Z][a-zA-Z0-9]*"), 10).otherwise(0) + F.when(
        search(text, r"(public|private|protected)\s+\w+\s+([a-z][a-zA-Z0-9]*)"), 5
    ).otherwise(0)
    return _scores(
        clamp(100 - 2 * count_any(text, dims.BRANCH_WORDS), 65, 100),
        clamp(100 - 2 * long_lines(text, 100) - F.when(_sparse_comments(text, "//|\\*", 0.15), 15).otherwise(0), 0, 100),
        clamp(100 + bonus, 0, 100),
    )


# Anchored at word starts and possessive: neighbouring classes are disjoint, so nothing is gained by backtracking.
_C_FUNCTION = r"(?<!\w)\w++\s++\w++\s*+\([^)]*+\)\s*+\{"


def cpp_scores(text: Column) -> Column:
    includes = lines_starting(text, "#include")
    return _scores(
        clamp(100 - 2 * count_any(text, dims.BRANCH_WORDS_C), 65, 100),
        clamp(100 - 2 * long_lines(text, 100) - F.when(_sparse_comments(text, "//|/\\*", 0.1), 20).otherwise(0), 0, 100),
        clamp(100 - F.when(includes > 10, 10).otherwise(0) + F.when(search(text, _C_FUNCTION), 10).otherwise(0), 0, 100),
    )


def generic_scores(text: Column) -> Column:
    total = nonblank_lines(text)
    return _scores(
        clamp(100 - F.floor(total / 10), 65, 100),
        clamp(90 - 5 * long_lines(text, 120), 40, 100),
        clamp(85 - F.floor(total / 20), 45, 100),
    )


def _kinds(facts: Column, *kinds: str) -> Column:
    return F.filter(facts, lambda n: n["kind"].isin(*kinds))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0), lambda acc, n: acc + value(n))


def python_scores(text: Column, facts: Column) -> Column:
    """Scores of a Python file from its node facts and its text; (65, 20, 25) when it does not parse."""
    branches = F.size(_kinds(facts, "If", "While", "For", "AsyncFor", "ExceptHandler"))
    operators = _total(_kinds(facts, "BoolOp"), lambda n: n["n_values"] - 1)
    total = nonblank_lines(text)
    share = lines_starting(text, "#").cast("double") / total
    comment = F.when(total == 0, 0).when(share < 0.1, -15).when(share > 0.3, 10).otherwise(0)

    def lower_name(n: Column) -> Column:
        return (n["name"] == F.lower(n["name"])) & (F.lower(n["name"]) != F.upper(n["name"])) & ~n["name"].contains("__")

    def upper_first(n: Column) -> Column:
        first = F.substring(n["name"], 1, 1)
        return (first == F.upper(first)) & (F.lower(first) != F.upper(first))

    naming = F.size(F.filter(_kinds(facts, "FunctionDef"), lambda n: ~lower_name(n))) + F.size(
        F.filter(_kinds(facts, "ClassDef"), lambda n: ~upper_first(n))
    )
    length = _total(
        _kinds(facts, "FunctionDef"),
        lambda n: F.when(n["end_line"] - n["line"] > 50, 10).when(n["end_line"] - n["line"] > 30, 5).otherwise(0),
    )
    functions = _kinds(facts, "FunctionDef", "AsyncFunctionDef")
    documented = F.size(F.filter(functions, lambda n: n["has_doc"])).cast("double") / F.size(functions)
    doc = F.when(F.size(functions) == 0, 0).when(documented < 0.5, -15).when(documented > 0.8, 10).otherwise(0)
    good = _scores(
        clamp(100 - 2 * (branches + operators + 1), 65, 100),
        clamp(100 - 2 * long_lines(text, 100) + comment - 3 * naming, 0, 100),
        clamp(100 - length + doc, 0, 100),
    )
    return F.when(F.exists(facts, lambda n: n["kind"] == "error"), _scores(F.lit(65), F.lit(20), F.lit(25))).otherwise(good)


def _with_scores(df: DataFrame, scores: Column) -> DataFrame:
    return df.withColumn("__s", scores).select("*", "__s.*").drop("__s")


def score_javascript(df: DataFrame, content: str = "content") -> DataFrame:
    return _with_scores(df, javascript_scores(F.col(content)))


def score_java(df: DataFrame, content: str = "content") -> DataFrame:
    return _with_scores(df, java_scores(F.col(content)))


def score_cpp(df: DataFrame, content: str = "content") -> DataFrame:
    return _with_scores(df, cpp_scores(F.col(content)))


def score_generic(df: DataFrame, content: str = "content") -> DataFrame:
    return _with_scores(df, generic_scores(F.col(content)))


def score_python(df: DataFrame, content: str = "content") -> DataFrame:
    df = df.withColumn("__facts", facts_column(F.col(content)))
    return _with_scores(df, python_scores(F.col(content), F.col("__facts"))).drop("__facts")


def score(df: DataFrame, content: str = "content", language: str = "language", facts: str | None = None) -> DataFrame:
    """Dispatch by lower-cased language name; display names such as ``C++`` or ``JSX`` take the generic scores. ``facts`` names
    a column of node facts when the input already has one.

    Only the branch of the file's own language is evaluated, and only Python text crosses to the Python worker.
    """
    text, lang = F.col(content), F.lower(F.col(language))
    df = df.withColumn("__facts", F.col(facts) if facts else facts_column(F.when(lang == "python", text)))
    chosen = (
        F.when(lang == "python", python_scores(text, F.col("__facts")))
        .when(lang == "javascript", javascript_scores(text))
        .when(lang == "java", java_scores(text))
        .when(lang.isin("cpp", "c"), cpp_scores(text))
        .otherwise(generic_scores(text))
    )
    return _with_scores(df, chosen).drop("__facts")


def overall_score(complexity: Column, readability: Column, maintainability: Column) -> Column:
    """0.4 / 0.3 / 0.3 weighting, rounded half to even."""
    return F.rint(complexity * F.lit(0.4) + readability * F.lit(0.3) + maintainability * F.lit(0.3)).cast("int")


def overall(df: DataFrame) -> DataFrame:
    return df.withColumn("overall", overall_score(F.col("complexity"), F.col("readability"), F.col("maintainability")))


def counts_javascript(df: DataFrame, content: str = "content") -> DataFrame:
    text = F.col(content)
    return df.withColumns(
        {
            "cyclomatic_complexity": 1 + count_any(text, dims.COUNT_WORDS + dims.COUNT_OPERATORS),
            "lines_of_code": nonblank_lines(text),
            "function_count": count_of(text, "function ") + count_of(text, "=>"),
            "class_count": count_of(text, "class "),
        }
    )


def _whole_words(text: Column, words: list[str]) -> Column:
    """Whole-word keyword hits plus literal ``&&`` and ``||`` (an unescaped ``||`` pattern would match everywhere)."""
    total = count_any(text, dims.COUNT_OPERATORS)
    for w in words:
        total = total + word_count(text, w)
    return total


def counts_java(df: DataFrame, content: str = "content") -> DataFrame:
    text = F.col(content)
    return df.withColumns(
        {
            "cyclomatic_complexity": 1 + _whole_words(text, dims.COUNT_WORDS + ["catch"]),
            "lines_of_code": nonblank_lines(text) - lines_starting(text, "//"),
            "method_count": count_re(text, r"(?<!\w)(?=\w)(public|private|protected)?\s*(static)?\s*\w+\s+\w+\s*\("),
            "class_count": count_re(text, r"class(?<!\wclass)\s+\w+"),
        }
    )


def counts_cpp(df: DataFrame, content: str = "content") -> DataFrame:
    text = F.col(content)
    return df.withColumns(
        {
            "cyclomatic_complexity": 1 + _whole_words(text, dims.COUNT_WORDS),
            "lines_of_code": nonblank_lines(text) - lines_starting(text, "//|/\\*"),
            "function_count": count_re(text, _C_FUNCTION),
            "class_count": count_re(text, r"(class(?<!\wclass)|struct(?<!\wstruct))\s+\w+"),
        }
    )


def counts_python(df: DataFrame, content: str = "content") -> DataFrame:
    """Cyclomatic complexity, line, function and class counts and nesting depth; NULL counts when the file does not parse.

    Functions and classes are counted from the facts (a visitor that never reaches them would leave 0).
    """
    df = df.withColumn("__facts", facts_column(F.col(content)))
    facts = F.col("__facts")
    parsed = ~F.exists(facts, lambda n: n["kind"] == "error")
    decisions = F.size(_kinds(facts, "If", "While", "For", "AsyncFor", "ExceptHandler", "With", "AsyncWith"))
    return df.withColumns(
        {
            "cyclomatic_complexity": F.when(
                parsed, 1 + decisions + _total(_kinds(facts, "BoolOp"), lambda n: n["n_values"] - 1)
            ),
            "lines_of_code": F.when(parsed, line_total(F.col(content))),
            "function_count": F.when(parsed, F.size(_kinds(facts, "FunctionDef", "AsyncFunctionDef"))),
            "class_count": F.when(parsed, F.size(_kinds(facts, "ClassDef"))),
            "max_nesting_depth": F.when(parsed, F.coalesce(F.array_max(F.transform(facts, lambda n: n["block_depth"])), F.lit(0))),
        }
    ).drop("__facts")


def quality_issues(
    df: DataFrame, content: str = "content", path: str = "original_path", key: str = "file_id", python: bool = True
) -> DataFrame:
    """One row per (file, issue): long lines, few comments, many control words, long functions, TODO, blank runs.

    ``value`` is the measured amount, ``detail`` the first three line numbers or function names.
    """
    text, low = F.col(content), F.lower(F.col(content))
    total = nonblank_lines(text)
    numbered = F.transform(split_lines(text), lambda line, i: F.when(F.length(line) > 100, i + 1))
    long_numbers = F.filter(numbered, lambda x: x.isNotNull())
    comments = F.size(F.filter(split_lines(text), lambda s: strip(s).startswith("#") | s.contains("//")))
    share = comments.cast("double") / total
    control = count_any(low, dims.ISSUE_WORDS)

    def issue(cond: Column, code: str, value: Column, detail: Column | None = None) -> Column:
        detail = F.lit(None).cast("string") if detail is None else detail
        return F.when(
            cond, F.struct(F.lit(code).alias("issue"), value.cast("double").alias("value"), detail.alias("detail"))
        )

    issues = [
        issue(F.size(long_numbers) > 0, "long_lines", F.size(long_numbers),
              F.array_join(F.transform(F.slice(long_numbers, 1, 3), lambda x: x.cast("string")), ", ")),
        issue((total > 0) & (share < 0.1), "low_comment_ratio", share),
        issue(control > 20, "high_complexity", control),
        issue(text.contains("TODO") | text.contains("FIXME"), "todo", count_of(text, "TODO") + count_of(text, "FIXME")),
        issue(count_of(text, "\n\n\n") > 0, "blank_runs", count_of(text, "\n\n\n")),
    ]
    if python:
        df = df.withColumn("__facts", facts_column(F.when(F.col(path).endswith(".py"), text)))
        long_functions = F.transform(
            F.filter(_kinds(F.col("__facts"), "FunctionDef"), lambda n: n["end_line"] - n["line"] > 30),
            lambda n: F.concat(n["name"], F.lit("("), (n["end_line"] - n["line"]).cast("string"), F.lit(" lines)")),
        )
        issues.append(issue(F.size(long_functions) > 0, "long_functions", F.size(long_functions),
                            F.array_join(F.slice(long_functions, 1, 3), ", ")))
    return df.select(key, F.inline(F.array_compact(F.array(*issues))))


def _splitlines_count(text: Column) -> Column:
    """Line count of ``str.splitlines``: all Unicode line ends, no empty last line."""
    ends = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
    last = text.rlike("(?s)(?:%s)\\z" % ends)
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit(ends)) + 1 - last.cast("int"))


def light_metrics(text: Column, language: Column) -> dict[str, Column]:
    lang = F.lower(language)
    functions = first_match(
        [
            (lang == "python", count_of(text, "def ")),
            (lang == "javascript", count_of(text, "function ") + count_of(text, "=>")),
            (lang == "java", count_any(text, ["public ", "private ", "protected "])),
        ],
        F.lit(None).cast("int"),
    )
    return {
        "lines_of_code": _splitlines_count(text),
        "character_count": F.length(text),
        "functions_count": functions,
        "classes_count": count_of(text, "class "),
        "complexity_estimate": count_any(text, ["if ", "for ", "while "]),
    }


def metric_change(
    df: DataFrame, before: str = "original_content", after: str = "refactored_content", language: str = "language",
    key: str = "file_id",
) -> DataFrame:
    """(file, metric, before, after, change %) for the supported languages; rows with a zero base are left out."""
    supported = df.filter(F.lower(F.col(language)).isin("python", "javascript", "java"))
    old = light_metrics(F.col(before), F.col(language))
    new = light_metrics(F.col(after), F.col(language))
    metrics = F.array(
        *[F.struct(F.lit(m).alias("metric"), old[m].alias("before"), new[m].alias("after")) for m in old]
    )
    return (
        supported.select(key, F.inline(metrics))
        .filter(F.col("before") != 0)
        .withColumn("change_pct", (F.col("after") - F.col("before")).cast("double") / F.col("before") * 100.0)
    )


def delimiter_check(df: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """Add ``delimiter_error``: the first unbalanced pair, NULL when balanced (brackets are not checked for Java)."""
    text = F.col(content)

    def unbalanced(opening: str, closing: str, label: str, applies: Column):
        diff = count_of(text, opening) - count_of(text, closing)
        return (applies & (diff != 0), F.concat(F.lit(f"Unbalanced {label}: "), diff.cast("string")))

    every = F.lit(True)
    return df.withColumn(
        "delimiter_error",
        first_match(
            [
                unbalanced("{", "}", "braces", every),
                unbalanced("(", ")", "parentheses", every),
                unbalanced("[", "]", "brackets", F.lower(F.col(language)) != "java"),
            ],
            F.lit(None).cast("string"),
        ),
    )


def missing_semicolon(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """First line of a Java file that should end with ``;`` but does not: (file, line_no, line)."""
    numbered = F.transform(split_lines(F.col(content)), lambda s, i: F.struct((i + 1).alias("line_no"), strip(s).alias("line")))

    def bad(x: Column) -> Column:
        s = x["line"]
        ok = s == ""
        for prefix in ["//", "/*", "@", "package", "import", "public class", "private class", "class"]:
            ok = ok | s.startswith(prefix)
        for suffix in ["*/", "{", "}", ";"]:
            ok = ok | s.endswith(suffix)
        return ~ok

    return df.select(key, F.inline(F.slice(F.filter(numbered, bad), 1, 1)))


def _long_functions(df: DataFrame, content: str, limit: int) -> DataFrame:
    """``df`` with ``__l``, its numbered lines, and ``__long``: (name, line_no, indent, following_lines) of the long Python functions.

    The scan of a header ends at the next header, so the slices are disjoint and the work is linear in the file.
    """
    numbered = F.transform(
        split_lines(F.col(content)),
        lambda s, i: F.struct(
            i.alias("i"), indent_of(s).alias("indent"), is_blank(s).alias("blank"), strip(s).startswith("def ").alias("head"),
            strip(s).alias("text"), s.alias("line"),
        ),
    )
    df = df.withColumn("__l", numbered).withColumn("__h", F.filter("__l", lambda x: x["head"]))

    def ended(h: Column, n: Column) -> Column:
        stop = F.coalesce(F.get(F.col("__h"), n + 1)["i"], F.size("__l"))
        body = F.slice(F.col("__l"), h["i"] + 2, stop - h["i"] - 1)
        end = F.get(F.filter(body, lambda x: ~x["blank"] & (x["indent"] <= h["indent"])), F.lit(0))["i"]
        return F.struct(
            F.regexp_extract(h["text"], rx(r"def\s+(\w+)"), 1).alias("name"), (h["i"] + 1).alias("line_no"), h["indent"].alias("indent"),
            (end - h["i"]).alias("following_lines"),
        )

    return df.withColumn("__long", F.filter(F.transform("__h", ended), lambda f: f["following_lines"] > limit)).drop("__h")


def long_functions(df: DataFrame, content: str = "content", key: str = "file_id", limit: int = 20) -> DataFrame:
    """Python functions followed by more than ``limit`` lines before a dedent, found by indentation."""
    found = _long_functions(df.select(key, content), content, limit).select(key, F.inline("__long"))
    return found.select(key, "name", "line_no", "following_lines")


def note_long_functions(df: DataFrame, content: str = "content", limit: int = 20, out: str = "new_content") -> DataFrame:
    """Add the text with a note above the header of every long Python function, indented as its body."""
    found = _long_functions(df, content, limit).withColumn("__at", F.map_from_entries(F.transform("__long", lambda f: F.struct(f["line_no"], f["indent"]))))

    def noted(x: Column) -> Column:
        indent = F.try_element_at(F.col("__at"), x["i"] + 1)
        note = F.concat(F.repeat(F.lit(" "), indent + 4), F.lit(LONG_NOTE))
        return F.when(indent.isNull(), F.array(x["line"])).otherwise(F.array(note, x["line"]))

    return found.withColumn(out, F.array_join(F.flatten(F.transform("__l", noted)), "\n")).drop("__l", "__long", "__at")


LONG_NOTE = "# TODO: Consider breaking this function into smaller functions"
MAGIC_NUMBER = r"\b(?<![a-zA-Z_])(?:[2-9]|[1-9]\d+)(?:\.\d+)?(?![a-zA-Z_])\b"


#: The same, without the values that are no magic numbers: the whole part, and the part behind the point.
_LARGE = r"\b(?<![a-zA-Z_])(?!(?:10|100)(?![\d.]))(?!(?:10|100)\.(?!\d))([6-9]|[1-9]\d+)"
_ENDS = r"(?![a-zA-Z_])\b"


def _may_hold_numbers(line: Column) -> Column:
    """Code lines with an operator and a digit."""
    return (
        ~strip(line).startswith("#") & ~line.contains('"""') & ~line.contains("'''") & ~line.contains("import ")
        & line.rlike(r"[=+\-*/%<>]") & line.rlike("[0-9]")
    )


def _is_magic(literal: Column) -> Column:
    return ~literal.isin("2", "3", "4", "5", "10", "100") & (F.floor(literal.cast("double")) > 5)


def _constant(literal: Column) -> Column:
    return F.concat(F.lit("CONSTANT_"), F.replace(literal, F.lit("."), F.lit("_")))


def magic_numbers(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """Numeric literals above 5 on code lines with an operator: (file, line_no, literal, constant)."""
    rows = df.select(key, F.posexplode(split_lines(F.col(content))).alias("pos", "line"))
    line = F.col("line")
    literal = F.explode(F.regexp_extract_all(line, F.lit(rx(MAGIC_NUMBER)), F.lit(0))).alias("literal")
    found = rows.filter(_may_hold_numbers(line)).select(key, (F.col("pos") + 1).alias("line_no"), literal)
    return found.filter(_is_magic(F.col("literal"))).withColumn("constant", _constant(F.col("literal")))


def extract_constants(df: DataFrame, content: str = "content", out: str = "new_content") -> DataFrame:
    """Add the Python text with magic numbers replaced by named constants, defined in order of first use before the first line that
    is neither an import nor blank, and ``constants``, how many there are. All within the row.

    A literal is replaced where it stands alone; a whole number that is also the whole part of a longer literal on the line leaves that alone.
    """
    lines = split_lines(F.col(content))
    taken = F.transform("__l", lambda s: F.when(_may_hold_numbers(s), F.regexp_extract_all(s, F.lit(rx(MAGIC_NUMBER)), F.lit(0))))
    names = F.array_distinct(F.filter(F.flatten(F.filter(taken, lambda x: x.isNotNull())), _is_magic))

    def renamed(s: Column) -> Column:
        points = F.regexp_replace(s, _LARGE + r"\.(\d+)" + _ENDS, "CONSTANT_$1_$2")
        return F.when(_may_hold_numbers(s), F.regexp_replace(points, _LARGE + _ENDS, "CONSTANT_$1")).otherwise(s)

    df = df.withColumn("__l", lines).withColumn("__c", names)
    head = F.filter(
        F.transform("__l", lambda s, i: F.when(~(s.startswith("import ") | s.startswith("from ") | is_blank(s)), i)), lambda i: i.isNotNull()
    )
    first = F.coalesce(F.get(head, F.lit(0)), F.size("__l"))
    defined = F.concat(F.array(F.lit("")), F.transform("__c", lambda c: F.concat(_constant(c), F.lit(" = "), c)), F.array(F.lit("")))
    df = df.withColumn("__r", F.transform("__l", renamed)).withColumn("__at", first)
    begin, rest = F.slice("__r", F.lit(1), F.col("__at")), F.slice(F.col("__r"), F.col("__at") + 1, F.size("__r"))
    whole = F.concat(begin, F.when(F.col("__at") < F.size("__l"), defined).otherwise(F.expr("cast(array() as array<string>)")), rest)
    text = F.when(F.size("__c") > 0, F.array_join(whole, "\n")).otherwise(F.col(content))
    return df.withColumn(out, text).withColumn("constants", F.size("__c")).drop("__l", "__c", "__r", "__at")


def magic_number_totals(found: DataFrame) -> DataFrame:
    """Corpus-wide count per literal and the number of files that use it."""
    per_file = found.groupBy("literal", "file_id").agg(F.count("*").alias("n"))
    return per_file.groupBy("literal").agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"))


def snippet(df: DataFrame, n: int = 50, content: str = "content", out: str = "snippet") -> DataFrame:
    """First ``n`` lines and a note on how many more there are; the whole text when it is short enough."""
    text = F.col(content)
    total = line_total(text)
    note = F.concat(
        F.substring_index(text, "\n", n), F.lit("\n\n# ... ("), (total - n).cast("string"), F.lit(" more lines truncated)")
    )
    return df.withColumn(out, F.when(total <= n, text).otherwise(note))

