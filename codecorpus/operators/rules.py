"""Catalogue of rewrite rules and the operator that applies them.

A rule is a column expression over the text plus a hit count on the text before it. ``apply_rules`` chains the rules of a file's
language in catalogue order and returns the new text with a map of hits; a corpus tally is an explode and a group-by.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.patterns import (
    BLANK_RUN, WORD, count_of, count_re, indent_of, line_total, rx, split_lines, strip, sub,
)
from codecorpus.operators.metrics import overall_score, score
from codecorpus.operators.pyfacts import facts_column, with_facts

# --- fixed values: patterns and replacements of the regex rules ----------------------------------------------------
# name: (language, flags, [(pattern, replacement), ...]); replacements use $n references.
REGEX_RULES = {
    "bool_eq_true": ("python", "", [(r"if\s+([\w\.]+)\s*==\s*True\b", "if $1")]),
    "bool_eq_false": ("python", "", [(r"if\s+([\w\.]+)\s*==\s*False\b", "if not $1")]),
    "bool_ne_true": ("python", "", [(r"if\s+([\w\.]+)\s*!=\s*True\b", "if not $1")]),
    "bool_ne_false": ("python", "", [(r"if\s+([\w\.]+)\s*!=\s*False\b", "if $1")]),
    "list_comprehension": ("python", "(?dm)", [
        (r"(?:(?<!\s)(?=\s)|(?<![\s\w])(?=\w))(\s*)(\w+)\s*=\s*\[\]\s*\n\s*for\s+(\w+)\s+in\s+(\w+):\s*\n\s*\2\.append\(([^)]+)\)", "$1$2 = [$5 for $3 in $4]"),
    ]),
    "except_exception": ("python", "(?dm)", [(r"except:\s*$", "except Exception:"), (r"except\s+\w+:\s*$", "$0\n    pass")]),
    "js_var_const": ("javascript", "(?dm)", [(r"^(@*)var (?=@*\w+@*=)", "$1const ")]),
    "js_var_const_any": ("javascript", "", [(r"var(?<!\wvar)\s+(\w+)\s*=", "const $1 =")]),
    "js_var_let": ("javascript", "(?dm)", [(r"^(@*)var@+", "$1let ")]),
    "js_arrow": ("javascript", "", [(r"function\s*\(([^)]*)\)\s*\{\s*return\s+([^;]+);?\s*\}", "($1) => $2")]),
    "js_template_literal": ("javascript", "", [(r'"([^"]*?)"\s*\+\s*(\w+)\s*\+\s*"([^"]*?)"', "`$1\\${$2}$3`")]),
    "java_private_field": ("java", "(?dm)", [(r"^(\s*)(\w+\s+\w+\s*;)", "$1private $2")]),
    "java_diamond": ("java", "", [(r"(?<!\w)(\w+)<([^>]+)>\s+(\w+)\s*=\s*new\s+\w+<[^>]+>\(", "$1<$2> $3 = new $1<>(")]),
    "java_for_each": ("java", "", [
        (r"for\s*\(\s*(\w+)\s+(\w+)\s*:\s*(\w+)\s*\)\s*\{(?=[^}]*System\.out\.println)[^}]+\}", "$3.forEach(System.out::println);"),
    ]),
    "cpp_nullptr": ("cpp", "", [(r"NULL(?<!\wNULL)(?!\w)", "nullptr")]),
    "cpp_using": ("cpp", "(?d)", [(r"typedef\s+(.+)\s+(\w+);", "using $2 = $1;")]),
    "cpp_static_cast": ("cpp", "", [(r"\((\w+)\*?\)\s*(\w+)", "static_cast<$1>($2)")]),
    "cpp_unique_ptr": ("cpp", "", [
        (r"(?<!\w)(\w+)\*\s+(\w+)\s*=\s*new\s+\w+\s*\([^)]*\)", "std::unique_ptr<$1> $2 = std::make_unique<$1>()"),
    ]),
    "cpp_range_for": ("cpp", "", [
        (r"for\s*\(\s*\w+\s+\w+\s*=\s*0\s*;\s*\w+\s*<\s*(\w+)\.size\(\)\s*;\s*\+\+\w+\s*\)", "for(const auto& item : $1)"),
    ]),
}


@dataclass(frozen=True)
class Rule:
    """``language`` '' means any; ``message`` describes one hit; ``delta`` counts hits from the old and the new text instead."""

    name: str
    language: str
    apply: Callable[[Column], Column]
    hits: Callable[[Column], Column]
    message: str = ""
    opt_in: bool = False
    delta: Callable[[Column, Column], Column] | None = None


def _regex_rule(name: str, message: str = "", opt_in: bool = False) -> Rule:
    language, flags, steps = REGEX_RULES[name]
    steps = [(p.replace("@", BLANK_RUN), r) for p, r in steps]

    def run(text: Column) -> Column:
        for pattern, replacement in steps:
            text = sub(text, pattern, replacement, flags)
        return text

    def hits(text: Column) -> Column:
        total = F.lit(0)
        for pattern, _ in steps:
            total = total + count_re(text, pattern, flags)
        return total

    return Rule(name, language, run, hits, message, opt_in)


def _with_previous(text: Column) -> Column:
    """(line, previous) of every line, '' before the first. The text is split once per row, not once per line."""

    def pairs(lines: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(lines, F.lit(1), F.size(lines) - 1))
        return F.arrays_zip(lines.alias("line"), before.alias("previous"))

    return F.get(F.transform(F.array(split_lines(text)), pairs), F.lit(0))


def _lines_rule(text: Column, expand) -> Column:
    """Replace every line by an array of lines; ``expand(line, previous line)``."""
    return F.array_join(F.flatten(F.transform(_with_previous(text), lambda p: expand(p["line"], p["previous"]))), "\n")


def _lines_hits(text: Column, test) -> Column:
    return F.size(F.filter(_with_previous(text), lambda p: test(p["line"], p["previous"])))


# --- type hints ----------------------------------------------------------------------------------------------------

_DEF = r"def\s+(\w+)\(([^)]+)\):"


def _type_hints(text: Column) -> Column:
    hinted = sub(text, _DEF, r"def $1($2) -> Any:")
    needs = hinted.contains(" -> Any:") & ~hinted.contains("from typing import")
    return F.when(needs, F.regexp_replace(hinted, r"\A((?:(?:import |from )[^\n]*\n)*+)", "$1from typing import Any\n")).otherwise(hinted)


# --- const member functions ----------------------------------------------------------------------------------------
# Every signature-with-body is first marked, so that one which must stay unchanged still uses up its text.

_MARK = ("\ue000", "\ue001", "\ue002")  # private-use characters
_MEMBER = r"(?<!\w)(\w+\s+\w+\s*\([^)]*\))(\s*)\{([^}]+)\}"
# Conditions are single look-aheads over character classes: a repeated group would recurse once per character.
_CONST = (
    f"{_MARK[0]}(?![^{_MARK[1]}]*const)([^{_MARK[1]}]*){_MARK[1]}[^{_MARK[2]}]*{_MARK[2]}" + r"\{(?![^}]*this->)([^}=]+)\}"
)


def _marked(text: Column) -> Column:
    return sub(text, _MEMBER, f"{_MARK[0]}$1{_MARK[1]}$2{_MARK[2]}{{$3}}")


def _const_members(text: Column) -> Column:
    return F.translate(F.regexp_replace(_marked(text), _CONST, "$1 const {$2}"), "".join(_MARK), "")


# --- layout --------------------------------------------------------------------------------------------------------


def _tidy(text: Column) -> Column:
    """Strip trailing white space and keep one blank line of each run. Look-behinds follow the first character of a match, so
    they are not tried at every position."""
    stripped = F.regexp_replace(text, rf"{BLANK_RUN}(?<!{BLANK_RUN}{BLANK_RUN}){BLANK_RUN}*+(?=\n|\z)", "")
    middle = F.regexp_replace(stripped, r"\n(?:(?<=\n\n\n)|(?<=\A\n\n))\n*", "")
    return F.regexp_replace(middle, r"\n\z(?:(?<=\n\n)|(?<=\A\n))", "")


def _breakable(line: Column) -> Column:
    parts = F.split(line, " = ", -1)
    return (
        (F.length(line) > 100) & ~strip(line).startswith("#") & (F.size(parts) == 2)
        & (F.length(F.get(parts, F.lit(0))) < 50) & (F.length(F.get(parts, F.lit(1))) > 50)
    )


def _break_assignment(line: Column, _previous: Column) -> Column:
    parts = F.split(line, " = ", -1)
    pad = indent_of(line)
    return F.when(
        _breakable(line),
        F.array(
            F.concat(F.get(parts, F.lit(0)), F.lit(" = (")),
            F.concat(F.repeat(F.lit(" "), pad + 4), F.get(parts, F.lit(1))),
            F.concat(F.repeat(F.lit(" "), pad), F.lit(")")),
        ),
    ).otherwise(F.array(line))


# --- documentation placeholders ------------------------------------------------------------------------------------


def _uncommented(previous: Column) -> Column:
    return ~strip(previous).startswith("//") & ~strip(previous).startswith("*")


def _js_head(line: Column, previous: Column) -> Column:
    head = strip(line).startswith("function ") | line.contains(" function ") | line.contains("=>")
    return head & line.contains("{") & _uncommented(previous)


def _java_head(line: Column, previous: Column) -> Column:
    head = line.contains("public ") | line.contains("private ") | line.contains("protected ")
    return head & line.contains("(") & line.contains("{") & _uncommented(previous)


def _block_comment(test, what: str):
    def expand(line: Column, previous: Column) -> Column:
        pad = F.repeat(F.lit(" "), indent_of(line))
        return F.when(
            test(line, previous),
            F.array(F.concat(pad, F.lit("/**")), F.concat(pad, F.lit(f" * TODO: Add {what} description")), F.concat(pad, F.lit(" */")), line),
        ).otherwise(F.array(line))

    return expand


def _def_name(line: Column) -> Column:
    return strip(F.substring_index(F.get(F.split(line, "def ", -1), F.lit(1)), "(", 1))


def python_docstrings(df: DataFrame, content: str = "content", out: str = "new_content", facts: str | None = None) -> DataFrame:
    """Add a placeholder docstring after the header of public functions without one; ``documented`` lists their names.

    The names come from the node facts of the text (column ``facts`` when already known), so unparsable files stay unchanged.
    """
    text = F.col(content)
    df = df.withColumn("__f", F.col(facts) if facts else facts_column(text))
    bare = F.filter("__f", lambda n: (n["kind"] == "FunctionDef") & ~n["has_doc"] & ~n["name"].startswith("_"))
    df = df.withColumn("__n", F.transform(bare, lambda n: n["name"]))
    head = lambda s: strip(s).startswith("def ") & s.contains(":") & F.array_contains("__n", _def_name(s))

    def expand(line: Column, _previous: Column) -> Column:
        note = F.concat(F.repeat(F.lit(" "), indent_of(line) + 4), F.lit('"""TODO: Add function description"""'))
        return F.when(head(line), F.array(line, note)).otherwise(F.array(line))

    some = F.coalesce(F.size("__n") > 0, F.lit(False))
    names = F.transform(F.filter(split_lines(text), head), _def_name)
    return df.withColumns(
        {out: F.when(some, _lines_rule(text, expand)).otherwise(text), "documented": F.when(some, names).otherwise(F.expr("cast(array() as array<string>)"))}
    ).drop("__f", "__n")


# --- catalogue -----------------------------------------------------------------------------------------------------

CATALOGUE: list[Rule] = [
    _regex_rule("bool_eq_true", "Simplified boolean comparison (== True)"),
    _regex_rule("bool_eq_false", "Simplified boolean comparison (== False)"),
    _regex_rule("bool_ne_true"),
    _regex_rule("bool_ne_false"),
    _regex_rule("list_comprehension"),
    Rule("type_hints", "python", _type_hints, lambda t: count_re(t, _DEF)),
    _regex_rule("except_exception", opt_in=True),  # breaks handlers that already have a body
    _regex_rule("js_var_const"),
    _regex_rule("js_var_const_any", opt_in=True),  # alternative to js_var_const
    _regex_rule("js_var_let", opt_in=True),  # alternative to js_var_const
    _regex_rule("js_arrow"),
    _regex_rule("js_template_literal"),
    _regex_rule("java_private_field"),
    _regex_rule("java_diamond"),
    _regex_rule("java_for_each"),
    _regex_rule("cpp_nullptr"),
    _regex_rule("cpp_using"),
    _regex_rule("cpp_static_cast"),
    _regex_rule("cpp_unique_ptr"),
    _regex_rule("cpp_range_for"),
    Rule("cpp_const_member", "cpp", _const_members, lambda t: F.regexp_count(_marked(t), F.lit(_CONST)),
         delta=lambda old, new: count_of(new, " const {") - count_of(old, " const {")),
    Rule("break_assignment", "python", lambda t: _lines_rule(t, _break_assignment), lambda t: _lines_hits(t, lambda s, _: _breakable(s)),
         "Broke long assignment line"),
    Rule("js_doc", "javascript", lambda t: _lines_rule(t, _block_comment(_js_head, "function")), lambda t: _lines_hits(t, _js_head),
         "Added JSDoc comment placeholder"),
    Rule("java_doc", "java", lambda t: _lines_rule(t, _block_comment(_java_head, "method")), lambda t: _lines_hits(t, _java_head),
         "Added Javadoc comment placeholder"),
    Rule("tidy", "", _tidy, lambda t: line_total(t) - line_total(_tidy(t)), "Cleaned up excessive blank lines",
         delta=lambda old, new: line_total(old) - line_total(new)),
]
BY_NAME = {r.name: r for r in CATALOGUE}
DEFAULT_RULES = [r.name for r in CATALOGUE if not r.opt_in]


def apply_rules(
    df: DataFrame, rules: list[str] | None = None, content: str = "content", language: str = "language"
) -> DataFrame:
    """Add ``new_content`` and ``hits`` (rule -> matches before it ran, fired rules only).

    The chain is one expression: each rule maps a (text, hits) pair, so the tree stays linear in the number of rules wherever
    the optimizer moves it. ``cpp`` rules also serve ``c`` and ``c++``.
    """
    lang = F.lower(F.col(language))
    lang = F.when(lang.isin("c", "c++", "c/c++"), "cpp").when(lang == "jsx", "javascript").otherwise(lang)
    state = F.array(F.struct(F.col(content).alias("t"), F.expr("cast(array() as array<struct<k:string,v:int>>)").alias("h")))
    for name in rules or DEFAULT_RULES:
        state = F.transform(state, _step(BY_NAME[name], lang))
    df = df.withColumn("__r", F.get(state, F.lit(0)))
    return df.withColumns({"new_content": F.col("__r.t"), "hits": F.map_from_entries(F.col("__r.h"))}).drop("__r")


def _step(rule: Rule, lang: Column) -> Callable[[Column], Column]:
    mine = F.lit(True) if not rule.language else lang == rule.language

    def state(s: Column, text: Column, hits: Column) -> Column:
        entry = F.array(F.struct(F.lit(rule.name).alias("k"), hits.alias("v")))
        return F.struct(text.alias("t"), F.when(hits > 0, F.concat(s["h"], entry)).otherwise(s["h"]).alias("h"))

    def counted(s: Column) -> Column:
        """Count first; most rules do not fire, and then the text is not rewritten."""
        hits = F.array(rule.hits(s["t"]).cast("int"))
        fired = F.transform(hits, lambda n: F.when(n > 0, state(s, rule.apply(s["t"]), n)).otherwise(s))
        return F.when(mine, F.get(fired, F.lit(0))).otherwise(s)

    def compared(s: Column) -> Column:
        """Rewrite first, count from both texts."""
        changed = F.transform(F.array(rule.apply(s["t"])), lambda new: state(s, new, rule.delta(s["t"], new).cast("int")))
        return F.when(mine, F.get(changed, F.lit(0))).otherwise(s)

    return compared if rule.delta else counted


def rule_totals(applied: DataFrame) -> DataFrame:
    """Corpus tally: files and hits per rule."""
    # The outer form keeps the planner from testing the map, i.e. running the rules, once more in a filter below.
    fired = applied.select(F.explode_outer("hits").alias("rule", "n")).filter(F.col("rule").isNotNull())
    return fired.groupBy("rule").agg(F.count("*").alias("files"), F.sum("n").alias("hits"))


# --- rules driven by a suggestion table ----------------------------------------------------------------------------


def per_file(suggestions: DataFrame, *fields: str, key: str = "file_id") -> DataFrame:
    """(file, items): the suggestions of a file as one ordered, duplicate-free list.

    They were one model response to one file, i.e. one row, before they were exploded.
    """
    rows = suggestions.select(key, F.struct("position", *fields).alias("item"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("__items"))


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("\\Q"), name, F.lit("\\E"))


def _insert(text: Column, pattern: Column, what) -> Column:
    """Insert text in front of the first match of ``pattern``; ``what`` gets the indent (group 1 of the match)."""

    def group(k: int, p: Column) -> Column:
        return F.call_function("regexp_extract", text, p, F.lit(k))

    def placed(p: Column, at: Column) -> Column:
        return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), _let(group(1, p), what), F.substr(text, at))).otherwise(text)

    def found(p: Column, hit: Column) -> Column:
        return _let(F.when(F.length(hit) > 0, F.instr(text, hit)).otherwise(0), lambda at: placed(p, at))

    return _let(pattern, lambda p: _let(group(0, p), lambda hit: found(p, hit)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: inside a fold each mention would run its patterns again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _doc_patterns(language: Column, name: Column) -> list[Column]:
    """Header patterns of a named function in trial order; group 1 is the indent ('' for JavaScript).

    A header reaches back over the words (C++) or modifiers (Java) and white space before the name. The look-behind admits
    only the start of such a run, and runs are character classes, so long prose costs neither time nor stack.
    """
    q = _quoted(name)
    s, w = rx(r"\s"), rx(r"\w")
    run = f"[{w}{s}]"
    modifiers = f"(?:(?:public|private|protected|static|final|abstract){s}*)*"
    javascript = F.concat(
        F.lit(rf"()(?:function{s}+"), q, F.lit(rf"{s}*\([^)]*\){s}*\{{|(?:const|let|var){s}+"), q, F.lit(rf"{s}*={s}*\([^)]*\){s}*=>{s}*\{{)")
    )
    java = F.concat(F.lit(rf"(?<!{s})({s}*+){modifiers}{w}+{s}+"), q, F.lit(rf"{s}*\("))
    constructor = F.concat(F.lit(rf"(?<!{s})({s}*+)"), q, F.lit(rf"{s}*\("))
    cpp = F.concat(F.lit(rf"(?<!{run})({s}*+)(?:{run}*(?<={s}))?"), q, F.lit(rf"{s}*\("))
    inner = F.concat(F.lit("()"), q, F.lit(rf"{s}*\("))
    first = F.when(language == "javascript", javascript).when(language == "java", java).otherwise(cpp)
    second = F.when(language == "java", constructor).when(language == "javascript", javascript).otherwise(inner)
    return [first, second]


def add_comments(
    files: DataFrame, suggestions: DataFrame, content: str = "content", language: str = "language", key: str = "file_id"
) -> DataFrame:
    """Insert a block comment before the first header of each named function (Java, JavaScript, C++)."""
    lang = F.lower(F.col(language))
    joined = files.join(per_file(suggestions, "function_name", "comment", key=key), key, "left")

    def step(text: Column, item: Column) -> Column:
        first, second = _doc_patterns(lang, item["function_name"])
        pattern = F.when(F.call_function("rlike", text, first), first).otherwise(second)

        def block(pad: Column) -> Column:
            return F.concat(pad, F.lit("/**\n"), pad, F.lit(" * "), item["comment"], F.lit("\n"), pad, F.lit(" */\n"))

        return _insert(text, pattern, block)

    empty = F.filter(F.col("__items"), lambda i: F.lit(False))
    return joined.withColumn("new_content", F.aggregate(F.coalesce("__items", empty), F.col(content), step)).withColumn(
        "new_content", F.coalesce("new_content", F.col(content))
    ).drop("__items")


def add_annotations(
    files: DataFrame, suggestions: DataFrame, content: str = "content", language: str = "language", key: str = "file_id"
) -> DataFrame:
    """Insert annotation lines before the first header of each named Java method."""
    joined = files.join(per_file(suggestions, "function_name", "annotations", key=key), key, "left")

    def step(text: Column, item: Column) -> Column:
        pattern = _doc_patterns(F.lit("java"), item["function_name"])[0]
        return _insert(text, pattern, lambda pad: F.concat(F.array_join(F.transform(item["annotations"], lambda a: F.concat(pad, F.lit("@"), a)), "\n"), F.lit("\n")))

    return _java_fold(joined, step, content, language)


def _java_fold(joined: DataFrame, step, content: str, language: str, wanted: str = "java") -> DataFrame:
    folded = F.when((F.lower(F.col(language)) == wanted) & F.col("__items").isNotNull(), F.aggregate("__items", F.col(content), step))
    return joined.withColumn("new_content", F.coalesce(folded, F.col(content))).drop("__items")


def add_null_checks(
    files: DataFrame, suggestions: DataFrame, content: str = "content", language: str = "language", key: str = "file_id"
) -> DataFrame:
    """Wrap method calls on the named Java variables in a null test (also hits calls inside expressions: opt-in)."""
    joined = files.join(per_file(suggestions, "variable", key=key), key, "left")

    def step(text: Column, item: Column) -> Column:
        pattern = F.concat(F.lit("("), _quoted(item["variable"]), F.lit(rf"\.{WORD}+\([^)]*\))"))
        return F.regexp_replace(text, pattern, F.concat(F.lit("if ("), item["variable"], F.lit(" != null) { $1; }")))

    return _java_fold(joined, step, content, language)


def add_async(
    files: DataFrame, suggestions: DataFrame, content: str = "content", language: str = "language", key: str = "file_id"
) -> DataFrame:
    """Mark the named JavaScript functions ``async``."""
    joined = files.join(per_file(suggestions, "function_name", key=key), key, "left")

    def step(text: Column, item: Column) -> Column:
        s = rx(r"\s")
        pattern = F.concat(F.lit(f"(function{s}+"), _quoted(item["function_name"]), F.lit(rf"{s}*\([^)]*\))"))
        return F.regexp_replace(text, pattern, F.lit("async $1"))

    return _java_fold(joined, step, content, language, "javascript")


# --- reprocessing --------------------------------------------------------------------------------------------------

ENHANCE_RULES = ["bool_eq_true", "bool_eq_false", "break_assignment", "js_var_const_any", "js_doc", "java_doc", "tidy"]


#: Lines of a function from which it is reported.
LONG_FUNCTION = 50


def analysis_messages(n: Column) -> Column:
    """What the analysis says about one node of a Python file, in the order of the nodes."""
    lines = n["end_line"] - n["line"]
    function, branch = n["kind"] == "FunctionDef", n["kind"] == "If"
    return F.array_compact(
        F.array(
            F.when(branch & (n["name"] == "== True"), F.lit(BY_NAME["bool_eq_true"].message)),
            F.when(branch & (n["name"] == "== False"), F.lit(BY_NAME["bool_eq_false"].message)),
            F.when((n["kind"] == "For") & (n["name"] == "range"), F.lit("Verified efficient range loop")),
            F.when(function & (lines > LONG_FUNCTION), F.concat(F.lit("Long function detected: "), n["name"], F.lit(" ("), lines.cast("string"), F.lit(" lines)"))),
            F.when(function & n["returns"].isNull() & (n["n_args"] > 0), F.concat(F.lit("Function "), n["name"], F.lit(" could benefit from type hints"))),
        )
    )


def enhance(df: DataFrame, content: str, language: str = "language") -> DataFrame:
    """Add ``new_content`` and ``improvements`` of the enhancement rules: one message per hit, then what the analysis of Python says.

    Python that does not parse gets the layout rule only. The base text is parsed once: the other rules do not change which
    functions lack a docstring.
    """
    lang = F.lower(F.col(language))
    base = df.withColumn("__facts", facts_column(F.when(lang == "python", F.col(content))))
    broken = (lang == "python") & F.exists("__facts", lambda n: n["kind"] == "error")
    base = base.withColumn("__lang_of", F.when(broken, "").otherwise(lang))
    first = apply_rules(base, [r for r in ENHANCE_RULES if r != "tidy"], content, "__lang_of").withColumnsRenamed({"hits": "__hits", "new_content": "__c"})
    doc = python_docstrings(first, "__c", "__d", "__facts")
    last = apply_rules(doc, ["tidy"], "__d", "__lang_of")
    n = lambda name: F.coalesce(F.try_element_at("__hits", F.lit(name)), F.lit(0))
    none = F.expr("cast(array() as array<string>)")
    var = F.when(n("js_var_const_any") > 0, F.array(F.concat(F.lit("Replaced "), n("js_var_const_any").cast("string"), F.lit(" var declarations with const"))))
    messages = F.concat(
        F.array_repeat(F.lit(BY_NAME["break_assignment"].message), n("break_assignment")),
        F.transform("documented", lambda d: F.concat(F.lit("Added docstring placeholder for "), d)),
        F.coalesce(F.flatten(F.transform("__facts", analysis_messages)), none),
        F.coalesce(var, none),
        F.array_repeat(F.lit(BY_NAME["js_doc"].message), n("js_doc")),
        F.array_repeat(F.lit(BY_NAME["java_doc"].message), n("java_doc")),
        F.when(F.try_element_at("hits", F.lit("tidy")) > 0, F.array(F.lit(BY_NAME["tidy"].message))).otherwise(none),
    )
    return last.withColumn("improvements", messages).drop("__hits", "__c", "__d", "documented", "hits", "__facts", "__lang_of")


def reprocess(files: DataFrame) -> DataFrame:
    """Re-run the enhancement rules over stored files: text, status, message and scores change only when the text changed and
    an improvement was recorded. Adds ``updated``."""
    done = (F.col("status") == "completed") & (F.length(F.coalesce("refactored_content", F.lit(""))) > 0)
    df = files.withColumn("__base", F.when(done, F.col("refactored_content")).otherwise(F.col("original_content")))
    df = enhance(df, "__base")
    df = df.withColumn("updated", (F.size("improvements") > 0) & (F.col("new_content") != F.col("__base")))
    df = score(with_facts(df, "new_content", out="__new_facts"), "new_content", facts="__new_facts")
    info = F.concat(F.lit("Enhanced: "), F.array_join(F.slice("improvements", 1, 3), ", "))
    up = F.col("updated")
    overall = overall_score(F.col("complexity"), F.col("readability"), F.col("maintainability"))

    def pick(new: Column, old: str) -> Column:
        return F.when(up, new).otherwise(F.col(old))

    return df.withColumns(
        {
            "refactored_content": pick(F.col("new_content"), "refactored_content"),
            "error_message": pick(F.when(F.length("error_message") > 0, F.concat("error_message", F.lit(" | "), info)).otherwise(info), "error_message"),
            "status": F.when(up & (F.col("status") == "failed"), "completed").otherwise(F.col("status")),
            "complexity_score": pick(F.col("complexity"), "complexity_score"),
            "readability_score": pick(F.col("readability"), "readability_score"),
            "maintainability_score": pick(F.col("maintainability"), "maintainability_score"),
            "overall_quality_score": pick(overall, "overall_quality_score"),
        }
    ).select(*files.columns, "updated")
