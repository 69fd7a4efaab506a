"""Deeply nested conditionals: detection, suggestions, enclosing functions and before/after comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.functions.patterns import (
    count_of, first_match, indent_of, is_blank, line_total, ratio, rx, search, split_lines, strip, WORD,
)
from codecorpus.operators.metrics import cpp_scores, generic_scores, java_scores, javascript_scores, python_scores
from codecorpus.operators.pyfacts import facts_column

STRETCHES = "array<struct<line:int,upto:int,first:int,depth:int>>"
FINDINGS = "array<struct<line_start:int,line_end:int,depth:int,severity:string>>"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


#: Items that a fold gathers before it files them away.
BUFFER = 256


def _gathered(acc: Column, items: Column) -> dict[str, Column]:
    """The fields ``out`` and ``buf`` of a fold after adding ``items``. A fold copies an array to extend it, so items go to a short
    buffer, and only full buffers are added to ``out``: the cost stays in proportion to the items."""
    full = F.size(acc["buf"]) >= BUFFER
    return {
        "out": F.when(full, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"]),
        "buf": F.when(full, items).otherwise(F.concat(acc["buf"], items)),
    }


def _all_gathered(acc: Column, *more: Column) -> Column:
    return F.flatten(F.concat(acc["out"], F.array(acc["buf"]), *[F.array(m) for m in more]))


def indent_findings(text: Column) -> Column:
    """Generic detector: a stack of ``if`` lines ordered by indentation; a finding wherever it holds three or more.

    A fold over the lines that contain ``if`` only; severity is always medium.
    """
    numbered = F.transform(split_lines(text), lambda s, i: F.struct((i + 1).alias("line"), indent_of(s).alias("indent"), s.alias("text")))
    heads = F.filter(numbered, lambda x: x["text"].rlike(f"(?<!{WORD})if(?!{WORD})"))
    zero = F.struct(_empty("array<struct<line:int,indent:int>>").alias("stack"), _empty(f"array<{FINDINGS}>").alias("out"), _empty(FINDINGS).alias("buf"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.filter(acc["stack"], lambda s: s["indent"] < x["indent"])
        stack = F.concat(kept, F.array(F.struct(x["line"].alias("line"), x["indent"].alias("indent"))))
        finding = F.struct(stack[0]["line"].alias("line_start"), x["line"].alias("line_end"), F.size(stack).alias("depth"),
                           F.lit("medium").alias("severity"))
        new = _gathered(acc, F.array(finding))
        return F.struct(stack.alias("stack"), *[F.when(F.size(kept) >= 2, c).otherwise(acc[k]).alias(k) for k, c in new.items()])

    return F.aggregate(heads, zero, step, lambda acc: _all_gathered(acc))


def brace_findings(text: Column) -> Column:
    """Brace detector (Java, JavaScript): push on ``if (`` with the depth after the line, drop deeper entries after a ``}``;
    every line on which the stack holds three or more is a finding.

    The fold visits only lines with a brace or an ``if (`` and records stretches of lines with an unchanged stack, which are
    expanded afterwards.
    """
    numbered = F.transform(
        split_lines(text),
        lambda s, i: F.struct(
            (i + 1).alias("line"), (count_of(s, "{") - count_of(s, "}")).alias("delta"), s.contains("}").alias("close"),
            s.rlike(rx(r"(?<!\w)if\s*\(")).alias("head"), s.contains("{").alias("open"),
        ),
    )
    marked = F.filter(numbered, lambda x: x["open"] | x["close"] | x["head"])
    # Entries of one depth are one: depth, how many they are, and the first one's line. Depths ascend, so the stack is as long as the text nests deep.
    level = "array<struct<depth:int,n:int,line:int>>"
    zero = F.struct(
        F.lit(0).alias("depth"),
        _empty(level).alias("stack"),
        F.lit(0).alias("held"),
        _empty(f"array<{STRETCHES}>").alias("out"),
        _empty(STRETCHES).alias("buf"),
        F.lit(0).alias("last"),
    )

    def stretch(first: Column, held: Column, begin: Column, end: Column) -> Column:
        return F.struct(begin.alias("line"), end.alias("upto"), first.alias("first"), held.alias("depth"))

    def entry(depth: Column, n: Column, line: Column) -> Column:
        return F.array(F.struct(depth.alias("depth"), n.alias("n"), line.alias("line")))

    def pushed(stack: Column, depth: Column, line: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        more = F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), entry(depth, top["n"] + 1, top["line"]))
        return F.when(top["depth"] == depth, more).otherwise(F.concat(stack, entry(depth, F.lit(1), line)))

    def step(acc: Column, x: Column) -> Column:
        # Lines between the previous marked line and this one keep the previous stack.
        first = acc["stack"][0]["line"]
        gap = (acc["held"] >= 3) & (x["line"] - acc["last"] > 1)
        before = F.when(gap, F.array(stretch(first, acc["held"], acc["last"] + 1, x["line"] - 1))).otherwise(_empty(STRETCHES))
        depth = acc["depth"] + x["delta"]
        held = acc["held"] + x["head"].cast("int")
        own = F.when(held >= 3, F.array(stretch(first, held, x["line"], x["line"]))).otherwise(_empty(STRETCHES))
        new = _gathered(acc, F.concat(before, own))
        deep = F.exists(acc["stack"], lambda s: s["depth"] > depth) & x["close"]
        kept = F.when(deep, F.filter(acc["stack"], lambda s: s["depth"] <= depth)).otherwise(acc["stack"])
        gone = F.when(deep, F.aggregate(acc["stack"], F.lit(0), lambda n, s: n + F.when(s["depth"] > depth, s["n"]).otherwise(0))).otherwise(0)
        return F.struct(
            depth.alias("depth"), F.when(x["head"], pushed(kept, depth, x["line"])).otherwise(kept).alias("stack"), (held - gone).alias("held"),
            *[c.alias(k) for k, c in new.items()], x["line"].alias("last"),
        )

    def finish(acc: Column) -> Column:
        tail = (acc["held"] >= 3) & (line_total(text) > acc["last"])
        rest = F.when(tail, F.array(stretch(acc["stack"][0]["line"], acc["held"], acc["last"] + 1, line_total(text)))).otherwise(_empty(STRETCHES))
        return _all_gathered(acc, rest)

    stretches = F.aggregate(marked, zero, step, finish)
    return F.flatten(
        F.transform(
            stretches,
            lambda s: F.transform(
                F.sequence(s["line"], s["upto"]),
                lambda n: F.struct(
                    s["first"].alias("line_start"), n.alias("line_end"), s["depth"].alias("depth"),
                    F.when(s["depth"] >= 4, "high").otherwise("medium").alias("severity"),
                ),
            ),
        )
    )


def python_findings(facts: Column) -> Column:
    """Every ``if`` whose chain of nested ``if`` nodes is three or longer; an ``elif`` is an ``if`` inside the else branch."""
    deep = F.filter(facts, lambda n: (n["kind"] == "If") & (n["if_height"] >= 3))
    return F.transform(
        deep,
        lambda n: F.struct(
            n["line"].alias("line_start"), n["end_line"].alias("line_end"), n["if_height"].alias("depth"),
            F.when(n["if_height"] >= 4, "high").otherwise("medium").alias("severity"),
        ),
    )


def findings_column(text: Column, language: Column, facts: Column) -> Column:
    """Findings by lower-cased language; Python reads the facts, unparsable Python has none."""
    lang = F.lower(language)
    return (
        F.when(lang == "python", python_findings(facts))
        .when(lang.isin("java", "javascript"), brace_findings(text))
        .otherwise(indent_findings(text))
    )


def nested_ifs_indent(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    return df.select(key, F.inline(indent_findings(F.col(content))))


def nested_ifs_brace(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    return df.select(key, F.inline(brace_findings(F.col(content))))


def nested_ifs_python(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    return df.select(key, F.inline(python_findings(facts_column(F.col(content)))))


def nested_ifs(df: DataFrame, content: str = "content", language: str = "language", key: str = "file_id") -> DataFrame:
    """Findings of every file by its language: (file, language, line_start, line_end, depth, severity)."""
    df = df.withColumn("__f", facts_column(F.when(F.lower(F.col(language)) == "python", F.col(content))))
    return df.select(key, language, F.inline(findings_column(F.col(content), F.col(language), F.col("__f"))))


def _by_language(language: Column, table: dict[str, tuple], pick) -> Column:
    lang = F.lower(language)
    return first_match([(lang == k, pick(v)) for k, v in table.items() if k], pick(table[""]))


def nested_if_suggestions(findings: DataFrame, language: str = "language") -> DataFrame:
    """Add type, suggestion text and benefits per finding (fixed texts, so a CASE instead of a join)."""
    lang = F.col(language)
    return findings.withColumns(
        {
            "suggestion_type": _by_language(lang, dims.NESTED_SUGGESTIONS, lambda v: F.lit(v[0])),
            "suggestion": _by_language(lang, dims.NESTED_SUGGESTIONS, lambda v: F.lit(v[1])),
            "benefits": _by_language(lang, dims.NESTED_SUGGESTIONS, lambda v: F.array(*map(F.lit, v[2]))),
        }
    )


def refactor_candidates(findings: DataFrame, language: str = "language", min_depth: int = 4) -> DataFrame:
    """Findings deep enough to rewrite, with pattern, confidence and description."""
    lang = F.col(language)
    return findings.filter(F.col("depth") >= min_depth).withColumns(
        {
            "pattern": _by_language(lang, dims.REFACTOR_CANDIDATES, lambda v: F.lit(v[0])),
            "confidence": _by_language(lang, dims.REFACTOR_CANDIDATES, lambda v: F.lit(v[1])),
            "description": _by_language(lang, dims.REFACTOR_CANDIDATES, lambda v: F.lit(v[2])),
        }
    )


def dedent_ends(numbered: Column, total: Column) -> Column:
    """For header lines of an array of (i, indent, blank, head): (i, end) with ``end`` the number of lines before the first
    later non-blank line at the same or a smaller indent. A stack of open headers makes this one linear fold."""
    ends = "array<struct<i:int,stop:int>>"
    zero = F.struct(_empty("array<struct<i:int,indent:int>>").alias("open"), _empty(f"array<{ends}>").alias("out"), _empty(ends).alias("buf"))

    def step(acc: Column, x: Column) -> Column:
        closing = F.exists(acc["open"], lambda s: s["indent"] >= x["indent"])
        closed = F.transform(F.filter(acc["open"], lambda s: s["indent"] >= x["indent"]), lambda s: F.struct(s["i"].alias("i"), x["i"].alias("stop")))
        kept = F.when(closing, F.filter(acc["open"], lambda s: s["indent"] < x["indent"])).otherwise(acc["open"])
        return F.struct(
            F.when(x["head"], F.concat(kept, F.array(F.struct(x["i"].alias("i"), x["indent"].alias("indent"))))).otherwise(kept).alias("open"),
            *[F.when(closing, c).otherwise(acc[k]).alias(k) for k, c in _gathered(acc, closed).items()],
        )

    return F.aggregate(
        F.filter(numbered, lambda x: ~x["blank"]), zero, step,
        lambda acc: _all_gathered(acc, F.transform(acc["open"], lambda s: F.struct(s["i"].alias("i"), total.alias("stop")))),
    )


SPANS = "array<struct<line:int,stop:int>>"


def brace_spans(text: Column, language: Column) -> Column:
    """(line, stop) of each Java or JavaScript header in the order of lines: the first line from there on with a ``}`` after which as many braces
    are open as before the header, else the last line.

    Headers and closing lines are sorted by their level and then from the last line to the first, so one fold meets a level's closing line
    before the headers it closes.
    """
    java_head = lambda s: search(strip(s), r"(public|private|protected).*\w+\s*\([^)]*\)\s*\{?", "(?s)")
    js_head = lambda s: (
        strip(s).startswith("function ") | s.contains("=>") | search(strip(s), r"\w+\s*\([^)]*\)\s*\{")
    )
    numbered = F.transform(
        split_lines(text),
        lambda s, i: F.struct(
            (i + 1).alias("line"), (count_of(s, "{") - count_of(s, "}")).alias("delta"), s.contains("}").alias("close"),
            F.when(F.lower(language) == "java", java_head(s)).otherwise(js_head(s)).alias("head"),
        ),
    )
    marked = F.filter(numbered, lambda x: x["head"] | x["close"] | (x["delta"] != 0))
    event = "array<struct<level:int,back:int,head:boolean>>"
    zero = F.struct(F.lit(0).alias("depth"), _empty(f"array<{event}>").alias("out"), _empty(event).alias("buf"))

    def number(acc: Column, x: Column) -> Column:
        after = acc["depth"] + x["delta"]
        one = lambda level, head: F.struct(level.alias("level"), (-x["line"]).alias("back"), F.lit(head).alias("head"))
        items = F.array_compact(F.array(F.when(x["head"], one(acc["depth"], True)), F.when(x["close"], one(after, False))))
        return F.struct(after.alias("depth"), *[c.alias(k) for k, c in _gathered(acc, items).items()])

    events = F.array_sort(F.aggregate(marked, zero, number, lambda acc: _all_gathered(acc)))
    none = F.lit(None).cast("int")
    begin = F.struct(none.alias("level"), none.alias("next"), _empty(f"array<{SPANS}>").alias("out"), _empty(SPANS).alias("buf"))

    def close(acc: Column, x: Column) -> Column:
        line = -x["back"]
        after = F.when(acc["level"] == x["level"], acc["next"])
        new = _gathered(acc, F.array(F.struct(line.alias("line"), F.coalesce(after, line_total(text)).alias("stop"))))
        return F.struct(
            x["level"].alias("level"), F.when(x["head"], after).otherwise(line).alias("next"), *[F.when(x["head"], c).otherwise(acc[k]).alias(k) for k, c in new.items()]
        )

    return F.array_sort(F.aggregate(events, begin, close, lambda acc: _all_gathered(acc)))


def function_spans(text: Column, language: Column) -> Column:
    """(line, stop) of each function header, in the order of lines; none for languages without a rule."""
    lang = F.lower(language)
    numbered = F.transform(
        split_lines(text),
        lambda s, i: F.struct(i.alias("i"), indent_of(s).alias("indent"), is_blank(s).alias("blank"), strip(s).startswith("def ").alias("head")),
    )
    python = F.array_sort(F.transform(dedent_ends(numbered, line_total(text)), lambda e: F.struct((e["i"] + 1).cast("int").alias("line"), e["stop"].cast("int").alias("stop"))))
    return F.when(lang == "python", python).when(lang.isin("java", "javascript"), brace_spans(text, language)).otherwise(_empty(SPANS))


def nearest(spans: Column, lines: Column) -> Column:
    """For each of an array of lines the place (from 0) of the last span that begins at or above it, null if none does; one fold over both, sorted."""
    both = F.array_sort(
        F.concat(
            F.transform(spans, lambda s, i: F.struct(s["line"].alias("line"), F.lit(0).alias("kind"), i.alias("place"))),
            F.transform(lines, lambda n, i: F.struct(n.alias("line"), F.lit(1).alias("kind"), i.alias("place"))),
        )
    )
    pair = "array<struct<place:int,near:int>>"
    zero = F.struct(F.lit(None).cast("int").alias("near"), _empty(f"array<{pair}>").alias("out"), _empty(pair).alias("buf"))

    def step(acc: Column, x: Column) -> Column:
        new = _gathered(acc, F.array(F.struct(x["place"].alias("place"), acc["near"].alias("near"))))
        asks = x["kind"] == 1
        return F.struct(F.when(asks, acc["near"]).otherwise(x["place"]).alias("near"), *[F.when(asks, c).otherwise(acc[k]).alias(k) for k, c in new.items()])

    found = F.aggregate(both, zero, step, lambda acc: _all_gathered(acc))
    return F.transform(F.array_sort(found), lambda f: f["near"])


def _enclosed(rows: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    """One row for each of the findings in ``__n``, with the span among ``__s`` that ``__near`` names."""
    rows = rows.withColumn("__near", nearest(F.col("__s"), F.transform("__n", lambda f: f["line_start"])))
    near = lambda i: F.get(F.col("__s"), F.get(F.col("__near"), i))
    found = F.transform("__n", lambda f, i: F.struct(*[f[c].alias(c) for c in fields], near(i)["line"].alias("function_start"), near(i)["stop"].alias("function_end")))
    return rows.select(*keep, F.inline(found))


def nested_ifs_in_functions(df: DataFrame, content: str = "content", language: str = "language", key: str = "file_id") -> DataFrame:
    """Findings of every file with ``function_start`` and ``function_end``, all within the file's row: nothing is shuffled."""
    text, lang = F.col(content), F.col(language)
    df = df.withColumn("__f", facts_column(F.when(F.lower(lang) == "python", text)))
    df = df.withColumns({"__n": findings_column(text, lang, F.col("__f")), "__s": function_spans(text, lang)})
    return _enclosed(df, ["line_start", "line_end", "depth", "severity"], key, language)


def enclosing_function(
    findings: DataFrame, files: DataFrame, content: str = "content", language: str = "language", key: str = "file_id"
) -> DataFrame:
    """Add ``function_start`` and ``function_end`` (1-based) to a table of findings: nearest header at or above ``line_start``; the end by dedent
    (Python) or where the braces opened since the header balance again. NULL when there is no header.

    The spans of a file, never its text, meet its findings; both are compared within the row.
    """
    spans = files.select(key, function_spans(F.col(content), F.col(language)).alias("__s"))
    fields = [c for c in findings.columns if c != key]
    listed = findings.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("__n"))
    met = listed.join(spans, key, "left").withColumn("__s", F.coalesce("__s", _empty(SPANS)))
    return _enclosed(met, fields, key)


def nested_if_delta(
    df: DataFrame, before: str = "original_code", after: str = "refactored_code", language: str = "language"
) -> DataFrame:
    """Counts, maximum depth, complexity, readability and lines of both versions of a row."""
    lang = F.lower(F.col(language))
    sides = {"before": F.col(before), "after": F.col(after)}
    keep = df.columns
    df = df.withColumns({f"__p_{k}": facts_column(F.when(lang == "python", text)) for k, text in sides.items()})
    measured = {}
    for k, text in sides.items():
        facts = F.col(f"__p_{k}")
        scores = (
            F.when(lang == "python", python_scores(text, facts))
            .when(lang == "javascript", javascript_scores(text))
            .when(lang == "java", java_scores(text))
            .when(lang.isin("cpp", "c"), cpp_scores(text))
            .otherwise(generic_scores(text))
        )
        measured |= {f"__n_{k}": findings_column(text, F.col(language), facts), f"__s_{k}": scores}
    df = df.withColumns(measured)
    out = []
    for k, text in sides.items():
        depths = F.array_max(F.transform(f"__n_{k}", lambda n: n["depth"]))
        out += [
            F.size(f"__n_{k}").alias(f"nested_ifs_{k}"), F.coalesce(depths, F.lit(0)).alias(f"max_depth_{k}"),
            F.col(f"__s_{k}.complexity").alias(f"complexity_{k}"), F.col(f"__s_{k}.readability").alias(f"readability_{k}"),
            line_total(text).alias(f"lines_{k}"),
        ]
    return df.select(*keep, *out)


def nested_if_summary(delta: DataFrame, *by: str) -> DataFrame:
    """Patterns found and left, mean depth reduction and complexity gain per group."""
    return delta.groupBy(*by).agg(
        F.count("*").alias("pairs"),
        F.sum("nested_ifs_before").alias("patterns_before"),
        F.sum("nested_ifs_after").alias("patterns_after"),
        F.avg(F.col("max_depth_before") - F.col("max_depth_after")).alias("avg_depth_reduction"),
        F.avg(F.col("complexity_after") - F.col("complexity_before")).alias("avg_complexity_gain"),
        ratio(F.sum("nested_ifs_before") - F.sum("nested_ifs_after"), F.sum("nested_ifs_before"), 100).alias("fewer_pct"),
    )
