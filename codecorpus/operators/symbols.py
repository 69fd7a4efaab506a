"""Symbol and function extraction by line patterns; Python symbols come from node facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.patterns import group, indent_of, is_blank, line_total, search, split_lines, strip, sub
from codecorpus.operators.nesting import dedent_ends
from codecorpus.operators.pyfacts import facts_column


def _line_rows(df: DataFrame, content: str, key: str, keep) -> DataFrame:
    """Numbered lines that can hold a symbol; the cheap test runs before any capturing pattern."""
    rows = df.select(key, F.posexplode(split_lines(F.col(content))).alias("pos", "line"))
    return rows.filter(keep(F.col("line"))).withColumn("line_no", F.col("pos") + 1)


def _symbol(line: Column, cond: Column, kind: Column, prefix: Column, name: Column, **extra: Column) -> Column:
    """Struct of one symbol; ``prefix`` is the text before the name, so its length is the 0-based column."""
    none = F.lit(None).cast("string")
    start = F.length(prefix)
    return F.when(
        cond,
        F.struct(
            name.alias("name"), kind.alias("type"), start.alias("col_start"), (start + F.length(name)).alias("col_end"),
            extra.get("visibility", none).alias("visibility"), extra.get("is_static", F.lit(False)).alias("is_static"),
            extra.get("is_arrow", F.lit(False)).alias("is_arrow"), extra.get("return_type", none).alias("return_type"),
        ),
    )


def _emit(rows: DataFrame, key: str, symbols: list[Column]) -> DataFrame:
    return rows.select(key, "line_no", F.inline(F.array_compact(F.array(*symbols)))).withColumnRenamed("line_no", "line_start").withColumn("line_end", F.col("line_start"))


def symbols_javascript(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """Function declarations, named arrow functions and classes per line."""
    rows = _line_rows(df, content, key, lambda s: s.contains("function") | s.contains("=>") | s.contains("class"))
    line = F.col("line")
    fn = r"^(.*?function\s+)(\w+)\s*\("
    arrow = r"^(.*?(?:const|let|var)\s+)(\w+)\s*=\s*\([^)]*\)\s*=>"
    cls = r"^(.*?class\s+)(\w+)"
    return _emit(rows, key, [
        _symbol(line, search(line, fn, "(?s)"), F.lit("function"), group(line, fn, 1, "(?s)"), group(line, fn, 2, "(?s)")),
        _symbol(line, search(line, arrow, "(?s)"), F.lit("function"), group(line, arrow, 1, "(?s)"), group(line, arrow, 2, "(?s)"), is_arrow=F.lit(True)),
        _symbol(line, search(line, cls, "(?s)"), F.lit("class"), group(line, cls, 1, "(?s)"), group(line, cls, 2, "(?s)")),
    ])


def symbols_java(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """Classes and methods with visibility, static flag and return type; class and interface lines hold no method."""
    rows = _line_rows(df, content, key, lambda s: s.contains("class") | s.contains("("))
    line = F.col("line")
    cls = r"^(.*?class\s+)(\w+)"
    method = r"^(.*?(public|private|protected)?\s*(static)?\s*(\w+)\s+)(\w+)\s*\("
    get = lambda i: group(line, method, i, "(?s)")
    is_method = search(line, method, "(?s)") & ~search(line, r"\b(class|interface)\b")
    return _emit(rows, key, [
        _symbol(line, search(line, cls, "(?s)"), F.lit("class"), group(line, cls, 1, "(?s)"), group(line, cls, 2, "(?s)")),
        _symbol(line, is_method, F.lit("method"), get(1), get(5),
                visibility=F.when(get(2) == "", "package").otherwise(get(2)), is_static=get(3) != "", return_type=get(4)),
    ])


def symbols_cpp(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """Functions with a body on the line, classes and structs, macros."""
    rows = _line_rows(df, content, key, lambda s: s.contains("{") | s.contains("class") | s.contains("struct") | s.contains("#define"))
    line = F.col("line")
    fn = r"^(.*?(\w+)\s+)(\w+)\s*\([^)]*\)\s*\{"
    cls = r"^(.*?(class|struct)\s+)(\w+)"
    macro = r"^(.*?#define\s+)(\w+)"
    is_fn = search(line, fn, "(?s)") & ~search(line, r"\b(if|while|for|switch)\b")
    return _emit(rows, key, [
        _symbol(line, is_fn, F.lit("function"), group(line, fn, 1, "(?s)"), group(line, fn, 3, "(?s)"), return_type=group(line, fn, 2, "(?s)")),
        _symbol(line, search(line, cls, "(?s)"), group(line, cls, 2, "(?s)"), group(line, cls, 1, "(?s)"), group(line, cls, 3, "(?s)")),
        _symbol(line, search(line, macro, "(?s)"), F.lit("macro"), group(line, macro, 1, "(?s)"), group(line, macro, 2, "(?s)")),
    ])


def symbols_python(df: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """Classes and functions with enclosing class, arguments, docstring and return annotation."""
    facts = facts_column(F.col(content))
    picked = df.select(key, F.inline(facts)).filter(F.col("kind").isin("ClassDef", "FunctionDef", "AsyncFunctionDef"))
    is_class = F.col("kind") == "ClassDef"
    return picked.select(
        key, "name", F.when(is_class, "class").otherwise("function").alias("type"),
        F.col("line").alias("line_start"), F.col("end_line").alias("line_end"),
        F.col("col").alias("col_start"), F.col("end_col").alias("col_end"),
        F.when(~is_class, F.col("owner")).alias("parent"), F.col("args").alias("parameters"),
        F.col("doc").alias("docstring"), F.col("returns").alias("return_type"),
    )


# --- function headers per version ----------------------------------------------------------------------------------

_PY = r"^\s*(def|async def)\s+(\w+)\s*\(([^)]*)\)\s*:"
_JS = [
    r"^\s*function\s+(\w+)\s*\(([^)]*)\)",
    r"^\s*const\s+(\w+)\s*=\s*\(([^)]*)\)\s*=>",
    r"^\s*(\w+)\s*:\s*function\s*\(([^)]*)\)",
    r"^\s*async\s+function\s+(\w+)\s*\(([^)]*)\)",
]
_JAVA = r"^\s*(public|private|protected)?\s*(static)?\s*(\w+)\s+(\w+)\s*\(([^)]*)\)"
_CPP = r"^\s*(\w+(?:\s*\*)?\s+)?(\w+)\s*\(([^)]*)\)\s*\{?"


#: Separates the parts of a header; a line that begins with it is no header.
_MARK = "\x01"


def _headers(line: Column, lang: Column) -> Column:
    """The line's header as an array of one struct (name, kind, params, signature), empty for other lines.

    One match of one pattern writes all parts of a header, parameters last. They are taken apart once, in the array, since
    each further group would be a match of its own.
    """

    def made(pattern: str, name: str, kind: str, first: str, rest: str, params: str) -> Column:
        return sub(line, f"{pattern}(?s:.*)", _MARK + _MARK.join([name, kind, first, rest, params]))

    javascript = "^(?:" + "|".join(p.removeprefix("^") for p in _JS) + ")"
    names, params = "$1$3$5$7", "$2$4$6$8"
    hit = (
        F.when(line.startswith(_MARK), None)
        .when(lang == "python", made(_PY, "$2", "$1", "$1 ", "$2", "$3"))
        .when(lang == "javascript", made(javascript, names, "function", "function ", names, params))
        .when(lang == "java", made(_JAVA, "$4", "method", "$1", " $2 $3 $4", "$5"))
        .when(lang.isin("cpp", "c") & ~strip(line).startswith("//"), made(_CPP, "$2", "function", "$1", "$2", "$3"))
    )
    first = F.when(lang == "java", "package").when(lang.isin("cpp", "c"), "void").otherwise("")
    parts = F.transform(F.filter(F.array(hit), lambda h: h.startswith(_MARK)), lambda h: F.split(h, _MARK, 6))
    found = F.filter(parts, lambda p: ~(lang.isin("cpp", "c") & p[1].isin("if", "for", "while", "switch", "return")))
    return F.transform(found, lambda p: F.struct(
        p[1].alias("name"), p[2].alias("kind"), p[5].alias("params"),
        F.concat(F.when(p[3] == "", first).otherwise(p[3]), p[4], F.lit("("), p[5], F.lit(")")).alias("signature"),
    ))


def extract_functions(df: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """One row per function header of every version, all other input columns kept except the text.

    ``end_line`` is known for Python only (first later non-blank line at the same or a smaller indent); elsewhere it is the
    header line.
    """
    text, lang = F.col(content), F.lower(F.col(language))
    keep = [c for c in df.columns if c != content]
    numbered = F.transform(
        split_lines(text),
        lambda s, i: F.struct(i.alias("i"), indent_of(s).alias("indent"), is_blank(s).alias("blank"), search(s, _PY).alias("head")),
    )
    ends = F.map_from_entries(F.when(lang == "python", dedent_ends(numbered, line_total(text))).otherwise(F.expr("cast(array() as array<struct<i:int,stop:int>>)")))
    rows = df.withColumn("__e", ends).select(*keep, "__e", F.posexplode(split_lines(text)).alias("__pos", "__line"))
    # A generator over the header itself, not a filter on it, so the patterns run once per line.
    rows = rows.filter(F.col("__line").contains("(")).select(*keep, "__e", "__pos", F.inline(_headers(F.col("__line"), lang)))
    return rows.select(
        *keep, "name", "kind", "params", "signature", (F.col("__pos") + 1).alias("start_line"),
        F.coalesce(F.try_element_at("__e", F.col("__pos")), F.col("__pos") + 1).alias("end_line"),
    )
