"""Language detection and name classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.functions.patterns import (
    count_re, file_extension, file_name, first_match, literal_of, search, split_lines, strip,
)


def _lookup(df: DataFrame, groups: dict[str, str], path: str, out: str, keep_ext: str | None = None) -> DataFrame:
    """Join the path's extension to a constant extension table (about a hundred rows, so the broadcast is bounded)."""
    ext = keep_ext or "__ext"
    dim = dims.extension_dim(df.sparkSession, groups).withColumnsRenamed({"extension": ext, "ext_language": out})
    df = df.withColumn(ext, file_extension(F.col(path))).join(F.broadcast(dim), ext, "left")
    return df if keep_ext else df.drop(ext)


def language_by_ext(df: DataFrame, path: str = "path", out: str = "language") -> DataFrame:
    """Display name by extension, NULL when the extension is unknown."""
    return _lookup(df, dims.DISPLAY_EXTENSIONS, path, out)


def _head(content: Column, lines: int) -> Column:
    return F.substring_index(content, "\n", lines)


def content_scores(content: Column, lines: int = 50) -> Column:
    """Array of (hits, -order, language): pattern hits over the first lines, one entry per candidate language.

    The lambda keeps the few dozen patterns out of generated code, whose methods have a size limit.
    """

    def score(head: Column) -> Column:
        sample, low = head["sample"], head["low"]
        entries = []
        for order, (language, patterns) in enumerate(dims.CONTENT_PATTERNS.items()):
            hits = F.lit(0)
            for p in patterns:
                # A plain substring test rules out most patterns before the regex engine sees the text.
                present = F.contains(low, F.lit(literal_of(p)))
                hits = hits + F.when(present, count_re(sample, p, "(?idmu)")).otherwise(0)
            entries.append(F.struct(hits.alias("hits"), F.lit(-order).alias("rank"), F.lit(language).alias("language")))
        return F.array_max(F.array(*entries))

    sample = _head(content, lines)
    return F.transform(F.array(F.struct(sample.alias("sample"), F.lower(sample).alias("low"))), score)


def content_language(content: Column) -> Column:
    """Language with most hits, earlier declaration wins ties, NULL without any hit."""
    best = F.filter(content_scores(content), lambda b: b["hits"] > 0)
    return F.get(F.transform(best, lambda b: b["language"]), F.lit(0))


def language_by_content(df: DataFrame, content: str = "content", out: str = "language") -> DataFrame:
    return df.withColumn(out, content_language(F.col(content)))


def _strong_match(content: Column, language: Column) -> Column:
    """At least two different patterns of ``language`` occur in the first 30 lines."""

    def strong(sample: Column) -> Column:
        cases = []
        for name, patterns in dims.CONTENT_PATTERNS.items():
            hit = F.lit(0)
            for p in patterns:
                hit = hit + search(sample, p, "(?idmu)").cast("int")
            cases.append((language == name, hit >= 2))
        return first_match(cases, F.lit(False))

    return F.exists(F.array(_head(content, 30)), strong)


def detect_language(df: DataFrame, path: str = "path", content: str = "content", out: str = "language") -> DataFrame:
    """Extension first; ambiguous extensions may be overridden by content; then content, file name, ``Unknown``."""
    text, name = F.col(content), file_name(F.lower(F.col(path)))
    df = _lookup(df, dims.DISPLAY_EXTENSIONS, path, "__by_ext", "__ext")
    needs_content = F.col("__by_ext").isNull() | F.col("__ext").isin(".h", ".m", ".s")
    df = df.withColumn("__by_content", F.when(needs_content & (F.length(text) > 0), content_language(text)))
    override = (
        F.col("__by_content").isNotNull()
        & (F.col("__by_content") != F.col("__by_ext"))
        & _strong_match(text, F.col("__by_content"))
    )
    return df.withColumn(
        out,
        F.when(F.col("__by_ext").isNotNull(), F.when(override, F.col("__by_content")).otherwise(F.col("__by_ext")))
        .when(F.col("__by_content").isNotNull(), F.col("__by_content"))
        .when(name.contains("makefile"), "Makefile")
        .when(name.contains("dockerfile"), "Dockerfile")
        .when(name.endswith("rc") | name.startswith("."), "Configuration")
        .otherwise("Unknown"),
    ).drop("__ext", "__by_ext", "__by_content")


def scan_language(df: DataFrame, path: str = "path", content: str = "content", out: str = "language") -> DataFrame:
    """Lower-case scanner language: binary flag, extension, special file names, shebang, ``unknown``."""
    name = file_name(F.lower(F.col(path)))
    first = strip(F.substring_index(F.col(content), "\n", 1))
    df = _lookup(df, dims.SCAN_EXTENSIONS, path, "__by_ext", "__ext")
    shebang = F.col("__ext").isin("", ".txt") & first.startswith("#!")
    found = (
        F.when(F.col("__by_ext").isNotNull(), F.col("__by_ext"))
        .when(name.isin("makefile", "gnumakefile") | name.startswith("makefile."), "makefile")
        .when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile")
        .when(name.isin(".gitignore", ".dockerignore"), "gitignore")
        .when(shebang & first.contains("python"), "python")
        .when(shebang & (first.contains("node") | first.contains("javascript")), "javascript")
        .when(shebang & first.contains("sh"), "shell")
        .otherwise("unknown")
    )
    if "is_binary" in df.columns:
        found = F.when(F.col("is_binary"), "binary").otherwise(found)
    return df.withColumn(out, found).drop("__ext", "__by_ext")


def adapter_language(df: DataFrame, path: str = "path", content: str = "content", out: str = "adapter") -> DataFrame:
    """Adapter by extension, else by keywords in the text, else NULL."""
    text = F.col(content)
    df = _lookup(df, dims.ADAPTER_EXTENSIONS, path, "__by_ext")
    return df.withColumn(
        out,
        F.when(F.col("__by_ext").isNotNull(), F.col("__by_ext"))
        .when(text.contains("def ") & text.contains("import "), "python")
        .when(text.contains("function ") | text.contains("const ") | text.contains("let "), "javascript")
        .when(text.contains("public class ") | text.contains("private "), "java")
        .when(text.contains("#include") | text.contains("std::"), "cpp"),
    ).drop("__by_ext")


def jsx_override(
    df: DataFrame, path: str = "path", content: str = "content", language: str = "language"
) -> DataFrame:
    """JavaScript becomes JSX when the path has ``.jsx`` or the first 1,000 characters mention ``jsx``."""
    is_jsx = F.lower(F.col(path)).contains(".jsx") | F.lower(F.substring(F.col(content), 1, 1000)).contains("jsx")
    return df.withColumn(language, F.when((F.col(language) == "JavaScript") & is_jsx, "JSX").otherwise(F.col(language)))


def prompt_language(language: Column) -> Column:
    """Name used in prompts."""
    return first_match([(language == k, v) for k, v in dims.PROMPT_NAMES.items()], language)


def binary_flag(path: Column, content: Column) -> Column:
    """Binary by extension, a NUL byte in the first 1,024 bytes, or fewer than 70 % printable bytes there.

    The MIME-table step is left out: its answer depends on the machine.
    """
    head = F.hex(F.substring(content, 1, 1024))
    size = F.length(head) / 2
    # Hex pairs are consumed two digits at a time, so a match never starts inside a byte.
    printable = F.length(F.regexp_replace(head, "(?:(0[9AD]|[2-6][0-9A-F]|7[0-9A-E])|..)", "$1")) / 2
    nul = head.rlike("^(?:(?!00)..)*+00")
    return (
        file_extension(path).isin(dims.BINARY_EXTENSIONS)
        | F.coalesce(nul, F.lit(False))
        | F.coalesce((size > 0) & (printable / size < 0.7), F.lit(False))
    )


def is_binary(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return df.withColumn("is_binary", binary_flag(F.col(path), F.col(content)))


def _cased(col: Column) -> Column:
    return F.lower(col) != F.upper(col)


def valid_name(name: Column, language: Column) -> Column:
    """Identifier check: letters and digits once ``_`` and ``-`` are removed; snake for Python, camel for JS and Java."""
    core = F.translate(name, "_-", "")
    first = F.substring(name, 1, 1)
    return (
        core.rlike(r"^[\p{L}\p{N}]+$")
        & first_match(
            [
                (language == "python", ((name == F.lower(name)) & _cased(name)) | name.contains("_")),
                (language.isin("javascript", "java"),
                 (first == F.lower(first)) & _cased(first) & ~name.contains("_")),
            ],
            F.lit(True),
        )
    )


def naming_style(name: Column) -> Column:
    """``snake``: has ``_`` and no upper case; ``camel``: no ``_`` and an upper-case letter after the first; else ``other``."""
    tail = F.substring(name, 2, 1 << 30)
    return first_match(
        [
            (name.contains("_") & (name == F.lower(name)) & _cased(name), "snake"),
            (~name.contains("_") & (tail != F.lower(tail)), "camel"),
        ],
        "other",
    )


def first_lines(content: Column, n: int) -> Column:
    return F.slice(split_lines(content), 1, n)
