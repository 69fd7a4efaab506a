"""Projections, filters and routing decisions over file tables. All are narrow, codegen-friendly column expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.functions.patterns import file_extension, file_name, first_match, is_blank


def _parents(path: Column) -> Column:
    """Directory names above the file."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def skip_dirs(df: DataFrame, dirs: list[str] = dims.SKIP_DIRECTORIES, path: str = "relative_path") -> DataFrame:
    """Drop files below a skipped directory; the file name itself is not tested."""
    return df.filter(~F.arrays_overlap(_parents(F.col(path)), F.array(*map(F.lit, dirs))))


def glob_regex(pattern: str) -> str:
    """Shell glob to an anchored regex; ``*`` also crosses directory separators."""
    return fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$").replace("(?>.*?", "(?:.*?")


def glob_filter(
    df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, path: str = "relative_path"
) -> DataFrame:
    """Keep paths matching any include glob (all when none is given) and no exclude glob."""
    if exclude:
        df = df.filter(~F.col(path).rlike("|".join(f"^(?:{glob_regex(p)})" for p in exclude)))
    if include:
        df = df.filter(F.col(path).rlike("|".join(f"^(?:{glob_regex(p)})" for p in include)))
    return df


def code_files(
    df: DataFrame,
    extensions: list[str] = dims.CODE_EXTENSIONS,
    build_dirs: list[str] = dims.BUILD_DIRECTORIES,
    path: str = "relative_path",
) -> DataFrame:
    """Drop hidden files and directories and build directories; keep the allowed extensions."""
    col = F.col(path)
    return df.filter(
        ~col.rlike(r"(^|/)\.")
        & ~F.arrays_overlap(_parents(col), F.array(*map(F.lit, build_dirs)))
        & file_extension(col).isin(extensions)
    )


def safe_paths(df: DataFrame, path: str = "relative_path", limit: int = 500) -> DataFrame:
    """Drop unsafe archive members: parent references, absolute paths, over-long names."""
    col = F.col(path)
    return df.filter(~col.contains("..") & ~col.startswith("/") & (F.length(col) <= limit))


def by_language(df: DataFrame, languages: list[str] = dims.REFACTORABLE, col: str = "language") -> DataFrame:
    return df.filter(F.col(col).isin(languages))


def by_size(df: DataFrame, low: int = 0, high: int | None = None, col: str = "size_bytes") -> DataFrame:
    keep = F.col(col) >= low
    return df.filter(keep if high is None else keep & (F.col(col) <= high))


def by_complexity(df: DataFrame, low: float = 0, high: float | None = None, col: str = "complexity_estimate") -> DataFrame:
    """Files with a known estimate in [low, high]; NULL never passes a comparison."""
    keep = F.col(col) >= low
    return df.filter(keep if high is None else keep & (F.col(col) <= high))


def route_scan(df: DataFrame, max_size: int = 1 << 20) -> DataFrame:
    """Add ``category``; the first matching rule decides."""
    return df.withColumn(
        "category",
        first_match(
            [
                (F.col("is_binary"), "binary"),
                (F.col("size_bytes") == 0, "empty"),
                (F.col("size_bytes") > max_size, "large"),
                (F.col("language").isin(dims.REFACTORABLE), "supported"),
            ],
            "unsupported",
        ),
    )


def route_processing(df: DataFrame, content: str = "original_content", limit: int = 50_000) -> DataFrame:
    """Add ``route`` and ``route_message``: skipped, completed without work, or process."""
    text, language = F.col(content), F.col("language")
    unsupported = ~language.isin(dims.PROCESSED_LANGUAGES)
    large = F.length(text) > limit
    return df.withColumns(
        {
            "route": first_match([(unsupported | large, "skipped"), (is_blank(text), "completed")], "process"),
            "route_message": first_match(
                [
                    (unsupported, F.concat(F.lit('Language "'), language, F.lit('" is not supported for refactoring'))),
                    (large, "File is too large for processing (maximum 50KB allowed)"),
                    (is_blank(text), "File is empty"),
                ],
                "",
            ),
        }
    )


def in_window(sessions: DataFrame, files: DataFrame, start, end) -> tuple[DataFrame, DataFrame]:
    """Sessions created in [start, end] and the files of those sessions.

    A session may own a large share of all files: the semi join only tests membership, the session side is one narrow
    column, and AQE splits an oversized key when it must shuffle.
    """
    picked = sessions.filter(F.col("created_at").between(F.lit(start), F.lit(end)))
    return picked, files.join(picked.select("session_id"), "session_id", "left_semi")


def worklist(
    files: DataFrame,
    session_id: str | None = None,
    language: str = "all",
    status: str = "all",
    limit: int | None = None,
) -> DataFrame:
    """Files to reprocess: optional filters, non-empty content, first ``limit`` by id."""
    if session_id is not None:
        files = files.filter(F.col("session_id") == session_id)
    if language != "all":
        files = files.filter(F.lower("language") == language.lower())
    if status != "all":
        files = files.filter(F.col("status") == status)
    files = files.filter(F.col("original_content") != "")
    return files.orderBy("file_id").limit(limit) if limit else files


def search_errors(files: DataFrame, term: str, exclude: str | None = None) -> DataFrame:
    """Case-insensitive substring search in the stored message."""
    hits = files.filter(F.lower("error_message").contains(term.lower()))
    return hits.filter(~F.lower("error_message").contains(exclude.lower())) if exclude else hits


def _ends_with_any(col: Column, extensions: list[str]) -> Column:
    cond = F.lit(False)
    for ext in extensions:
        cond = cond | col.endswith(ext)
    return cond


def changed_files(changes: DataFrame, scope: str = "changed") -> DataFrame:
    """Code files among added, copied and modified paths (``changed``) or among all tracked paths (``all``)."""
    if scope == "changed":
        changes = changes.filter(F.col("change_type").isin("A", "C", "M"))
    return changes.filter(_ends_with_any(F.col("path"), dims.COMMIT_EXTENSIONS)).select("path").distinct()


def list_files(
    files: DataFrame, sessions: DataFrame, language: str | None = None, status: str | None = None, text: str | None = None
) -> DataFrame:
    """Listing with equality filters and a substring search over file path or bundle name."""
    if language:
        files = files.filter(F.col("language") == language)
    if status:
        files = files.filter(F.col("status") == status)
    rows = files.select("file_id", "session_id", "original_path", "language", "status", "created_at").join(
        sessions.select("session_id", "original_filename"), "session_id"
    )
    if text:
        needle = text.lower()
        rows = rows.filter(
            F.lower("original_path").contains(needle) | F.lower("original_filename").contains(needle)
        )
    return rows


def preview(df: DataFrame, size: str = "size_bytes", large: int = 100_000) -> DataFrame:
    """Dry-run status per file."""
    return df.withColumn(
        "preview",
        first_match([(F.col(size) > large, "Skip (Large)"), (F.col(size) == 0, "Skip (Empty)")], "Ready"),
    )


__all__ = [
    "skip_dirs", "glob_filter", "code_files", "safe_paths", "by_language", "by_size", "by_complexity", "route_scan",
    "route_processing", "in_window", "worklist", "search_errors", "changed_files", "list_files", "preview", "file_name",
]
