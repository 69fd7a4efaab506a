"""Top-k, latest-n and retention queries.

``row_number() <= k`` is pushed below the shuffle as a window group limit, so every task sends at most k rows per group and a
hot group never gathers in one task. Every order ends in a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codecorpus.functions.patterns import stable_bucket
from codecorpus.operators.accuracy import band, enhanced_part

EXAMPLE_BANDS = [
    (0, 30, "Very Low Quality"), (30, 50, "Low Quality"), (50, 70, "Medium Quality"), (70, 85, "Good Quality"), (85, 100, "High Quality"),
]


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def band_examples(files: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` lowest-scored files of each quality band among files with refactored text."""
    rows = files.filter(F.col("refactored_content") != "").select(
        "file_id", "original_path", "overall_quality_score", "complexity_score", "readability_score", "maintainability_score",
        band(F.col("overall_quality_score"), EXAMPLE_BANDS).alias("band"),
    )
    return top_per_group(rows.filter(F.col("band").isNotNull()), ["band"], [F.col("overall_quality_score"), F.col("file_id")], k)


def latest(df: DataFrame, n: int, key: str, language: str | None = None) -> DataFrame:
    """Newest ``n`` rows by ``created_at``, optionally of one language."""
    if language is not None:
        df = df.filter(F.col("language") == language)
    return df.orderBy(F.desc("created_at"), key).limit(n)


def suspicious(files: DataFrame, language: str = "python", limit: int = 10, n: int = 5) -> DataFrame:
    """Newest files of a language with a complexity score below ``limit``."""
    return latest(files.filter((F.lower("language") == language) & (F.col("complexity_score") < limit)), n, "file_id")


def session_failures(sessions: DataFrame, files: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` failure messages of each failed session (by file id); cut per session before the join."""
    failed = files.filter((F.col("status") == "failed") & (F.col("error_message") != "")).select("session_id", "file_id", "error_message")
    top = top_per_group(failed, ["session_id"], [F.col("file_id")], n)
    return top.join(sessions.filter(F.col("status") == "failed").select("session_id"), "session_id", "left_semi")


def recent_errors(errors: DataFrame, n: int = 100) -> DataFrame:
    return errors.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def file_history(commits: DataFrame, changes: DataFrame, n: int = 20) -> DataFrame:
    """Last ``n`` commits of each path, newest first. Repeated changes of a path in one commit count once.

    The join runs on the commit hash; a commit that touches very many files is split by AQE's skew handling, and only n rows
    per path and task travel to the ranking.
    """
    touched = changes.select("path", "hash").distinct()
    rows = touched.join(commits, "hash")
    return top_per_group(rows, ["path"], [F.desc("committed_at"), F.col("hash")], n)


def recent_commits(commits: DataFrame, now, days: int = 30, limit: int = 100) -> DataFrame:
    """Newest ``limit`` commits of the last ``days`` days before ``now``."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return commits.filter(F.col("committed_at") >= since).orderBy(F.desc("committed_at"), "hash").limit(limit)


def hot_files(commits: DataFrame, changes: DataFrame, window: int = 5, more_than: int = 3, history: DataFrame | None = None) -> DataFrame:
    """Paths with more than ``more_than`` commits among their last ``window`` (``history``: at least as many last commits, where they are known already)."""
    last = file_history(commits, changes, window) if history is None else history.filter(F.col("rank") <= window)
    return last.groupBy("path").agg(F.count("*").alias("recent_changes")).filter(F.col("recent_changes") > more_than)


def sample_enhanced(files: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """``n`` enhanced files in a seeded random order that does not depend on partitioning."""
    rows = files.filter(F.lower("error_message").contains("enhanced:")).select(
        "file_id", "original_path", "language", "status", enhanced_part(F.col("error_message")).alias("improvements"), "overall_quality_score"
    )
    return rows.orderBy(stable_bucket(F.col("file_id"), 1 << 30, str(seed)), "file_id").limit(n)


def expired_logs(log_files: DataFrame, keep: int = 10, by: str | None = None) -> DataFrame:
    """Log files beyond the ``keep`` newest (per group when ``by`` is given).

    Without a group the newest names are found as a bounded top-k and removed by an anti join, so nothing is ranked globally.
    """
    if by:
        newest = top_per_group(log_files, [by], [F.desc("modified"), F.col("path")], keep).select("path")
    else:
        newest = log_files.orderBy(F.desc("modified"), "path").limit(keep).select("path")
    return log_files.join(newest, "path", "left_anti")
