"""Outcome, quality and error analytics over session and file tables.

Counters are conditional aggregates of one scan: partial aggregation leaves one row per group and task, so a dominant session
or language shuffles no more than any other. Rates are unrounded doubles; a zero base gives 0. Text columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.functions.patterns import first_match, has_any, ratio, strip

SCORES = {
    "complexity": "complexity_score", "readability": "readability_score", "maintainability": "maintainability_score",
    "overall": "overall_quality_score",
}


def _status(value: str) -> Column:
    return F.col("status") == value


def _scored() -> Column:
    return _status("completed") & (F.col("overall_quality_score") > 0)


def _enhanced() -> Column:
    return F.lower("error_message").contains("enhanced:")


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _averages(cond: Column, prefix: str = "avg_") -> list[Column]:
    return [F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(0.0)).alias(prefix + n) for n, c in SCORES.items()]


def _pct(part: str, whole: str) -> Column:
    return ratio(F.col(part), F.col(whole), 100)


def one_row(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row tables in one row: a union and an aggregate, so no cross join is needed."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union.agg(*[F.first(c, ignorenulls=True).alias(c) for c in union.columns])


def overall_accuracy(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """One row: session and file counts by status, success rates, share of files completed with a positive score."""
    s = sessions.agg(
        F.count("*").alias("total_sessions"),
        *[_count(_status(v)).alias(f"{v}_sessions") for v in ("completed", "failed", "processing")],
    )
    f = files.agg(
        F.count("*").alias("total_files"),
        *[_count(_status(v)).alias(f"{v}_files") for v in ("completed", "failed", "processing")],
        _count(_scored()).alias("files_with_quality_metrics"),
    )
    return one_row(s, f).withColumns(
        {
            "session_success_rate": _pct("completed_sessions", "total_sessions"),
            "file_success_rate": _pct("completed_files", "total_files"),
            "true_accuracy": _pct("files_with_quality_metrics", "total_files"),
        }
    )


def language_accuracy(files: DataFrame) -> DataFrame:
    return (
        files.groupBy("language")
        .agg(
            F.count("*").alias("total_files"), _count(_status("completed")).alias("completed_files"),
            _count(_status("failed")).alias("failed_files"), _count(_scored()).alias("scored_files"), *_averages(_scored()),
        )
        .withColumns({"success_rate": _pct("completed_files", "total_files"), "quality_accuracy": _pct("scored_files", "total_files")})
        .drop("scored_files")
    )


def quality_summary(files: DataFrame) -> DataFrame:
    """One row: averages and the four quality bands with their shares."""
    o = F.col("overall_quality_score")
    bands = {"excellent": o >= 90, "good": (o >= 75) & (o < 90), "fair": (o >= 60) & (o < 75), "poor": o < 60}
    out = files.agg(
        _count(_scored()).alias("files_analyzed"), *_averages(_scored()),
        *[_count(_scored() & cond).alias(f"{name}_count") for name, cond in bands.items()],
    )
    return out.withColumns({f"{b}_pct": _pct(f"{b}_count", "files_analyzed") for b in bands})


def failure_class(message: Column) -> Column:
    low = F.lower(message)
    words = {"syntax": "syntax_errors", "timeout": "timeout_errors", "llm": "llm_errors", "validation": "validation_errors"}
    return first_match([(low.contains(k), v) for k, v in words.items()], "other_errors")


def failure_classes(files: DataFrame) -> DataFrame:
    failed = files.filter(_status("failed") & (F.col("error_message") != ""))
    return failed.groupBy(failure_class(F.col("error_message")).alias("error_class")).agg(F.count("*").alias("files"))


def error_rate(files: DataFrame) -> DataFrame:
    out = files.groupBy("language").agg(_count(_status("failed")).alias("failed_files"), F.count("*").alias("total_files"))
    return out.withColumn("error_rate", _pct("failed_files", "total_files"))


def validation_accuracy(files: DataFrame) -> DataFrame:
    done, message = _status("completed"), F.col("error_message")
    out = files.agg(
        F.count("*").alias("total_files"), _count(done).alias("total_completed"),
        _count(done & (message == "")).alias("clean_completions"), _count(done & (message != "")).alias("completed_with_warnings"),
    )
    return out.withColumns(
        {"validation_accuracy": _pct("clean_completions", "total_files"), "warning_rate": _pct("completed_with_warnings", "total_completed")}
    )


def assessment(files: DataFrame) -> DataFrame:
    """One row: label of the overall accuracy and the recommendations whose threshold is crossed."""
    done = _status("completed")
    row = files.agg(
        ratio(_count(_scored()), F.count("*"), 100).alias("true_accuracy"),
        ratio(_count(done & (F.col("error_message") != "")), _count(done), 100).alias("warning_rate"),
        (_count(_status("failed")) > F.count("*") * F.lit(0.1)).alias("__many_failed"),
        F.coalesce(F.avg(F.when(_scored(), F.col("overall_quality_score"))), F.lit(0.0)).alias("avg_overall"),
    )
    acc = F.col("true_accuracy")
    label = first_match([(acc >= 90, "EXCELLENT"), (acc >= 75, "GOOD"), (acc >= 60, "FAIR")], "NEEDS IMPROVEMENT")
    notes = F.array(
        F.when(acc < 75, "Review and improve error handling for failed refactorings"),
        F.when(F.col("warning_rate") > 20, "Investigate validation warnings to improve code quality"),
        F.when(F.col("__many_failed"), "Analyze common error patterns to prevent failures"),
        F.when(F.col("avg_overall") < 75, "Enhance refactoring algorithms to improve quality scores"),
    )
    return row.select("true_accuracy", "warning_rate", "avg_overall", label.alias("assessment"), F.array_compact(notes).alias("recommendations"))


def _improved() -> tuple[Column, Column]:
    c, r, m = F.col("complexity_score"), F.col("readability_score"), F.col("maintainability_score")
    scored = _status("completed") & (c != 0) & (r != 0) & (m != 0)
    return scored, scored & ((c > 65) | (r > 50) | (m > 50))


def improvement_accuracy(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Improved files (above the baseline in any score) and rates, per language and overall (language NULL).

    Per-language averages divide by all completed files, as the reported numbers do; overall averages by the scored files.
    """
    scored, improved = _improved()
    picked = files.join(sessions.select("session_id"), "session_id", "left_semi").withColumn(
        "language", F.when(F.coalesce("language", F.lit("")) == "", "unknown").otherwise(F.col("language"))
    )
    sums = {n: F.coalesce(F.sum(F.when(scored, F.col(SCORES[n]))), F.lit(0)) for n in ("complexity", "readability", "maintainability")}
    counts = {
        "total_files": F.count("*"), "successful_files": _count(_status("completed")), "failed_files": _count(_status("failed")),
        "files_with_improvements": _count(improved),
    }
    # Rows are counted per language first; only these few rows are rolled up.
    per = picked.groupBy("language").agg(*[c.alias(k) for k, c in counts.items()], _count(scored).alias("__scored"), *[v.alias(n) for n, v in sums.items()])
    total = F.grouping("language") == 1
    return per.rollup("language").agg(
        *[F.sum(k).alias(k) for k in counts],
        *[ratio(F.sum(n), F.when(total, F.sum("__scored")).otherwise(F.sum("successful_files"))).alias(f"avg_{n}") for n in sums],
    ).withColumns({"success_rate": _pct("successful_files", "total_files"), "true_accuracy": _pct("files_with_improvements", "total_files")})


def recommendations(files: DataFrame) -> DataFrame:
    """Recommendations in order: low accuracy, syntax failures, weak languages; a positive note when none applies."""
    _, improved = _improved()
    lang = F.when(F.coalesce("language", F.lit("")) == "", "unknown").otherwise(F.col("language"))
    per = files.groupBy(lang.alias("language")).agg(
        F.count("*").alias("total"), _count(_status("completed")).alias("done"), _count(improved).alias("improved"),
        _count(_status("failed") & F.lower("error_message").contains("syntax")).alias("syntax"),
    )
    # One row per language from here on.
    rate = ratio(F.col("done"), F.col("total"), 100)
    weak = F.when((rate < 80) & (F.col("total") > 5), F.struct("language", rate.alias("rate")))
    row = per.agg(
        ratio(F.sum("improved"), F.sum("total"), 100).alias("acc"), F.sum("syntax").alias("syntax"),
        F.array_sort(F.collect_list(weak)).alias("weak"),
    )
    notes = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("acc") < 85, "Consider further improving complexity scoring algorithms"),
                F.when(F.col("syntax") > 0, "Implement better syntax error handling and validation"),
            )
        ),
        F.transform(
            "weak",
            lambda w: F.concat(F.lit("Improve "), w["language"], F.lit(" language support (current success rate: "), F.format_string("%.1f", w["rate"]), F.lit("%)")),
        ),
    )
    fallback = F.array(F.lit("Accuracy metrics are performing well - continue monitoring"))
    return row.select(F.posexplode(F.when(F.size(notes) > 0, notes).otherwise(fallback)).alias("position", "recommendation"))


def session_summary(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Result page per session: counts by status, success %, averages of scored files, files per language."""
    per_language = files.groupBy("session_id", "language").agg(
        F.count("*").alias("n"),
        *[_count(_status(v)).alias(v) for v in ("completed", "failed", "processing", "skipped")],
        _count(_scored()).alias("scored"), *[F.sum(F.when(_scored(), F.col(c))).alias(f"sum_{n}") for n, c in SCORES.items()],
    )
    per = per_language.groupBy("session_id").agg(
        F.sum("n").alias("total_files"), *[F.sum(v).alias(f"{v}_files") for v in ("completed", "failed", "processing", "skipped")],
        F.sum("scored").alias("__scored"), *[F.sum(f"sum_{n}").alias(f"__{n}") for n in SCORES],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"),
    )
    out = sessions.select("session_id", "original_filename").join(per, "session_id", "left")
    counts = ["total_files"] + [f"{v}_files" for v in ("completed", "failed", "processing", "skipped")]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).select(
        "session_id", "original_filename", *counts, _pct("completed_files", "total_files").alias("success_rate"),
        *[F.coalesce(F.col(f"__{n}") / F.col("__scored"), F.lit(0.0)).alias(f"avg_{n}") for n in SCORES],
        F.coalesce("languages", F.expr("cast(map() as map<string,bigint>)")).alias("languages"),
    )


def compare_sessions(sessions: DataFrame, files: DataFrame, sort: str = "created_at") -> DataFrame:
    """All sessions with counts, success % and a language -> files map; sort by created_at, success_rate or total_files."""
    out = session_summary(sessions, files).join(sessions.select("session_id", "created_at", "status"), "session_id")
    return out.select(
        "session_id", "original_filename", "created_at", "status", "total_files", "completed_files", "failed_files", "success_rate", "languages"
    ).orderBy(F.col(sort).desc(), "session_id")


def session_progress(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Processed over total % and the truncated share of finished files."""
    per = files.groupBy("session_id").agg(
        F.count("*").alias("n"), *[_count(_status(v)).alias(f"{v}_files") for v in ("completed", "failed", "processing")]
    )
    out = sessions.select("session_id", "status", "total_files", "processed_files").join(per, "session_id", "left")
    names = ["n", "completed_files", "failed_files", "processing_files"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    done = F.col("completed_files") + F.col("failed_files")
    return out.withColumns(
        {"progress": _pct("processed_files", "total_files"), "progress_percentage": F.floor(ratio(done, F.col("n"), 100)).cast("int")}
    ).drop("n")


def enhancement_coverage(files: DataFrame) -> DataFrame:
    out = files.agg(F.count("*").alias("total_files"), _count(_enhanced()).alias("enhanced_files"))
    return out.withColumn("coverage", _pct("enhanced_files", "total_files"))


def enhanced_vs_all(files: DataFrame) -> DataFrame:
    """(metric, all, enhanced, difference, relative %) over files with a non-zero overall score."""
    scored = files.filter(F.col("overall_quality_score") != 0)
    row = scored.agg(*_averages(F.lit(True), "all_"), *_averages(_enhanced(), "enh_"))
    metrics = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"all_{n}").alias("all_files"), F.col(f"enh_{n}").alias("enhanced_files")) for n in SCORES])
    out = row.select(F.inline(metrics)).withColumn("difference", F.col("enhanced_files") - F.col("all_files"))
    return out.withColumn("difference_pct", ratio(F.col("difference"), F.col("all_files"), 100))


# Score bands [low, high); 100 falls in none of them.
BANDS = [(0, 50, "Low Quality"), (50, 70, "Medium Quality"), (70, 85, "Good Quality"), (85, 100, "High Quality")]


def band(score: Column, bands: list[tuple[int, int, str]] = BANDS) -> Column:
    return first_match([((score >= lo) & (score < hi), name) for lo, hi, name in bands], F.lit(None).cast("string"))


def band_comparison(files: DataFrame) -> DataFrame:
    """(band, all, %, enhanced, %, difference of %) over files with a non-zero overall score."""
    o = F.col("overall_quality_score")
    scored = files.filter(o != 0)
    row = scored.agg(
        F.count("*").alias("n"), _count(_enhanced()).alias("e"),
        *[_count((o >= lo) & (o < hi)).alias(f"n{i}") for i, (lo, hi, _) in enumerate(BANDS)],
        *[_count((o >= lo) & (o < hi) & _enhanced()).alias(f"e{i}") for i, (lo, hi, _) in enumerate(BANDS)],
    )
    entries = F.array(
        *[F.struct(F.lit(name).alias("band"), F.col(f"n{i}").alias("all_count"), ratio(F.col(f"n{i}"), F.col("n"), 100).alias("all_pct"),
                   F.col(f"e{i}").alias("enhanced_count"), ratio(F.col(f"e{i}"), F.col("e"), 100).alias("enhanced_pct"))
          for i, (_, _, name) in enumerate(BANDS)]
    )
    return row.select(F.inline(entries)).withColumn("difference_pct", F.col("enhanced_pct") - F.col("all_pct"))


def enhanced_part(message: Column) -> Column:
    """Text between ``Enhanced:`` and the next ``|``."""
    after = F.get(F.split(message, "Enhanced:", -1), F.lit(1))
    return strip(F.substring_index(after, "|", 1))


def improvement_types(files: DataFrame) -> DataFrame:
    """Files per improvement class (classes overlap), most frequent first."""
    text = F.lower(enhanced_part(F.col("error_message")))

    def hit(alternatives: list[list[str]]) -> Column:
        cond = F.lit(False)
        for words in alternatives:
            every = F.lit(True)
            for w in words:
                every = every & text.contains(w)
            cond = cond | every
        return cond

    labels = F.array_compact(F.array(*[F.when(hit(a), name) for name, a in dims.IMPROVEMENT_TYPES.items()]))
    rows = files.filter(F.col("error_message").contains("Enhanced:")).select(F.explode(labels).alias("improvement_type"))
    return rows.groupBy("improvement_type").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "improvement_type")


def improvement_impact(files: DataFrame) -> DataFrame:
    """Average scores per improvement keyword group (groups overlap)."""
    low = F.lower("error_message")
    groups = F.array_compact(F.array(*[F.when(has_any(low, words), name) for name, words in dims.IMPROVEMENT_GROUPS.items()]))
    rows = files.filter(_enhanced() & (F.col("overall_quality_score") != 0)).select(F.explode(groups).alias("improvement_group"), *SCORES.values())
    return rows.groupBy("improvement_group").agg(F.count("*").alias("files"), *[F.avg(c).alias(f"avg_{n}") for n, c in SCORES.items()])


def language_improvements(files: DataFrame) -> DataFrame:
    rows = files.filter(_enhanced() & (F.col("overall_quality_score") != 0))
    return rows.groupBy("language").agg(F.count("*").alias("files"), *[F.avg(c).alias(f"avg_{n}") for n, c in SCORES.items()]).orderBy(F.desc("files"), "language")


def success_metrics(files: DataFrame) -> DataFrame:
    """Low / medium or better / high counts, all against enhanced, and the share of enhanced files at 50 or more."""
    o, e = F.col("overall_quality_score"), _enhanced()
    out = files.filter(o != 0).agg(
        _count(o < 50).alias("low_all"), _count((o < 50) & e).alias("low_enhanced"),
        _count(o >= 50).alias("medium_plus_all"), _count((o >= 50) & e).alias("medium_plus_enhanced"),
        _count(o >= 85).alias("high_all"), _count((o >= 85) & e).alias("high_enhanced"), _count(e).alias("__n"),
    )
    return out.withColumn("achievement_rate", _pct("medium_plus_enhanced", "__n")).drop("__n")


# --- scans ---------------------------------------------------------------------------------------------------------


def language_stats(scan: DataFrame) -> DataFrame:
    """Count, bytes, lines, means, largest and smallest file per language (ties: first path)."""
    entry = F.struct(F.col("relative_path").alias("path"), F.col("size_bytes").alias("size"), F.col("line_count").alias("lines"))
    # min over (-size, path) keeps the first path among the largest.
    largest = F.min(F.struct((-F.col("size_bytes")).alias("k"), F.col("relative_path").alias("p"), entry.alias("e")))["e"]
    smallest = F.min(F.struct(F.col("size_bytes").alias("k"), F.col("relative_path").alias("p"), entry.alias("e")))["e"]
    return scan.groupBy("language").agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_size"), F.sum("line_count").alias("total_lines"),
        F.avg("size_bytes").alias("avg_file_size"), F.avg("line_count").alias("avg_lines_per_file"),
        largest.alias("largest_file"), smallest.alias("smallest_file"),
    )


def estimate_time(scan: DataFrame) -> DataFrame:
    """Estimated seconds per language and in total (language NULL): 0.1 s per 1,000 lines times a language factor.

    Lines are summed before the factor is applied, so the result does not depend on the order of the rows.
    """
    factor = first_match([(F.col("language") == k, F.lit(v)) for k, v in dims.TIME_MULTIPLIER.items()], F.lit(1.0))
    per = scan.groupBy("language").agg(F.sum("line_count").alias("lines"), F.count("*").alias("files"))
    per = per.withColumn("weighted", F.col("lines") * (factor * 10).cast("long"))
    return per.rollup("language").agg(
        F.sum("files").alias("files"), F.sum("lines").alias("lines"), (F.sum("weighted") / F.lit(100000.0)).alias("estimated_seconds")
    )


def scan_report(scan: DataFrame, n_errors: int = 10) -> tuple[DataFrame, DataFrame]:
    """Files and bytes per category, and the first errors when the scan carries an ``error`` column."""
    counts = scan.groupBy("category").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    errors = scan.filter(F.col("error").isNotNull()).select("relative_path", "error").orderBy("relative_path").limit(n_errors) if "error" in scan.columns else None
    return counts, errors


def opportunities(files: DataFrame) -> DataFrame:
    """Low and medium files and low single scores with shares, over files with refactored text."""
    o = F.col("overall_quality_score")
    low = {n: F.col(SCORES[n]) < 50 for n in ("complexity", "readability", "maintainability")}
    out = files.filter(F.col("refactored_content") != "").agg(
        F.count("*").alias("total_files"), _count(o < 50).alias("low_quality"), _count((o >= 50) & (o < 70)).alias("medium_quality"),
        *[_count(c).alias(f"low_{n}") for n, c in low.items()],
    )
    return out.withColumn("needing_improvement", F.col("low_quality") + F.col("medium_quality")).withColumns(
        {f"low_{n}_share": ratio(F.col(f"low_{n}"), F.col("total_files")) for n in low}
    )


# --- runs and logs -------------------------------------------------------------------------------------------------


def run_stats(results: DataFrame) -> DataFrame:
    """Success rate and mean suggestions and applied changes per file; the denominator is at least 1."""
    out = results.agg(
        F.count("*").alias("files_processed"), _count(~F.col("success")).alias("errors"),
        F.coalesce(F.sum("n_suggestions"), F.lit(0)).alias("total_suggestions"), F.coalesce(F.sum("n_applied"), F.lit(0)).alias("applied_changes"),
    )
    base = F.greatest("files_processed", F.lit(1)).cast("double")
    return out.withColumns(
        {
            "success_rate": (F.col("files_processed") - F.col("errors")) / base, "avg_suggestions_per_file": F.col("total_suggestions") / base,
            "avg_applied_per_file": F.col("applied_changes") / base,
        }
    )


def log_summary(log: DataFrame) -> DataFrame:
    """(dimension, value, entries, avg / max / min duration): per operation type, per level and overall."""
    per = log.groupBy("operation_type", "level").agg(
        F.count("*").alias("n"), F.sum("duration").alias("s"), F.count("duration").alias("k"), F.max("duration").alias("hi"), F.min("duration").alias("lo")
    )
    out = per.groupingSets([["operation_type"], ["level"], []], "operation_type", "level").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), ratio(F.sum("s"), F.sum("k")).alias("avg_duration"),
        F.coalesce(F.max("hi"), F.lit(0.0)).alias("max_duration"), F.coalesce(F.min("lo"), F.lit(0.0)).alias("min_duration"),
        F.grouping_id().alias("__g"),
    )
    kind = first_match([(F.col("__g") == 1, "operation_type"), (F.col("__g") == 2, "level")], "all")
    return out.select(kind.alias("dimension"), F.coalesce("operation_type", "level", F.lit("all")).alias("value"), "entries", "avg_duration", "max_duration", "min_duration")


def request_stats(requests: DataFrame) -> DataFrame:
    """Per provider and model: requests, failures, tokens, mean response time."""
    return requests.groupBy("provider", "model").agg(
        F.count("*").alias("requests"), _count(~F.col("success")).alias("failures"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"),
        F.avg("response_time").alias("avg_response_time"),
    )


def trial_summary(results: DataFrame) -> DataFrame:
    """Shares of success and of valid text before and after, per language and overall (language NULL)."""
    flags = {"success": "successful", "original_valid": "valid_before", "refactored_valid": "valid_after"}
    per = results.groupBy("language").agg(F.count("*").alias("trials"), *[_count(F.col(c)).alias(a) for c, a in flags.items()])
    out = per.rollup("language").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("trials", *flags.values())])
    return out.withColumns({f"{a}_pct": _pct(a, "trials") for a in flags.values()})


def dataset_stats(pairs: DataFrame) -> DataFrame:
    """Examples and mean reductions per language, per pattern and overall."""
    means = ("complexity_reduction", "depth_reduction")
    per = pairs.groupBy("language", "pattern").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in means], *[F.count(c).alias(f"n_{c}") for c in means]
    )
    return per.groupingSets([["language"], ["pattern"], []], "language", "pattern").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("examples"), *[F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}")).alias(f"avg_{c}") for c in means]
    )


def error_stats(errors: DataFrame) -> DataFrame:
    """(kind, value, errors): total, per type, per pattern; ``is_most_common`` marks the top pattern (ties: first name)."""
    from codecorpus.functions.responses import error_pattern

    out = (
        errors.groupBy("error_type", error_pattern(F.col("message")).alias("pattern")).agg(F.count("*").alias("n"))
        .groupingSets([["error_type"], ["pattern"], []], "error_type", "pattern")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("errors"), F.grouping_id().alias("__g"))
    )
    kind = first_match([(F.col("__g") == 1, "error_type"), (F.col("__g") == 2, "pattern")], "total")
    out = out.select(kind.alias("kind"), F.coalesce("error_type", "pattern", F.lit("all")).alias("value"), "errors")
    # A handful of rows: one per type and pattern.
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("errors"), "value"))
    return out.withColumn("is_most_common", (F.col("kind") == "pattern") & (rank == 1))
