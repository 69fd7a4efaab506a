"""Comparison of two versions of a file, outcome decisions and suggestion handling.

Both versions sit in one row, so diffs are folds inside the row: no line is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.functions.language import valid_name
from codecorpus.functions.patterns import WORD, file_extension, first_match, has_any, is_blank, line_total, split_lines
from codecorpus.operators.pyfacts import error_message, facts_column, structure_struct


def session_files(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Files of each session ordered by path (a range sort: a large session spreads over many partitions)."""
    left = sessions.select("session_id", "original_filename", F.col("status").alias("session_status"))
    right = files.select("session_id", "file_id", "original_path", "language", "status", "overall_quality_score")
    return left.join(right, "session_id").orderBy("session_id", "original_path", "file_id")


def compare_structure(
    df: DataFrame, before: str = "original_content", after: str = "refactored_content", key: str = "file_id"
) -> DataFrame:
    """Python versions compared: validity, removed and added classes and functions, main flag, complexity warnings.

    When the new version does not parse only the validity columns and the warning are filled.
    """
    df = df.select(key, facts_column(F.col(before)).alias("__fb"), facts_column(F.col(after)).alias("__fa"),
                   is_blank(F.col(before)).alias("__bb"), is_blank(F.col(after)).alias("__ba"))
    df = df.select(
        key, structure_struct(F.col("__fb")).alias("b"), structure_struct(F.col("__fa")).alias("a"),
        F.when(~F.col("__bb"), error_message(F.col("__fb"))).alias("eb"), F.when(~F.col("__ba"), error_message(F.col("__fa"))).alias("ea"),
    )
    both = F.col("eb").isNull() & F.col("ea").isNull()

    def names(side: str, what: str) -> Column:
        return F.transform(F.col(f"{side}.{what}"), lambda x: x["name"])

    def gone(left: str, right: str, what: str) -> Column:
        return F.when(both, F.array_sort(F.array_except(names(left, what), names(right, what))))

    df = df.withColumns(
        {
            "removed_classes": gone("b", "a", "classes"), "added_classes": gone("a", "b", "classes"),
            "removed_functions": gone("b", "a", "functions"), "added_functions": gone("a", "b", "functions"),
            "complexity_change": F.when(both, F.col("a.complexity_score") - F.col("b.complexity_score")),
        }
    )
    preserved = both & (F.size("removed_classes") == 0) & (F.size("removed_functions") == 0) & (F.col("a.has_main") == F.col("b.has_main"))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("eb").isNotNull(), F.concat(F.lit("Original code has syntax errors: "), F.col("eb"))),
            F.when(F.col("ea").isNotNull(), F.concat(F.lit("Refactored code has syntax errors: "), F.col("ea"))),
            F.when(F.col("complexity_change") > 5, "Refactored code is significantly more complex"),
            F.when(F.col("complexity_change") < -5, "Refactored code is significantly simpler"),
        )
    )
    return df.select(
        key, F.col("eb").isNull().alias("original_valid"), F.col("ea").isNull().alias("refactored_valid"),
        F.coalesce(preserved, F.lit(False)).alias("structure_preserved"), "removed_classes", "added_classes", "removed_functions",
        "added_functions", "complexity_change", warnings.alias("warnings"),
    )


def positional_changes(before: Column, after: Column) -> Column:
    """Lines that differ at the same position; the missing side counts as ''."""
    pairs = F.arrays_zip(split_lines(before).alias("b"), split_lines(after).alias("a"))
    return F.size(F.filter(pairs, lambda p: F.coalesce(p["b"], F.lit("")) != F.coalesce(p["a"], F.lit(""))))


def changed_lines_positional(df: DataFrame, before: str = "original_content", after: str = "refactored_content") -> DataFrame:
    return df.withColumn("changed_lines", positional_changes(F.col(before), F.col(after)))


def multiset_changes(before: Column, after: Column) -> Column:
    """Sum over distinct line texts of the count difference: lines of both sides, signed, sorted once and folded with a
    constant-size state."""
    signed = F.array_sort(
        F.concat(
            F.transform(split_lines(before), lambda s: F.struct(s.alias("t"), F.lit(1).alias("w"))),
            F.transform(split_lines(after), lambda s: F.struct(s.alias("t"), F.lit(-1).alias("w"))),
        )
    )
    zero = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("run"), F.lit(0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["t"].eqNullSafe(x["t"])
        return F.struct(
            x["t"].alias("t"),
            F.when(same, acc["run"] + x["w"]).otherwise(x["w"]).alias("run"),
            F.when(same, acc["total"]).otherwise(acc["total"] + F.abs(acc["run"])).alias("total"),
        )

    return F.aggregate(signed, zero, step, lambda acc: acc["total"] + F.abs(acc["run"]))


def diff_stats(df: DataFrame, before: str = "original_content", after: str = "refactored_content") -> DataFrame:
    """Line counts, net added, changed lines as a multiset difference, both hashes."""
    old, new = F.col(before), F.col(after)
    return df.withColumns(
        {
            "lines_before": line_total(old), "lines_after": line_total(new), "lines_added": line_total(new) - line_total(old),
            "lines_changed": multiset_changes(old, new), "hash_before": F.md5(old), "hash_after": F.md5(new),
        }
    )


def similarity(df: DataFrame, before: str = "original_content", after: str = "refactored_content") -> DataFrame:
    """Dice similarity of the line multisets: twice the shared lines over all lines."""
    total = line_total(F.col(before)) + line_total(F.col(after))
    changed = multiset_changes(F.col(before), F.col(after))
    return df.withColumn("similarity", (total - changed).cast("double") / total)


def acceptance_warnings(
    df: DataFrame, before: str = "original_content", after: str = "refactored_content", language: str = "language", python: bool = True
) -> DataFrame:
    """Add ``warnings``: empty result alone, else much shorter than the original and, for Python, unparsable."""
    old, new = F.col(before), F.col(after)
    checks = [F.when(F.length(new) < F.length(old) * 0.5, "Refactored code is significantly shorter than original")]
    if python:
        df = df.withColumn("__f", facts_column(F.when(F.col(language) == "Python", new)))
        checks.append(F.when(error_message(F.col("__f")).isNotNull(), "Python syntax validation failed"))
    found = F.when(is_blank(new), F.array(F.lit("Refactored code is empty"))).otherwise(F.array_compact(F.array(*checks)))
    return df.withColumn("warnings", found).drop("__f")


def decide_outcome(df: DataFrame, before: str = "original_content", after: str = "refactored_content", warnings: str = "warnings") -> DataFrame:
    """Add ``outcome``, ``outcome_message`` and ``outcome_content`` from a response and its warnings."""
    old, new, warn = F.col(before), F.col(after), F.col(warnings)
    syntax = F.exists(warn, lambda w: has_any(F.lower(w), dims.SYNTAX_WARNING_WORDS))
    first = F.array_join(F.slice(warn, 1, 3), "; ")
    blank = new.isNull() | is_blank(new)
    return df.withColumns(
        {
            "outcome": first_match([(blank, "completed"), (syntax, "failed")], "completed"),
            "outcome_message": first_match(
                [(blank, "Refactoring returned empty code, kept original"),
                 (syntax, F.concat(F.lit("Refactored code has syntax errors: "), first))],
                first,
            ),
            "outcome_content": F.when(blank | syntax, old).otherwise(new),
        }
    )


# --- suggestions ---------------------------------------------------------------------------------------------------


def collect_renames(suggestions: DataFrame, threshold: float = 0.7, key: str = "file_id") -> DataFrame:
    """(file, renames): accepted renames of a file in suggestion order.

    Only the first rename of a name can have an effect unless some rename of the file creates that name again, so the rest is
    dropped before the per-file list is built: the list is bounded by the distinct names, not by the number of suggestions.
    """
    accepted = suggestions.filter((F.col("kind") == "rename") & (F.col("confidence") >= threshold) & (F.col("old_name") != F.col("new_name")))
    # No step marks a word that some new name brings in; a name of several words may come up anywhere, so it counts as brought in too.
    step = F.struct(F.col("position").alias("pos"), F.col("old_name").alias("old"), F.col("new_name").alias("new"))
    none = F.lit(None).cast("struct<pos:int,old:string,new:string>")
    brought = F.concat(F.regexp_extract_all("new_name", F.lit(f"{WORD}+"), F.lit(0)), F.when(~F.col("old_name").rlike(f"^{WORD}+$"), F.array("old_name")).otherwise(F.array()))
    uses = accepted.select(
        key,
        F.inline(F.concat(F.array(F.struct(F.col("old_name").alias("name"), step.alias("step"))), F.transform(brought, lambda w: F.struct(w.alias("name"), none.alias("step"))))),
    )
    created = uses.groupBy(key, "name").agg(F.min("step").alias("first"), F.bool_or(F.col("step").isNull()).alias("is_target"))
    plain = created.filter(~F.col("is_target")).select(key, F.col("first").alias("step"))
    again = (
        accepted.select(key, F.col("old_name").alias("name"), step.alias("step"))
        .join(created.filter("is_target and first is not null").select(key, "name"), [key, "name"], "left_semi")
        .select(key, "step")
        .distinct()
    )
    return plain.unionByName(again).groupBy(key).agg(F.array_sort(F.collect_list("step")).alias("renames"))


def _in_turn(text: Column, renames: Column) -> Column:
    """One replacement of the whole text after another, for names that are not single words."""
    return F.aggregate(
        renames, text,
        lambda acc, r: F.regexp_replace(acc, F.concat(F.lit(f"(?<!{WORD})\\Q"), r["old"], F.lit(f"\\E(?!{WORD})")), F.regexp_replace(r["new"], r"([\\$])", r"\\$1")),
    )


def _runs(text: Column) -> Column:
    """A text as runs of word characters and runs of others."""
    return F.regexp_extract_all(text, F.lit(f"{WORD}+|(?:(?!{WORD})(?s:.))+"), F.lit(0))


def _looked_up(runs: Column, names: Column) -> Column:
    return F.array_join(F.transform(runs, lambda w: F.coalesce(F.try_element_at(names, w), w)), "")


def final_names(renames: Column) -> Column:
    """What each renamed word is in the end, as a map. From the last rename to the first: a new name is itself renamed by those after it, so a to b and b to c
    make c of a, and of several renames of a name the first counts."""
    none = F.expr("cast(map() as map<string,string>)")
    return F.aggregate(
        F.reverse(renames), none,
        lambda names, r: F.map_concat(F.map_filter(names, lambda k, _: k != r["old"]), F.create_map(r["old"], _looked_up(_runs(r["new"]), names))),
    )


def rename_text(text: Column, renames: Column) -> Column:
    """Apply whole-word renames in order. The text is cut into words once, and of the renames only those of words in it are looked up, so the time
    follows the text and not the number of renames. Names are literal; files with a name that is more than one word are renamed in turn."""
    words = F.forall(renames, lambda r: r["old"].rlike(f"^{WORD}+$"))

    def once(x: Column) -> Column:
        here = F.array_intersect(x["runs"], F.map_keys(x["names"]))
        used = F.transform(F.array(here), lambda h: F.map_filter(x["names"], lambda k, _: F.array_contains(h, k)))
        return F.when(F.size(here) == 0, x["text"]).otherwise(F.get(F.transform(used, lambda names: _looked_up(x["runs"], names)), F.lit(0)))

    cut = F.array(F.struct(text.alias("text"), _runs(text).alias("runs"), final_names(renames).alias("names")))
    return F.when(words, F.get(F.transform(cut, once), F.lit(0))).otherwise(_in_turn(text, renames))


def apply_renames(files: DataFrame, suggestions: DataFrame, content: str = "content", threshold: float = 0.7, key: str = "file_id") -> DataFrame:
    """Add ``renamed_content`` and ``renames``; files without accepted suggestions keep their text."""
    joined = files.join(collect_renames(suggestions, threshold, key), key, "left")
    return joined.withColumn("renamed_content", F.when(F.col("renames").isNotNull(), rename_text(F.col(content), F.col("renames"))).otherwise(F.col(content)))


def filter_suggestions(suggestions: DataFrame, language: str = "language") -> DataFrame:
    """Add ``accepted`` and ``skip_reason``: transformations need safe or moderate and more than 0.6, renames more than 0.7
    and a valid new name; other kinds always pass."""
    kind, confidence = F.col("kind"), F.col("confidence")
    is_rename, is_transform = kind == "rename", kind == "transformation"
    bad_safety = is_transform & ~F.coalesce(F.col("safety_level").isin("safe", "moderate"), F.lit(False))
    low = (is_transform & ~(confidence > 0.6)) | (is_rename & ~(confidence > 0.7))
    bad_name = is_rename & ~F.coalesce(valid_name(F.col("new_name"), F.col(language)), F.lit(False))
    return suggestions.withColumn(
        "skip_reason",
        first_match(
            [(bad_safety, "Safety check failed"), (low, F.concat(F.lit("Low confidence: "), confidence.cast("string"))), (bad_name, "Invalid name")],
            F.lit(None).cast("string"),
        ),
    ).withColumn("accepted", F.col("skip_reason").isNull())


# --- related files -------------------------------------------------------------------------------------------------


def related_files(files: DataFrame, n: int = 20, path: str = "original_path", key: str = "file_id") -> DataFrame:
    """Per file the first ``n`` other files (by path) with the same extension.

    The first n+1 paths of an extension serve every file of that extension, so no pairs are formed: the top list is cut
    before its shuffle (window group limit) and the join carries one short array per extension.
    """
    rows = files.select(key, path).withColumn("extension", file_extension(F.col(path)))
    order = W.partitionBy("extension").orderBy(path, key)
    top = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n + 1)
    lists = top.groupBy("extension").agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.col(key).alias("id")))).alias("__top"))
    others = F.slice(F.filter("__top", lambda x: x["id"] != F.col(key)), 1, n)
    return rows.join(lists, "extension").select(key, path, F.transform(others, lambda x: x["path"]).alias("related"))


RELATED = "array<struct<path:string,content_preview:string,size:int>>"


def folder_context(
    scan: DataFrame, n: int = 5, preview: int = 2048, max_size: int = 512 * 1024, path: str = "relative_path", key: str = "file_id"
) -> DataFrame:
    """Per file, of any kind and size: supported files below its folder, number, bytes and lines of those in its language, and the
    ``n`` smallest of these with a text preview.

    The size limit and the language test choose candidates only. Every candidate is listed once per ancestor folder without its
    text; each (folder, language) keeps n+1 of them before the shuffle, and previews are fetched for these winners only.
    """
    usable = scan.filter(F.col("language").isin(dims.REFACTORABLE) & ~F.col("is_binary") & F.col("size_bytes").between(1, max_size))
    parts = F.split(F.col(path), "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    meta = scan.select(key, F.col(path).alias("path"), "language", folder.alias("folder"))
    listed = usable.select(key, F.col(path).alias("path"), "language", "size_bytes", "line_count", F.size(parts).alias("n_parts"))
    ancestors = listed.select(
        key, "path", "language", "size_bytes", "line_count",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("n_parts") - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("folder"),
    )
    stats = ancestors.groupBy("folder", "language").agg(
        F.count("*").alias("language_files"), F.sum("size_bytes").alias("language_bytes"), F.sum("line_count").alias("language_lines")
    )
    totals = stats.groupBy("folder").agg(F.sum("language_files").alias("total_files"))
    order = W.partitionBy("folder", "language").orderBy("size_bytes", "path", key)
    top = ancestors.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n + 1)
    texts = usable.select(key, F.substring("content", 1, preview).alias("content_preview"))
    winners = top.select(key).distinct()
    texts = texts.join(winners, key, "left_semi")
    entry = F.struct("size_bytes", "path", key, "content_preview")
    lists = top.join(texts, key).groupBy("folder", "language").agg(F.array_sort(F.collect_list(entry)).alias("__top"))
    others = F.slice(F.filter("__top", lambda x: x[key] != F.col(key)), 1, n)
    related = F.transform(others, lambda x: F.struct(x["path"].alias("path"), x["content_preview"].alias("content_preview"), x["size_bytes"].alias("size")))
    none = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("total_files", "language_files", "language_bytes", "language_lines")}
    return (
        meta.join(lists, ["folder", "language"], "left").join(stats, ["folder", "language"], "left").join(totals, "folder", "left")
        .select(key, "path", "folder", "language", *none.values(), F.coalesce(related, F.filter(related, lambda x: F.lit(False)), F.array().cast(RELATED)).alias("related_files"))
    )


def mark_fixed(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Rewrite ``Syntax error`` to ``Syntax error (FIXED)`` in the messages of listed paths (exact path)."""
    listed = paths.select(F.col("path").alias("original_path"), F.lit(True).alias("__hit")).distinct()
    hit = F.coalesce(F.col("__hit"), F.lit(False)) & F.lower("error_message").contains("syntax")
    return (
        files.join(listed, "original_path", "left")
        .withColumn("error_message", F.when(hit, F.replace("error_message", F.lit("Syntax error"), F.lit("Syntax error (FIXED)"))).otherwise(F.col("error_message")))
        .drop("__hit")
    )


def remaining_syntax_errors(files: DataFrame) -> DataFrame:
    low = F.lower("error_message")
    return files.filter(low.contains("syntax") & ~low.contains("fixed")).agg(F.count("*").alias("remaining"))


def plausible_fix(df: DataFrame, fixed: str = "fixed", broken: str = "broken") -> DataFrame:
    """Add ``plausible``: at most three times as long and sharing a keyword with the broken text."""
    new, old = F.col(fixed), F.col(broken)
    shares = F.lit(False)
    for w in dims.FIX_KEYWORDS:
        shares = shares | (old.contains(w) & new.contains(w))
    return df.withColumn("plausible", (F.length(new) <= F.length(old) * 3) & shares)

