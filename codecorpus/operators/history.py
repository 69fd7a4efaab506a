"""Commit-history mining: function evolution, naming conventions and refactoring context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codecorpus.functions.language import naming_style
from codecorpus.functions.patterns import file_extension
from codecorpus.operators.ranking import file_history, hot_files, top_per_group
from codecorpus.operators.symbols import extract_functions
from codecorpus.sources.workdir import new_folder


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Most bytes of winning commits that are sent to every worker, and what one takes in a hash table about.
SENT_BYTES, WINNER_BYTES = 64 << 20, 200


def version_functions(
    commits: DataFrame, changes: DataFrame, versions: DataFrame, last: int = 10, history: DataFrame | None = None
) -> DataFrame:
    """Function headers of the last ``last`` commits of every path (``history``: these commits, where they are known already).

    Commits are ranked on keys alone, and what wins is written. If the winners fit into ``SENT_BYTES`` they go to where the versions are read, so that
    only winning texts are cut into headers; else all versions are reduced to headers where they are read and these meet the winners.
    Either way no text is shuffled.
    """
    history = file_history(commits, changes, last) if history is None else history
    winners = written(history.select("path", "hash", "committed_at", "rank"))
    if winners.count() * WINNER_BYTES <= SENT_BYTES:
        return extract_functions(versions.join(F.broadcast(winners), ["path", "hash"]))
    return extract_functions(versions).join(winners, ["path", "hash"])


def function_evolution(functions: DataFrame) -> DataFrame:
    """Functions with more than one version and more than one signature: versions, ordered signatures, confidence 0.8.

    A group holds the versions of one function in the last commits of one file, so its list is bounded.
    """
    order = F.struct("committed_at", "hash", "start_line", "signature")
    out = functions.groupBy("path", "language", "name").agg(
        F.count("*").alias("versions"), F.count_distinct("signature").alias("n_signatures"), F.array_sort(F.collect_list(order)).alias("__v")
    )
    out = out.filter((F.col("versions") > 1) & (F.col("n_signatures") > 1))
    return out.select(
        "path", "language", "name", "versions", F.reverse(F.transform("__v", lambda v: v["signature"])).alias("signatures"),
        F.lit(0.8).alias("confidence"), F.concat(F.lit("Consider standardizing '"), "name", F.lit("' signature")).alias("suggestion"),
    )


def naming_convention(functions: DataFrame, by: str = "language", examples: int = 5, weight: str | None = None) -> DataFrame:
    """Dominant naming style per language: more than five names and one style more than twice the other.

    Names are counted first (``weight``: a column of counts they have already); examples are the most used names of the style, cut before the shuffle.
    """
    names = functions.groupBy(by, "name").agg((F.sum(weight) if weight else F.count("*")).alias("n")).withColumn("style", naming_style(F.col("name")))
    totals = names.groupBy(by).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("style") == "snake", F.col("n"))), F.lit(0)).alias("snake"),
        F.coalesce(F.sum(F.when(F.col("style") == "camel", F.col("n"))), F.lit(0)).alias("camel"),
    )
    style = F.when(F.col("snake") > F.col("camel") * 2, "snake").when(F.col("camel") > F.col("snake") * 2, "camel")
    picked = totals.filter(F.col("total") > 5).withColumn("style", style).filter(F.col("style").isNotNull())
    # Examples follow the underscore test alone, as reported.
    shape = F.when(F.col("name").contains("_"), "snake").otherwise("camel")
    order = W.partitionBy(by, "shape").orderBy(F.desc("n"), "name")
    top = names.withColumn("shape", shape).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= examples)
    lists = top.groupBy(by, F.col("shape").alias("style")).agg(F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("__e"))
    count = F.when(F.col("style") == "snake", F.col("snake")).otherwise(F.col("camel"))
    label = F.when(F.col("style") == "snake", "snake_case").otherwise("camelCase")
    return picked.join(lists, [by, "style"], "left").select(
        by, "style", "total", F.least(F.lit(0.9), count.cast("double") / F.col("total")).alias("confidence"),
        F.transform("__e", lambda e: e["name"]).alias("examples"), F.concat(F.lit("Use "), label, F.lit(" for consistency")).alias("suggestion"),
    )


def related_naming(paths: DataFrame, functions: DataFrame, related: int = 20, commits: int = 5) -> DataFrame:
    """(path, naming, naming_confidence): the convention of the last ``commits`` versions of a file's related files, the first
    ``related`` others of its extension.

    All files of an extension behind the first ones have the same related files, and each of the first ones has those but itself: so there are
    ``related + 1`` lists for an extension, made from one file more than a list has.
    """
    numbered = paths.select("path", file_extension(F.col("path")).alias("ext"))
    first = top_per_group(numbered, ["ext"], [F.col("path")], related + 1).select("path", "ext", "rank")
    recent = functions.where(F.col("rank") <= commits).select("path", "name")
    names = recent.join(first, "path").groupBy("ext", "rank", "name").agg(F.count("*").alias("n"))
    lists = F.filter(F.sequence(F.lit(0), F.lit(related)), lambda k: F.when(k == 0, F.col("rank") <= related).otherwise(k != F.col("rank")))
    listed = names.select("n", "name", "ext", F.explode(lists).alias("k")).withColumn("related", F.concat_ws(":", "ext", "k"))
    naming = naming_convention(listed, "related", weight="n").select("related", F.col("suggestion").alias("naming"), F.col("confidence").alias("naming_confidence"))
    own = F.concat_ws(":", "ext", F.coalesce(F.when(F.col("rank") <= related, F.col("rank")), F.lit(0)))
    return numbered.join(first.select("path", "rank"), "path", "left").select("path", own.alias("related")).join(naming, "related").drop("related")


def file_context(commits: DataFrame, changes: DataFrame, versions: DataFrame) -> DataFrame:
    """Per path: last 10 commits, evolved functions, recent change count, and the suggestions that follow."""
    history = written(file_history(commits, changes, 10))
    per_path = history.groupBy("path").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "hash", "author", "committed_at", "message"))),
            lambda h: F.struct(h["hash"].alias("hash"), h["author"].alias("author"), h["committed_at"].alias("committed_at"), h["message"].alias("message")),
        ).alias("history")
    )
    functions = written(version_functions(commits, changes, versions, history=history).select("path", "language", "hash", "committed_at", "rank", "start_line", "name", "signature"))
    evolved = function_evolution(functions).groupBy("path").agg(F.array_sort(F.collect_list("name")).alias("evolved_functions"))
    naming = related_naming(history.select("path").distinct(), functions)
    languages = versions.select("path", "language").distinct()
    hot = hot_files(commits, changes, history=history).select("path", "recent_changes")
    joined = (
        per_path.join(languages, "path", "left").join(evolved, "path", "left").join(naming, "path", "left").join(hot, "path", "left")
    )
    none = F.expr("cast(array() as array<string>)")
    notes = F.concat(
        F.coalesce(
            F.transform("evolved_functions", lambda n: F.concat(F.lit("Consider reviewing function evolution: Function '"), n, F.lit("' has evolved across commits"))),
            none,
        ),
        F.when(F.col("naming_confidence") > 0.7, F.array(F.concat(F.lit("Follow naming convention: "), F.col("naming")))).otherwise(none),
        F.when(F.col("recent_changes").isNotNull(), F.array(F.lit("File has been frequently modified - consider refactoring for stability"))).otherwise(none),
    )
    return joined.select("path", "language", "history", F.coalesce("evolved_functions", none).alias("evolved_functions"), "recent_changes", notes.alias("suggestions"))
