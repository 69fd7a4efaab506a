"""Reports and exports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.operators import accuracy
from codecorpus.operators.routing import in_window
from codecorpus.sources.listing import reached


def report(sessions: DataFrame, files: DataFrame, start, end) -> DataFrame:
    """One nested row over the sessions created in [start, end] and their files: period, overall accuracy, language metrics,
    quality, errors, validation.

    The parts are tiny aggregates (one row, or one per language or class); each is packed into a struct or map in one row.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(name))

    def keyed(df: DataFrame, key: str, name: str) -> DataFrame:
        values = [c for c in df.columns if c != key]
        entry = F.struct(F.col(key).alias("key"), F.struct(*values).alias("value"))
        return df.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))

    sessions, files = in_window(sessions, files, F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    parts = [
        packed(accuracy.overall_accuracy(sessions, files), "overall_accuracy"),
        keyed(accuracy.language_accuracy(files), "language", "language_metrics"),
        packed(accuracy.quality_summary(files), "quality_metrics"),
        keyed(accuracy.failure_classes(files), "error_class", "error_patterns"),
        keyed(accuracy.error_rate(files), "language", "error_by_language"),
        packed(accuracy.validation_accuracy(files), "validation_metrics"),
    ]
    period = F.struct(F.lit(start).cast("timestamp").alias("start_date"), F.lit(end).cast("timestamp").alias("end_date"))
    return accuracy.one_row(*parts).withColumn("analysis_period", period)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Per-file results, one folder per language. The writer sorts by language within a task, so no shuffle is needed and a
    dominant language is written by many tasks."""
    df.write.mode("overwrite").partitionBy("language").format(fmt).save(path)


def exported(files: DataFrame) -> DataFrame:
    """(session, path, content): refactored text if non-empty, else the original."""
    text = F.coalesce(F.nullif(F.col("refactored_content"), F.lit("")), F.col("original_content"))
    return files.select("session_id", F.col("original_path").alias("path"), text.alias("content"))


def export_corpus(files: DataFrame, path: str, sessions: DataFrame | None = None) -> None:
    """Exported texts of completed sessions (all sessions when none are given), one folder per session."""
    if sessions is not None:
        files = files.join(sessions.filter(F.col("status") == "completed").select("session_id"), "session_id", "left_semi")
    exported(files).write.mode("overwrite").partitionBy("session_id").parquet(path)


def dataset_metadata(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("total_examples"), F.array_sort(F.collect_set("language")).alias("languages"),
        F.array_sort(F.collect_set("pattern")).alias("patterns"),
    )


def write_dataset(pairs: DataFrame, path: str) -> None:
    """Examples and a metadata document side by side."""
    pairs.write.mode("overwrite").json(f"{path}/examples")
    dataset_metadata(pairs).write.mode("overwrite").json(f"{path}/metadata")


def _folder_name(column: str, value: str | None) -> str:
    """The name Spark's partitioned writers give the folder of a value."""
    plain = re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value or "")
    return f"{column}={plain or '__HIVE_DEFAULT_PARTITION__'}"


def write_tree(df: DataFrame, value: str, by: str, folder: str) -> None:
    """Every row's text, and a line feed, as a text file of its own, one folder for each value of ``by``.

    Tasks create the files themselves: the partitioned text writer sets the rights of every file by a process of its own on a local file system, and its
    driver then moves all files one after the other. It is used where pyarrow does not reach the folder. A task that is run again writes the same names.
    """
    address = reached(df.sparkSession, folder)
    if address is None:
        df.select(by, F.col(value).alias("value")).write.option("maxRecordsPerFile", 1).partitionBy(by).text(folder)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(address)
        task, made, n = TaskContext.get().partitionId(), set(), 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = _folder_name(by, key)
                if name not in made:
                    fs.create_dir(f"{root}/{name}")
                    made.add(name)
                with fs.open_output_stream(f"{root}/{name}/part-{task:05d}-{n:09d}.txt") as out:
                    out.write(f"{text or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    FileSystem.from_uri(address)[0].create_dir(FileSystem.from_uri(address)[1])
    df.select(F.col(by).cast("string"), value).mapInArrow(run, "files bigint").agg(F.sum("files")).collect()
