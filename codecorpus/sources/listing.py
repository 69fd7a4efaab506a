"""Folder trees listed and read by tasks.

Spark's file sources list a tree in the driver, which then holds an object of some hundred bytes for every file, and a stream's source does so
again for each batch. Here a task lists a folder entry by entry, the entries are rows of a table, and the contents are read by tasks from its rows: the
driver knows the depth of the tree and two sums. Names are left out as Spark leaves them out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.sources.workdir import new_folder, shared_root

FOUND = "path string, ms bigint, length bigint, is_folder boolean"
FILES = "path string, modificationTime timestamp, length bigint"
#: Rows and bytes of content of one Arrow batch, what opening a file costs in bytes, and bytes of a task.
ROWS, BYTES, OPEN, TASK_BYTES = 500, 4 << 20, 64 << 10, 128 << 20


def reached(spark: SparkSession, folder: str) -> str | None:
    """The folder's address if pyarrow reaches it too, else None."""
    if not re.match("[a-z0-9]+:", folder):
        folder = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + folder
    address = re.sub("^file:/+", "file:///", folder)
    try:
        FileSystem.from_uri(address)
    except (OSError, ValueError, NotImplementedError):
        return None
    return address


def opened(address: str) -> tuple[FileSystem, str, str]:
    """The file system of an address, the path in it, and what Spark puts before a path."""
    fs, path = FileSystem.from_uri(address)
    return fs, path.rstrip("/"), "file:" if isinstance(fs, LocalFileSystem) else address[: address.rstrip("/").rindex(path.rstrip("/"))]


def hidden(name: str) -> bool:
    """Names that Spark's sources leave out, of files and of folders."""
    return (name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_")) and not name.startswith(("_common_metadata", "_metadata"))


def entries(fs: FileSystem, folder: str) -> Iterator[tuple[str, int, int, bool]]:
    """(path, time of change in milliseconds, bytes, whether it is a folder) of what lies in a folder; a local one is never held whole."""
    if not isinstance(fs, LocalFileSystem):
        for e in fs.get_file_info(FileSelector(folder)):
            if not hidden(e.base_name):
                yield e.path, (e.mtime_ns or 0) // 10**6, e.size or 0, e.type == FileType.Directory
        return
    with os.scandir(folder or "/") as found:
        for e in found:
            if not hidden(e.name):
                try:
                    s = e.stat()
                except FileNotFoundError:  # a link to nothing, or gone since
                    continue
                yield e.path, s.st_mtime_ns // 10**6, s.st_size, e.is_dir()


def listed(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame | None:
    """(path, modificationTime, length) of all files below a folder, of those whose name fits ``pattern`` if there is one. None if pyarrow does not
    reach the folder, or if it is a file, a pattern or nothing: Spark's own source knows what to do then."""
    address = None if re.search(r"[*?\[{\\]", root) else reached(spark, root)
    if address is None:
        return None
    fs, top, _ = opened(address)
    if fs.get_file_info(top or "/").type != FileType.Directory:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _, prefix = opened(address)
        rows = ((prefix + path, *rest) for batch in batches for folder in batch.column(0).to_pylist() for path, *rest in entries(fs, folder.removeprefix(prefix)))
        for some in iter(lambda: [r for _, r in zip(range(10_000), rows)], []):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], ["path", "ms", "length", "is_folder"])

    base, levels = new_folder(spark), []
    folders = spark.createDataFrame([(opened(address)[2] + top,)], "path string")
    while not levels or not folders.isEmpty():
        levels.append(f"{base}/{len(levels)}")
        folders.mapInArrow(run, FOUND).write.parquet(levels[-1])
        folders = spark.read.schema(FOUND).parquet(levels[-1]).where("is_folder").select("path").repartition(tasks(spark), "path")
    files = spark.read.schema(FOUND).parquet(*levels).where("NOT is_folder").select("path", F.timestamp_millis("ms").alias("modificationTime"), "length")
    if pattern:
        fits = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
        files = files.where(F.substring_index("path", "/", -1).rlike(rf"(?s)\A(?:{fits})\z"))
    return files


def tasks(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def spread(files: DataFrame) -> DataFrame:
    """Listed files dealt to tasks by their number and size."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return files.repartition(max(tasks(files.sparkSession), -(-(size + n * OPEN) // TASK_BYTES)), "path")


def with_content(files: DataFrame, address: str) -> DataFrame:
    """Listed files and their ``content``. A batch holds few files and few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _, prefix = opened(address)
        for batch in batches:
            held, size, first = [], 0, 0
            for k, path in enumerate(batch.column(0).to_pylist(), 1):
                with fs.open_input_stream(path.removeprefix(prefix)) as f:
                    held.append(f.read())
                size += len(held[-1])
                if k == batch.num_rows or size >= BYTES or len(held) >= ROWS:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns, pa.array(held, pa.binary())], [*batch.schema.names, "content"])
                    held, size, first = [], 0, k

    return files.mapInArrow(run, f"{FILES}, content binary")


def arrivals(spark: SparkSession, root: str, files_per_part: int) -> str | None:
    """A folder of parquet parts of :func:`listed` files, at most so many in a part, for a stream to read part by part; None where there is no listing.

    Each call lists the tree again and adds the files that are not in a part yet, the oldest first. The folder belongs to the tree and lies in the
    shared folder, so a stream with a checkpoint goes on where it was, as long as it is given the same shared folder.
    """
    files = listed(spark, root)
    if files is None:
        return None
    parts = f"{shared_root(spark)}/codecorpus/listing-{hashlib.md5(reached(spark, root).rstrip('/').encode()).hexdigest()}"
    try:
        known = spark.read.schema(FILES).parquet(parts)
    except AnalysisException:  # the first call
        known = None
    if known is not None:
        files = files.join(known.select("path"), "path", "left_anti").select(*known.columns)
    if known is None or not files.isEmpty():
        files.orderBy("modificationTime", "path").write.mode("append").option("maxRecordsPerFile", files_per_part).parquet(parts)
    return parts
