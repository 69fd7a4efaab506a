"""Reading a directory tree of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecorpus.functions.language import binary_flag, scan_language
from codecorpus.functions.patterns import file_extension, line_total
from codecorpus.sources import listing

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
    ]
)


def scan_corpus(spark: SparkSession, root: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """One row per file: path, relative path, extension, size, modification time and raw content. Tasks list and read a tree; Spark's own source is
    used without recursion and for what is no folder that pyarrow reaches. :func:`codecorpus.sources.listing.listed` gives the files without content."""
    files = listing.listed(spark, root, pattern) if recursive else None
    if files is not None:
        return describe(listing.with_content(listing.spread(files), listing.reached(spark, root)), root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return describe(reader.load(root), root)


def describe(raw: DataFrame, root: str) -> DataFrame:
    plain = F.regexp_replace("path", r"^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/") + "/"
    relative = F.when(plain.startswith(base), F.substr(plain, F.lit(len(base) + 1))).otherwise(plain)
    return raw.select(
        "path", relative.alias("relative_path"), file_extension(relative).alias("extension"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"), F.col("content").alias("raw"),
    )


def decoded(raw: Column) -> Column:
    """UTF-8 when valid, UTF-16 when a byte-order mark says so, else latin-1.

    UTF-16 without a mark is not guessed: almost any even-length byte string decodes to something.
    """
    mark = F.hex(F.substring(raw, 1, 2))
    utf8 = F.decode(raw, "UTF-8")
    return (
        F.when(F.is_valid_utf8(raw.cast("string")), utf8)
        .when(mark.isin("FFFE", "FEFF"), F.decode(raw, "UTF-16"))
        .otherwise(F.decode(raw, "ISO-8859-1"))
    )


def decode_text(df: DataFrame, raw: str = "raw", out: str = "content") -> DataFrame:
    return df.withColumn(out, decoded(F.col(raw)))


def scanned(df: DataFrame) -> DataFrame:
    """Binary flag, text, line count, md5 and scanner language of raw files."""
    df = df.withColumn("is_binary", binary_flag(F.col("relative_path"), F.col("raw")))
    usable = ~F.col("is_binary") & (F.col("size_bytes") > 0)
    df = df.withColumn("content", F.when(usable, decoded(F.col("raw")))).drop("raw")
    df = df.withColumns({"line_count": F.when(usable, line_total(F.col("content"))).otherwise(0), "file_hash": F.when(usable, F.md5("content")).otherwise("")})
    return scan_language(df, "relative_path")
