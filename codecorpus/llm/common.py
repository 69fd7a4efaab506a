"""What the operators of this package share: the definition of a word, reading tables and writing intermediate ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.sources.workdir import new_folder

#: A word is a run of characters that are not ASCII white space (``bytes.split`` cuts at the same characters).
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"

#: Bytes and rows of one Arrow batch: a batch is cut at whichever comes first, so long texts do not pile up in a worker.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and nothing is computed twice."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once per row although the body may use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Most bytes of ids that are broadcast, and what a row and each of its columns take in a worker's hash table about.
BROADCAST_BYTES, ROW_BYTES, COLUMN_BYTES = 64 << 20, 48, 16


def without(docs: DataFrame, ids: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``ids`` (a written table). Texts stay where they are unless the ids outgrow a broadcast."""
    size = ids.count() * (ROW_BYTES + COLUMN_BYTES * len(ids.columns))
    return docs.join(F.broadcast(ids) if size <= BROADCAST_BYTES else ids, key, "left_anti")


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
