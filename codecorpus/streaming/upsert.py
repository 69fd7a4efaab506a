"""Keyed tables that micro-batches are applied to, and the split of a stream into rows in time and late rows.

A table is a base and one delta for each batch since. A batch is applied once: its delta is overwritten if it was written before, and a batch the
pointer knows already is left out, so killed and repeated batches give the same table. Every ``compact_every`` batches base and
deltas become a new base, in buckets by key, and what they replace is emptied; so a read opens one base and a bounded number of deltas, however
many batches there have been. The pointer, one row, is written to two folders in turn: if writing one is cut short the other still holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Pointer:
    """One row of longs by name, replaced as a whole."""

    def __init__(self, spark: SparkSession, folder: str, **fields: int):
        self.spark, self.folder, self.start = spark, folder, fields
        self.schema = ", ".join(f"{name} long" for name in ["turn", *fields])

    def _read(self, k: int) -> list:
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{k}").collect()
        except AnalysisException:  # not written yet
            return []

    def get(self) -> dict[str, int]:
        rows = [r.asDict() for k in (0, 1) for r in self._read(k)]
        return max(rows, key=lambda r: r["turn"], default={"turn": -1} | self.start)

    def set(self, **fields: int) -> None:
        new = self.get() | fields
        new["turn"] += 1
        one = self.spark.createDataFrame([tuple(new[n] for n in ["turn", *self.start])], self.schema)
        one.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{new['turn'] % 2}")


class UpsertTable:
    """A keyed table. Of the rows of a key the newest batch's counts, within a batch the greatest by ``order``; with ``totals`` (column ->
    aggregate) rows of a key are added up instead. Rows whose ``deleted`` is true delete their key. ``keep`` is applied when the table is
    compacted: rows it filters out expire."""

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], order: list[str] = (), totals: dict[str, Callable[[str], Column]] | None = None,
        deleted: str | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 8, compact_every: int = 10,
    ):
        self.spark, self.folder, self.keys, self.order, self.totals, self.deleted, self.keep = spark, folder, keys, list(order), totals, deleted, keep
        self.buckets, self.compact_every = buckets, compact_every
        self.columns = schema.fieldNames()
        self.schema = T.StructType([*schema.fields, T.StructField("__batch", T.LongType())])
        self.pointer = Pointer(spark, f"{folder}/pointer", last=-1, base=-1)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        at = self.pointer.get()
        if batch_id <= at["last"]:
            return
        self._combined(batch.withColumn("__batch", F.lit(batch_id).cast("long"))).write.mode("overwrite").parquet(f"{self.folder}/delta/{batch_id}")
        self.pointer.set(last=batch_id)
        if batch_id - at["base"] >= self.compact_every:
            self.compact()

    def _combined(self, rows: DataFrame) -> DataFrame:
        """One row for each key."""
        grouped = rows.groupBy(*self.keys)
        if self.totals:
            return grouped.agg(*[fn(c).alias(c) for c, fn in self.totals.items()], F.max("__batch").alias("__batch"))
        rest = [c for c in [*self.columns, "__batch"] if c not in self.keys]
        return grouped.agg(F.max_by(F.struct(*rest), F.struct("__batch", *self.order)).alias("__n")).select(*self.keys, "__n.*")

    def _rows(self) -> DataFrame:
        at = self.pointer.get()
        names = [*self.columns, "__batch"]
        paths = [f"{self.folder}/delta/{k}" for k in range(at["base"] + 1, at["last"] + 1)]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        if at["base"] >= 0:
            rows = rows.select(*names).unionByName(self.spark.read.schema(self.schema).parquet(f"{self.folder}/base/{at['base']}").select(*names))
        rows = self._combined(rows)
        return rows.where(~F.col(self.deleted)) if self.deleted else rows

    def read(self) -> DataFrame:
        return self._rows().select(*self.columns)

    def files(self) -> int:
        """Folders that a read opens."""
        at = self.pointer.get()
        return at["last"] - at["base"] + (at["base"] >= 0)

    def compact(self) -> None:
        at = self.pointer.get()
        rows = self._rows()
        rows = self.keep(rows) if self.keep else rows
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        rows.repartition(self.buckets, *self.keys).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base/{at['last']}")
        self.pointer.set(base=at["last"])
        old = [f"delta/{k}" for k in range(at["base"] + 1, at["last"] + 1)] + [f"base/{at['base']}"] * (at["base"] >= 0)
        for path in old:
            self.spark.createDataFrame([], self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{path}")


def upserting(stream: DataFrame, table: UpsertTable, folder: str, mode: str = "append", then: Callable[[DataFrame, int], None] | None = None):
    """Applies everything available to ``table``; ``then(batch, batch_id)`` runs after each batch is applied. Returns the finished query."""

    def save(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, batch_id)
        if then:
            then(batch, batch_id)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return query


class LateSplit:
    """Splits a stream's rows by a watermark: the greatest time of earlier batches less the delay. No row is lost: what lies behind the watermark
    is kept as rows of its own beside the others, so that it can be counted, looked at and applied later."""

    def __init__(self, stream: DataFrame, folder: str, time: str = "ts", delay: str = "10 minutes"):
        self.stream, self.folder, self.time = stream, folder, time
        self.delay = stream.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {delay})")).first()[0]
        self.pointer = Pointer(stream.sparkSession, f"{folder}/pointer", last=-1, watermark=-(1 << 62))

    def _save(self, batch: DataFrame, batch_id: int) -> None:
        at = self.pointer.get()
        if batch_id <= at["last"]:
            return
        us, seen = F.unix_micros(self.time), Observation()
        marked = batch.withColumn("late", F.coalesce(us < at["watermark"], F.lit(False))).observe(seen, F.max(us).alias("most"))
        marked.write.mode("overwrite").parquet(f"{self.folder}/rows/batch_id={batch_id}")
        most = seen.get["most"]
        self.pointer.set(last=batch_id, watermark=at["watermark"] if most is None else max(at["watermark"], most - self.delay))

    def run(self) -> DataFrame:
        """All rows so far, with ``late`` and the ``batch_id`` they came in. A row without a time is not late."""
        stream = self.stream.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).foreachBatch(self._save).start()
        stream.awaitTermination()
        schema = T.StructType([*self.stream.schema.fields, T.StructField("late", T.BooleanType()), T.StructField("batch_id", T.LongType())])
        try:
            return self.stream.sparkSession.read.schema(schema).parquet(f"{self.folder}/rows")
        except AnalysisException:  # nothing has arrived
            return self.stream.sparkSession.createDataFrame([], schema)
