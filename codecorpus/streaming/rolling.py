"""Rolling lists of the errors of each session, kept as state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from codecorpus.streaming.upsert import UpsertTable, upserting

#: State that grows and shrinks entry by entry needs this store; the session must use it before the query starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

CHANGES = (
    T.StructType().add("session_id", "string").add("event_id", "long").add("ts", "timestamp").add("error_type", "string").add("message", "string").add("expired", "boolean")
)


#: Buckets of sessions. A call into Python costs more than the entries of one session, so the sessions of a bucket share its calls.
BUCKETS = 512


class RollingErrors(StatefulProcessor):
    """State of a bucket of sessions: their errors of the last ``keep`` microseconds, one entry each. An error leaves when the watermark passes its time
    by ``keep``; timers fire on multiples of ``grain`` only, and what is due by then leaves together, so a list is rewritten once a grain at most and
    not once an error. Gives out each error once as it comes and once, with ``expired``, as it leaves."""

    def __init__(self, keep: int, grain: int):
        self.keep, self.grain = keep, grain

    def init(self, handle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "session_id string, us long, event_id long, error_type string, message string")

    def _wake(self, oldest: int) -> None:
        """A timer at the first multiple of the grain after ``oldest`` has to leave."""
        at = -(-(oldest + self.keep) // self.grain) * self.grain // 1000
        if not any(t <= at for t in self._timers()):
            self.handle.registerTimer(at)

    def _timers(self) -> list[int]:
        return [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]

    @staticmethod
    def _frame(entries: list[tuple], expired: bool) -> pd.DataFrame:
        session, us, event, kind, message = zip(*entries)
        return pd.DataFrame({
            "session_id": session, "event_id": event, "ts": pd.to_datetime(list(us), unit="us"), "error_type": kind, "message": message, "expired": [expired] * len(entries),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = None
        for part in rows:
            entries = list(zip(part["session_id"].tolist(), part["us"].tolist(), part["event_id"].tolist(), part["error_type"].tolist(), part["message"].tolist()))
            self.live.appendList(entries)
            first = min(e[1] for e in entries)
            oldest = first if oldest is None else min(oldest, first)
            yield self._frame(entries, False)
        if oldest is not None:
            self._wake(oldest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        upto = now // self.grain * self.grain - self.keep
        kept, gone = [], []
        for entry in self.live.get():
            (gone if entry[1] <= upto else kept).append(tuple(entry))
        if kept:
            self.live.put(kept)
            self._wake(min(e[1] for e in kept))
        else:
            self.live.clear()
        if gone:
            yield self._frame(gone, True)

    def close(self) -> None:
        pass


def rolling_changes(errors: DataFrame, keep_hours: int = 24, grain_minutes: int = 60, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(session_id, event_id, ts, error_type, message, expired): each error of a session when it comes and when it leaves the last ``keep_hours``."""
    marked = errors.where("session_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket")
    kept = marked.select(bucket, "session_id", "ts", "us", "event_id", "error_type", "message")
    work = RollingErrors(keep_hours * 3_600_000_000, grain_minutes * 60_000_000)
    return kept.groupBy("bucket").transformWithStateInPandas(work, CHANGES, "append", "eventTime")


def rolling_lists(errors: DataFrame, folder: str, keep_hours: int = 24, **more) -> tuple[DataFrame, list[dict]]:
    """Runs the stream over what is there. Returns the lists at every batch end, (batch_id, session_id, event_id, ts, error_type, message), and for each batch
    the entries of state. The list at a batch end holds the errors newer than ``keep_hours`` before the newest error so far."""
    spark = errors.sparkSession
    for key, value in STORE.items():
        spark.conf.set(key, value)
    table = UpsertTable(spark, f"{folder}/live", CHANGES, ["session_id", "event_id"], order=["expired"], deleted="expired")

    def save(batch: DataFrame, batch_id: int) -> None:
        # The newest error is always in the table: it is what others are measured by.
        live = table.read()
        newest = live.agg(F.max("ts").alias("newest")).first().newest
        if newest is not None:
            at = F.lit(newest).cast("timestamp") - F.make_dt_interval(hours=F.lit(keep_hours))
            live.where(F.col("ts") > at).drop("expired").write.mode("overwrite").parquet(f"{folder}/lists/batch_id={batch_id}")

    query = upserting(rolling_changes(errors, keep_hours, **more), table, folder, then=save)
    held = [{"batch_id": p["batchId"], "entries": sum(s["numRowsTotal"] for s in p["stateOperators"])} for p in query.recentProgress]
    schema = T.StructType([f for f in CHANGES.fields if f.name != "expired"] + [T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/lists"), held
