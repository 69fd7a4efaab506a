"""Registry of named queries: a DataFrame builder over the given tables and, where SQL can express it, an oracle."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.plans.bindings import BINDINGS, with_tables
from codecorpus.session import SETTINGS
from codecorpus.sources.workdir import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Given tables of one folder and the bindings on top of them, resolved on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}
        for key in ("spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
            spark.conf.set(key, SETTINGS[key])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE_TABLES and name not in BINDINGS):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return instants(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
        sql, needs = BINDINGS[name]
        return self.sql(sql, *needs)

    def sql(self, text: str, *needs: str) -> DataFrame:
        """Run SQL over bound tables; each table name is replaced by a private view."""
        views = []
        for need in needs:
            view = f"cc_{need}_{uuid.uuid4().hex[:8]}"
            getattr(self, need).createOrReplaceTempView(view)
            text = re.sub(rf"\b(FROM|JOIN) {need}\b", rf"\1 {view}", text)
            views.append(view)
        out = self.spark.sql(text)
        for view in views:
            self.spark.catalog.dropTempView(view)  # the analysed plan holds what it needs
        return out

    @cached_property
    def folder(self) -> str:
        """A fresh folder in the shared work area for queries that write before they read."""
        return new_folder(self.spark)


def instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as UTC instants (the session zone is UTC), which watermarks and epoch functions need."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def query(name: str, *needs: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``oracle`` is SQL over the bindings named in ``needs``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_tables(*needs, rest=oracle)
        return fn

    return wrap
