"""Side-by-side run of registered queries and their DuckDB oracles (order-insensitive, columns sorted by name)."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import time

from pyspark.sql import DataFrame, SparkSession

from codecorpus.plans import registry
from codecorpus.session import local_session


def canonical(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(canonical(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), canonical(v)) for k, v in value.items()))
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df: DataFrame = registry.QUERIES[name](spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    if name not in registry.ORACLES:
        return None if mine else "no rows"
    cur = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if not mine:
        return "no rows"
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:2]
        only_theirs = [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} vs {len(theirs)} rows\n   spark {str(only_mine)[:900]}\n   duck  {str(only_theirs)[:900]}"
    return None


def check_all(sf_dir: str, prefixes: list[str]) -> list[str]:
    import codecorpus.plans.catalog  # noqa: F401  registers everything

    spark = local_session("codecorpus-check")
    con = duck(sf_dir)
    failed = []
    for name in registry.QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "D" if name in registry.ORACLES else "G"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:5.1f}s {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    return failed
