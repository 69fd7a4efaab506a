"""URL filters as a sort-merge range join.

A rule (host, path) becomes the key ``reversed host labels + "." + path``: a url fits the rule if one of its own keys, made
from a suffix of its host, starts with the rule's key. Keys that start with ``k`` form an interval in sorted order, and such
intervals are nested or apart. A sweep over the sorted keys of rules and urls keeps the stack of open rules, one slot for
each nesting level; the deepest slot whose rule still covers the key is the longest match.

Only column expressions and windows are used. Distinct (host, path) pairs are judged once, so a hot host costs little; they
are dealt to sweeps by a hash, and each sweep gets the (few) rules too, so no range of keys becomes one large task.

Defined results: a null url or one without ``://`` has an empty host and path; an empty host fits no rule, nor does an empty
path, even if a rule of its host has an empty path too: a rule for all of a host should have the path ``/``. Rules with a null part are ignored; of equal rules, a block wins. With no rules every
url gets the default verdict. Repeated rows stay; an empty table gives no rows; columns of the input named ``host``,
``path``, ``rule`` or ``verdict`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import lower_ascii, stored, table

#: Fixed rules of the registered query.
QUERY_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
RULE_SCHEMA = "host string, path string, verdict string"
#: Least number of sweeps that the urls are dealt to, and urls of a sweep; each sweep gets all rules.
SWEEPS, SWEEP_URLS = 64, 1_000_000


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def nested(rules: DataFrame) -> DataFrame:
    """Distinct rules with their ``key``, number of labels ``depth``, and ``level``: how many other rules of as many labels
    enclose them. The level is the height of the stack in a sweep over the openings and closings of the rules."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").withColumn("host", lower_ascii(F.col("host")))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumns({"labels": reversed_labels(F.col("host"))}).withColumns({"depth": F.size("labels"), "key": F.concat(F.array_join("labels", "."), F.lit("."), F.col("path"))})
    shut = F.concat(F.hex("key"), F.lit("~"))  # after the hex form of every longer key
    events = rules.select("host", "path", "verdict", "depth", "key", F.explode(F.array(
        F.struct(F.hex("key").alias("at"), F.lit(1).alias("step")), F.struct(shut.alias("at"), F.lit(-1).alias("step")),
    )).alias("e"))
    # Rules can only nest below the same host, so the sweep over rules is split by host.
    height = F.sum("e.step").over(Window.partitionBy("host").orderBy("e.at", "e.step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("level", height - 1).where("e.step = 1").select("host", "path", "verdict", "depth", "key", "level")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", sweeps: int | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``. The number of sweeps follows that of the pages."""
    sweeps = sweeps or max(SWEEPS, -(-pages.count() // SWEEP_URLS))
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    held = stored(nested(rules))
    depth, levels = held.agg(F.coalesce(F.max("depth"), F.lit(0)), F.coalesce(F.max("level"), F.lit(-1))).first()

    pairs = pages.select("host", "path").distinct().where("host <> '' AND path <> ''")
    labels = reversed_labels(F.col("host"))
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))) if depth else F.array().cast("array<int>")
    asked = pairs.withColumn("depth", F.explode(depths)).select(
        F.pmod(F.xxhash64("host", "path"), F.lit(sweeps)).alias("sweep"), "host", "path",
        F.concat(F.array_join(F.slice(labels, 1, F.col("depth")), "."), F.lit("."), F.col("path")).alias("key"),
        "depth", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    opened = held.withColumn("sweep", F.explode(F.sequence(F.lit(0), F.lit(sweeps - 1)))).select(
        F.col("sweep").cast("bigint").alias("sweep"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", "depth",
        F.col("level").cast("int").alias("level"), F.concat("host", "path").alias("rule"), "verdict",
    )
    # A key of depth d meets rules of depth d only: labels are part of the key, and levels are counted per host.
    order = Window.partitionBy("sweep", "depth").orderBy("key", F.col("level").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = asked.unionByName(opened)
    slot = F.struct(F.col("key").alias("key"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    swept = swept.select("*", *[F.last(F.when(F.col("level") == n, slot), ignorenulls=True).over(order).alias(f"open{n}") for n in range(levels + 1)])
    covers = [F.when(F.startswith("key", F.col(f"open{n}.key")), F.col(f"open{n}")) for n in reversed(range(levels + 1))]
    top = F.coalesce(*covers) if covers else F.lit(None).cast("struct<key:string,rule:string,verdict:string>")
    hits = swept.where("level IS NULL").withColumn("top", top).where("top IS NOT NULL")
    # The longest rule wins; of equally long ones, that of the longer host.
    best = hits.groupBy("sweep", "host", "path").agg(F.max(F.struct(F.length("top.rule").alias("n"), "depth", "top.rule", "top.verdict")).alias("best"))
    best = best.select("host", "path", "best.rule", "best.verdict")
    return pages.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in QUERY_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS rverdict
    FROM (SELECT DISTINCT host, path FROM h) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, h.host, h.path, rule, coalesce(rverdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.host = m.host AND h.path = m.path
"""
