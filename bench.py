"""Time the headline queries (``BENCH_ALL=1``: every registered query) with a no-op sink and print one JSON line.

``queries`` holds warm times (second run); ``cold`` the first run of each query including planning; ``shuffle_mb`` what the warm
run wrote to shuffles, read from Spark's event log. The tables are first laid out as folders of several files, as a cluster would hold
them: the given ones are one file with one row group each, which only one task can read.
"""

from __future__ import annotations

import glob
import json
import os
import tempfile
import time

from codecorpus.plans.catalog import QUERIES
from codecorpus.session import local_session

HEADLINE = [
    "a1_overall_accuracy", "a2_language_accuracy", "a8_improvement_accuracy", "a10_session_summary", "a20_language_stats", "c1_language_by_ext",
    "c2_language_by_content", "f1_skip_dirs", "f9_route_processing", "f10_in_window", "h1_function_evolution", "h2_naming_convention",
    "j4_diff_stats", "j8_apply_renames", "j10_related_files", "m1_file_facts", "m3_score_javascript", "m8_score", "m11_counts_java",
    "m19_magic_number_totals", "n1_nested_ifs_indent", "n2_nested_ifs_brace", "n3_nested_ifs_python", "p1_python_facts", "q2_health",
    "r_rule_totals", "t3_clean_response", "w6_file_history", "w7_hot_files", "y2_symbols_java", "y5_extract_functions",
]


def laid_out(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables, each in ``files`` files."""
    out = tempfile.mkdtemp(prefix="codecorpus-bench-")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        spark.read.parquet(path).repartition(files).write.parquet(f"{out}/{os.path.basename(path)}")
    return out


def shuffle_mb(folder: str, spans: dict[str, tuple[float, float]]) -> dict[str, float]:
    """MB that tasks launched within each span (seconds) wrote to shuffles, by the event log in ``folder``."""
    out = dict.fromkeys(spans, 0.0)
    for path in glob.glob(f"{folder}/*"):
        with open(path) as log:
            for event in (json.loads(line) for line in log if '"SparkListenerTaskEnd"' in line):
                launched = event["Task Info"]["Launch Time"] / 1000
                written = (event.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                for name, (start, end) in spans.items():
                    if start <= launched <= end:
                        out[name] += written / 1e6
    return {name: round(mb, 2) for name, mb in out.items()}


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    events = tempfile.mkdtemp(prefix="codecorpus-events-")
    log = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{events}", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"}
    spark = local_session("codecorpus-bench", cpus, **log)
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    tables = laid_out(spark, sf_dir, int(cpus))
    cold, warm, spans = {}, {}, {}
    for name in names:
        cold[name] = timed(spark, name, tables)
        start = time.time()
        warm[name] = timed(spark, name, tables)
        spans[name] = (start, time.time())
    spark.stop()
    moved = shuffle_mb(events, spans)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "shuffle_mb": moved, "sf": sf}))


if __name__ == "__main__":
    main()
