"""Plan shapes and skew: the properties that must hold when the data grows."""

import re

import pytest
from pyspark.sql import functions as F

from codecorpus.operators import accuracy, compare, history, metrics, ranking, routing, rules
from codecorpus.plans.registry import Tables
from codecorpus.sources import sinks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


def test_top_k_is_cut_before_the_shuffle(t):
    for df in (ranking.band_examples(t.files), ranking.file_history(t.commits, t.changes), ranking.session_failures(t.sessions, t.files),
               compare.related_files(t.files)):
        text = plan(df)
        assert text.count("WindowGroupLimit") >= 2, text  # partial and final


def test_per_file_measures_do_not_shuffle(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS file_id", "text AS content", "'java' AS language", "text AS original_content", "text AS refactored_content")
    for df in (metrics.score_java(files), metrics.counts_cpp(files), compare.diff_stats(files), rules.apply_rules(files), metrics.quality_issues(files, python=False)):
        assert "Exchange" not in plan(df)


def test_analytics_do_not_read_text(t):
    text = plan(accuracy.language_accuracy(t.files))
    scans = [line for line in text.split("\n") if "FileScan" in line]
    assert scans and all("text#" not in s.split("Batched")[0] for s in scans)


def test_filters_reach_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "language")
    assert "PushedFilters: [In(event_type" in plan(routing.by_language(events, ["error", "click"])) or "PushedFilters: [IsNotNull" in plan(routing.by_language(events, ["error"]))


def test_history_never_moves_text(t):
    text = plan(history.version_functions(t.commits, t.changes, t.file_versions))
    moved = [line for line in text.split("\n") if "Exchange" in line or "Arguments: hashpartitioning" in line]
    assert moved and not any("content" in line for line in moved)


def test_no_cross_join_or_unbounded_broadcast(t):
    for df in (accuracy.session_summary(t.sessions, t.files), compare.folder_context(t.scan), history.file_context(t.commits, t.changes, t.file_versions),
               sinks.report(t.sessions, t.files, "2024-01-01", "2024-02-01")):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_extension_and_folder(spark, no_broadcast):
    """A third of all files shares one extension and folder; results equal brute force, without broadcast joins too."""
    rows = [(i, f"hot/f{i:04d}.py" if i % 3 == 0 else f"d{i % 7}/s{i % 5}/f{i:04d}{['.js', '.java', '.c'][i % 3]}") for i in range(600)]
    files = spark.createDataFrame(rows, "file_id bigint, original_path string")
    got = {r.file_id: r.related for r in compare.related_files(files, 5).collect()}
    for i, path in rows:
        ext = path[path.rindex("."):]
        assert got[i] == sorted(p for j, p in rows if p.endswith(ext) and j != i)[:5]

    langs = {".py": "python", ".js": "javascript", ".java": "java", ".c": "c"}
    scan = spark.createDataFrame(
        [(i, p, langs[p[p.rindex("."):]], 10 + (i * 37) % 90, 2, False, f"text {i}") for i, p in rows],
        "file_id bigint, relative_path string, language string, size_bytes int, line_count int, is_binary boolean, content string")
    ctx = {r.file_id: r for r in compare.folder_context(scan, 3).collect()}
    for i, path in rows[:60]:
        folder = path.rsplit("/", 1)[0]
        below = [(10 + (j * 37) % 90, p, j) for j, p in rows if p.startswith(folder + "/")]
        same = sorted(b for b in below if b[1].endswith(path[path.rindex("."):]) and b[2] != i)[:3]
        mine = [b for b in below if b[1].endswith(path[path.rindex("."):])]
        assert (ctx[i].total_files, ctx[i].language_files, ctx[i].language_bytes, ctx[i].language_lines) == (len(below), len(mine), sum(b[0] for b in mine), 2 * len(mine))
        assert [x.path for x in ctx[i].related_files] == [b[1] for b in same]


def test_hot_path_history(spark, no_broadcast):
    commits = spark.range(900).selectExpr("concat('h', id) AS hash", "'a' AS author", "timestamp_seconds(id) AS committed_at", "'m' AS message")
    changes = spark.range(900).selectExpr("concat('h', id) AS hash", "CASE WHEN id % 3 = 0 THEN 'hot.py' ELSE concat('p', id % 50) END AS path", "'M' AS change_type")
    rows = ranking.file_history(commits, changes.union(changes), 10).filter("path = 'hot.py'").orderBy("rank").collect()
    assert [r.hash for r in rows] == [f"h{897 - 3 * k}" for k in range(10)]


def test_routes_and_bands_partition_the_input(t):
    assert routing.route_scan(t.scan, 3000).groupBy("category").count().agg(F.sum("count")).first()[0] == t.scan.count()
    q = accuracy.quality_summary(t.files).first()
    assert q.excellent_count + q.good_count + q.fair_count + q.poor_count == q.files_analyzed
    kept = routing.glob_filter(t.scan, ["*.py"]).count() + routing.glob_filter(t.scan, None, ["*.py"]).count()
    assert kept == t.scan.count()


def test_files_that_are_no_candidates_get_a_context(spark):
    rows = [(0, "d/a.py", "python", 10, 1, False, "a"), (1, "d/big.py", "python", 10**6, 9, False, "b"), (2, "d/x.bin", "unknown", 5, 0, True, None), (3, "d/e.py", "python", 0, 0, False, "")]
    scan = spark.createDataFrame(rows, "file_id bigint, relative_path string, language string, size_bytes int, line_count int, is_binary boolean, content string")
    got = {r.file_id: r for r in compare.folder_context(scan).collect()}
    assert set(got) == {0, 1, 2, 3} and all(r.total_files == 1 for r in got.values())
    assert [x.path for x in got[1].related_files] == ["d/a.py"] and got[0].related_files == [] and got[2].related_files == []


def test_long_files_cost_in_proportion(spark):
    """Twice the lines take about twice the time: line rules and folds do not copy or split what they have read."""
    import time

    from codecorpus.operators import nesting, rules

    def seconds(lines: int) -> float:
        js = "\n".join(f"function f{i}() {{ if (a) {{ if (b) {{ if (c) {{ x(); }} }} }} }}" for i in range(lines))
        one = spark.createDataFrame([(1, "javascript", js)], "file_id bigint, language string, content string")
        start = time.perf_counter()
        rules.apply_rules(one, ["js_doc"]).select("hits").collect()
        nesting.nested_ifs_brace(one).agg(F.count("*")).collect()
        return time.perf_counter() - start

    seconds(500)
    small, large = min(seconds(4000) for _ in range(2)), seconds(16000)
    assert large < 10 * small


def test_findings_meet_their_functions_in_the_row(spark, sf_dir):
    from codecorpus.operators import nesting

    files = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS file_id", "text AS content", "'java' AS language")
    assert "Exchange" not in plan(nesting.nested_ifs_in_functions(files))
    found = nesting.nested_ifs_brace(files)
    assert "Window" not in plan(nesting.enclosing_function(found, files))


def test_inserted_comments_match_once(texts):
    """Inside the fold each mention of a match would run its pattern again."""
    files = texts(("java", "class A {\n  int load(int a) { return load(a); }\n}"), ("cpp", "int run() {}"), ("javascript", "function go() {}"))
    names = files.selectExpr("file_id", "1 AS position", "element_at(array('load', 'run', 'none'), int(file_id) + 1) AS function_name", "'c' AS comment", "'v' AS variable")
    out = rules.add_comments(files, names).select("file_id", "new_content")
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract(") == 2 and "regexp_count" not in text
    got = [r.new_content for r in out.orderBy("file_id").collect()]
    assert got[0].count(" * c") == 1 and got[1:] == ["/**\n * c\n */\nint run() {}", "function go() {}"]


def test_headers_match_once(texts):
    """A header's parts come from one match; a line that begins with the mark between parts is no header, parameters may hold it."""
    from codecorpus.operators.symbols import extract_functions

    files = texts(("python", "def a(x\x01, y):\n  pass\n\x01b\x01c\x01d(e)"), ("java", "  int f(int a)"), ("cpp", "if (x)\n// g(y)\nh(z)"), ("javascript", "const k = (q) => 1\nasync function m(r) {}"))
    out = extract_functions(files.drop("path")).select("file_id", "name", "kind", "params", "signature", "start_line")
    assert "regexp_extract(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.orderBy("file_id", "start_line").collect()] == [
        (0, "a", "def", "x\x01, y", "def a(x\x01, y)", 1), (1, "f", "method", "int a", "package  int f(int a)", 1), (2, "h", "function", "z", "voidh(z)", 3),
        (3, "k", "function", "q", "function k(q)", 1), (3, "m", "function", "r", "function m(r)", 2)]


def test_hot_files_of_a_known_history(t):
    history = ranking.file_history(t.commits, t.changes, 10)
    own, known = ranking.hot_files(t.commits, t.changes), ranking.hot_files(t.commits, t.changes, history=history)
    assert own.exceptAll(known).count() == 0 and own.count() == known.count() > 0
