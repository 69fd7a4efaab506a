import uuid

from pyspark.sql import functions as F

from codecorpus.plans.q_streams import bound, stream
from codecorpus.plans.registry import Tables
from codecorpus.sources import corpus, tables
from codecorpus.streaming import monitor as s


def test_stream_health_equals_batch_for_closed_windows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    live, _ = s.run_available(s.health(stream(t, "error_events"), 1), t.folder)
    batch = s.health(t.error_events, 1)
    assert live.exceptAll(batch).count() == 0
    closed = t.error_events.agg((F.max("ts") - F.expr("interval 20 minutes")).alias("m")).first().m
    assert batch.filter(F.col("window_end") < F.lit(closed)).exceptAll(live).count() == 0


def test_stream_pairs_equal_batch(spark, sf_dir):
    t = Tables(spark, sf_dir)
    log = t.log_events
    split = lambda d: (d.filter("phase = 'start'").select("operation_id", "ts", "operation_type"), d.filter("phase = 'end'").select("operation_id", "ts"))
    live, _ = s.run_available(s.pair_operations(*split(stream(t, "log_events"))), t.folder)
    batch = s.pair_operations(*split(log))
    assert live.filter("state = 'completed'").exceptAll(batch).count() == 0
    assert batch.filter("state = 'completed'").exceptAll(live).count() == 0


def test_session_errors_and_restart(spark, sf_dir):
    t = Tables(spark, sf_dir)
    keys = ["session_id", "window_start"]
    live, _ = s.run_available(s.session_errors(stream(t, "error_events")), t.folder, "update", keys)
    batch = s.session_errors(t.error_events)
    assert live.select(*batch.columns).exceptAll(batch).count() == 0 and live.count() == batch.count()
    # A second run on the same checkpoint finds nothing new and leaves the result as it is.
    again, _ = s.run_available(s.session_errors(stream(t, "error_events")), t.folder, "update", keys)
    assert again.count() == live.count()


def test_late_rows_are_counted(spark, sf_dir):
    from codecorpus.plans.catalog import QUERIES

    r = QUERIES["q8_late_events"](spark, sf_dir).first()
    assert r.dropped_late > 0 and r.windows > 0


def test_corpus_from_files(spark, tmp_path):
    root = tmp_path / "c"
    (root / "src" / ".git").mkdir(parents=True)
    (root / "src" / "a.py").write_text("def f():\n    return 'é'\n", "utf-8")
    (root / "src" / "b.txt").write_bytes("#!/usr/bin/env python\nx\n".encode("latin-1"))
    (root / "src" / "c.js").write_bytes("let a = 'é'".encode("latin-1"))
    (root / "d.md").write_bytes("# Té".encode("utf-16"))
    (root / "e.bin").write_bytes(b"\x00\x01")
    raw = corpus.scan_corpus(spark, str(root))
    got = {r.relative_path: r for r in corpus.scanned(raw).collect()}
    assert set(got) == {"src/a.py", "src/b.txt", "src/c.js", "d.md", "e.bin"}
    assert (got["src/a.py"].language, got["src/a.py"].line_count) == ("python", 3)
    assert got["src/b.txt"].language == "python" and got["e.bin"].is_binary
    assert got["src/c.js"].content == "let a = 'é'"
    assert {r.relative_path: r.content for r in corpus.decode_text(raw).collect()}["d.md"].lstrip("﻿") == "# Té"
    assert {r.relative_path for r in corpus.scan_corpus(spark, str(root), recursive=False).collect()} == {"d.md", "e.bin"}
    out, _ = s.run_available(s.stream_corpus(spark, str(root / "src")), str(tmp_path / uuid.uuid4().hex))
    assert {r.relative_path: r.language for r in out.collect()} == {"a.py": "Python", "b.txt": "Text", "c.js": "JavaScript"}


def test_log_documents(spark, tmp_path):
    doc = '{"session_summary": {"session_id": "s1"},\n "log_entries": [{"level": "info", "message": "a", "metadata": {"k": 1}}, {"level": "error"}]}'
    (tmp_path / "l.json").write_text(doc)
    rows = tables.read_log_exports(spark, str(tmp_path), multi_line=True).collect()
    assert [(r.session_id, r.level) for r in rows] == [("s1", "info"), ("s1", "error")] and rows[0].metadata == {"k": "1"}


def test_commit_lines(spark):
    lines = spark.createDataFrame([("h|a|2024-03-01 10:00:00 +0200|fix | more",), ("h|a|x",), ("h|a|bad|m",)], "value string")
    rows = tables.parse_commits(lines).collect()
    assert [(r.message, str(r.committed_at)) for r in rows] == [("fix | more", "2024-03-01 08:00:00"), ("m", "None")]


def test_bound_view_reads_the_given_stream(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert bound(t, t.events, "requests").count() == t.requests.count()


def errors(spark, rows):
    return spark.createDataFrame([(i, t, "k", "m", who) for i, t, who in rows], "event_id long, ts string, error_type string, message string, session_id string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_rolling_lists_at_every_batch_end(spark, tmp_path):
    """Errors on both sides of midnight: each leaves the list 24 hours after it came, whatever batch brings the later ones; state shrinks with it."""
    from codecorpus.streaming.rolling import rolling_lists

    batches = [
        [(1, "2024-01-01 23:59:00", "a"), (2, "2024-01-01 12:00:00", "a"), (3, "2024-01-01 23:59:59", "b"), (9, "2024-01-01 10:00:00", None)],
        [(4, "2024-01-02 00:01:00", "a"), (5, "2024-01-02 23:58:59", "c")],
        [(6, "2024-01-02 23:59:00", "c")],
        [(7, "2024-01-03 00:00:30", "b")],
        [(8, "2024-01-20 00:00:00", "b")],
    ]
    for k, rows in enumerate(batches):
        errors(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(errors(spark, batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lists, held = rolling_lists(source, str(tmp_path / "run"))
    got = {}
    for r in lists.collect():
        got.setdefault(r.batch_id, set()).add((r.session_id, r.event_id))
    want = [{("a", 1), ("a", 2), ("b", 3)}, {("a", 1), ("b", 3), ("a", 4), ("c", 5)}, {("b", 3), ("a", 4), ("c", 5), ("c", 6)}, {("a", 4), ("c", 5), ("c", 6), ("b", 7)}, {("b", 8)}]
    assert [got[k] for k in range(5)] == want
    assert max(h["entries"] for h in held) > held[-1]["entries"]


def test_keyed_table_of_batches(spark, tmp_path):
    """Repeated and killed batches change nothing, deleted keys leave, and a read opens few folders however many batches there were."""
    from codecorpus.streaming.upsert import UpsertTable

    frame = lambda *rows: spark.createDataFrame(rows, "k int, v int, gone boolean")
    make = lambda: UpsertTable(spark, str(tmp_path / "t"), frame().schema, ["k"], order=["v"], deleted="gone", compact_every=3)
    table, want = make(), {}
    for batch in range(8):
        rows = [(batch % 3, batch, False), (batch % 3, batch - 100, False), (10 + batch, 1, False), (9 + batch, 1, True)]
        want[batch % 3] = batch
        want[10 + batch] = 1
        want.pop(9 + batch, None)
        if batch == 4:  # killed after the delta, before the pointer
            frame((77, 7, False)).withColumn("__batch", F.lit(4).cast("long")).write.parquet(str(tmp_path / "t/delta/4"))
        table.apply(frame(*rows), batch)
        if batch in (2, 5):
            make().apply(frame((55, 5, False)), batch)  # repeated: the table knows it
        assert table.files() <= 4
    assert {r.k: r.v for r in make().read().collect()} == want


def test_progress_table_survives_restarts(spark, tmp_path):
    files = spark.createDataFrame([(i, f"s{i % 3}", ["completed", "failed", "processing"][i % 3 if i < 30 else 0]) for i in range(60)], "file_id long, session_id string, status string")
    make = lambda **more: s.progress_table(spark, files, str(tmp_path / "t"), **more)
    for part in range(3):
        files.filter(F.col("file_id") % 3 == part).write.mode("append").parquet(str(tmp_path / "in"))
        s.run_progress(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")), make(), str(tmp_path / "run"))
    want = s.progress(files).collect()
    assert sorted((r.session_id, r.seen_files, r.finished_files, r.failed_files) for r in make().read().collect()) == sorted(tuple(r) for r in want)
    idle = make(idle_batches=2)
    idle.compact()
    assert {r.session_id for r in idle.read().collect()} == {"s1", "s2"}


def test_late_rows_are_kept_as_rows(spark, tmp_path):
    from codecorpus.streaming.upsert import LateSplit

    frame = lambda *rows: spark.createDataFrame(rows, "id int, at string").select("id", F.col("at").cast("timestamp").alias("ts"))
    got = None
    for rows in ([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 08:00:00")], [(3, "2024-01-01 09:49:59"), (4, "2024-01-01 09:50:00"), (5, None)], [(6, "2024-01-01 09:00:00"), (7, "2024-01-01 12:00:00")]):
        frame(*rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(frame().schema).parquet(str(tmp_path / "in"))
        got = LateSplit(source, str(tmp_path / "run")).run()
    assert sorted((r.id, r.late) for r in got.collect()) == [(1, False), (2, False), (3, True), (4, False), (5, False), (6, True), (7, False)]


def test_tree_has_a_file_for_each_row(spark, tmp_path):
    """The same folders and contents as Spark's writer, and nothing beside the rows' files: no checksums, no moved part files."""
    from codecorpus.sources.sinks import write_tree

    rows = [("a", "x\ny"), ("a", "é"), ("a", "é"), ("b/c=1", ""), (None, None), ("", "n")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    write_tree(df, "text", "lang", str(tmp_path / "ours"))
    df.selectExpr("lang", "text AS value").write.option("maxRecordsPerFile", 1).partitionBy("lang").text(str(tmp_path / "theirs"))
    read = lambda k: sorted((p.parent.name, p.read_bytes()) for p in (tmp_path / k).rglob("*.txt"))
    assert read("ours") == read("theirs") and len(read("ours")) == len(rows)
    assert sum(p.is_file() for p in (tmp_path / "ours").rglob("*")) == len(rows)


def test_batches_do_not_follow_the_files_of_the_input(spark, tmp_path):
    """Eight ranges of time are eight files, in however many parts the rows come."""
    from codecorpus.plans.q_streams import in_order

    events = spark.range(800).selectExpr("id AS event_id", "timestamp_seconds(id * 60) AS ts").repartition(6)
    assert in_order(events, str(tmp_path / "in")) == 1
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 8 and spark.read.parquet(str(tmp_path / "in")).count() == 800


def test_rolling_lists_of_sessions_that_share_a_bucket(spark, tmp_path):
    """Sessions of one bucket keep lists of their own, and all that is due leaves with one timer."""
    from codecorpus.streaming.rolling import rolling_lists

    for rows in ([(1, "2024-01-01 01:00:00", "a"), (2, "2024-01-01 09:00:00", "b"), (3, "2024-01-01 20:00:00", "c")], [(4, "2024-01-02 18:00:00", "a")], [(5, "2024-01-02 18:00:01", "c")]):
        errors(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(errors(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lists, _ = rolling_lists(source, str(tmp_path / "run"), buckets=1)
    got = sorted((r.batch_id, r.session_id, r.event_id) for r in lists.collect() if r.batch_id < 3)
    assert got == [(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "a", 4), (1, "c", 3), (2, "a", 4), (2, "c", 3), (2, "c", 5)]


def test_trees_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The rows of Spark's own source, without the driver listing a file, for odd names too; contents come in batches of bounded size."""
    from codecorpus.sources import listing

    root = tmp_path / "tree"
    for name in ("a.txt", "lang=x y/b.txt", "lang=x y/c.md", "lang=%3A/é.txt", "d/e/f/g.txt", "d/_h.txt", "d/.i/j.txt", "_k/l.txt", "_m=1/n.txt", "d/o[1].txt", "d/p"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode() * 7)
    (root / "empty").mkdir()
    (root / "d/gone.txt").symlink_to(root / "nothing")
    (root / "link").symlink_to(root / "d")

    def theirs(pattern=None):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return sorted(corpus.describe((reader.option("pathGlobFilter", pattern) if pattern else reader).load(str(root)), str(root)).collect())

    want = {p: theirs(p) for p in (None, "*.txt", "?.{txt,md}", "[a-c].*", "none")}
    assert len(want[None]) == 11 and len(want["*.txt"]) == 8
    monkeypatch.setattr(listing, "ROWS", 2)
    for p, rows in want.items():
        ours = corpus.scan_corpus(spark, str(root), pattern=p)
        assert not ours.inputFiles() or not any(str(root) in f for f in ours.inputFiles())
        assert sorted(ours.collect()) == rows
    assert corpus.scan_corpus(spark, f"file://{root}/").count() == 11 and corpus.scan_corpus(spark, str(root / "empty")).count() == 0
    assert {r.relative_path for r in corpus.scan_corpus(spark, str(root / "d" / "p")).collect()} == {str(root / "d" / "p")}


def test_corpus_stream_takes_each_file_once(spark, tmp_path):
    """Batches of bounded size; a later run with the same checkpoint takes only the new files."""
    root = tmp_path / "in"
    add = lambda names: [(root / n[0]).mkdir(parents=True, exist_ok=True) or (root / n[0] / f"{n}.py").write_text(f"x = '{n}'\n") for n in names]
    add(f"{c}{k}" for c in "ab" for k in range(6))
    out, run = s.run_available(s.stream_corpus(spark, str(root), 5), str(tmp_path / "run"))
    sizes = [p.numInputRows for p in run.recentProgress if p.numInputRows]
    assert sum(sizes) == 12 and max(sizes) <= 5
    assert len(out.select("relative_path").distinct().collect()) == out.count() == 12
    add(["b9", "c0"])
    out, run = s.run_available(s.stream_corpus(spark, str(root), 5), str(tmp_path / "run"))
    assert sum(p.numInputRows for p in run.recentProgress) == 2
    assert sorted(r.relative_path for r in out.collect()) == sorted([f"{c}/{c}{k}.py" for c in "ab" for k in range(6)] + ["b/b9.py", "c/c0.py"])
