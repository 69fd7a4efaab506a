import hashlib
import math
import random

import pytest

from codecorpus.llm import vector_codes as v

SCHEMA = "vec_id bigint, embedding array<float>, label int, rid string, v int"


def brute(rows, positions=8, entries=16, rounds=6):
    """{(vec_id, label, code, error)} as a list, and the digest of the codebooks, by plain loops."""
    kept = [(i, [min(2**27, max(-(2**27), math.floor(4096 * x))) for x in e], l) for i, e, l in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    first = {}
    for i, e, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, e), e)
    start = [first[i] for i in sorted(first)[:entries]]
    if not start:
        return [], ""
    kept = [k for k in kept if len(k[1]) == len(start[0])]
    start = [s for s in start if len(s) == len(start[0])]
    width = -(-len(start[0]) // positions)
    parts = lambda e: [(e + [0] * (positions * width))[p * width : (p + 1) * width] for p in range(positions)]
    books = [[parts(s)[p] for s in start] for p in range(positions)]
    split = [parts(e) for _, e, _ in kept]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(positions):
            members = {}
            for s in split:
                members.setdefault(near(p, s[p])[1], []).append(s[p])
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m)]
    found = []
    for (i, _, l), s in zip(kept, split):
        near_all = [near(p, s[p]) for p in range(positions)]
        found.append((i, l, tuple(k for _, k in near_all), sum(d for d, _ in near_all)))
    return found, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def results(spark, rows, **more):
    coded, books = v.compress(spark.createDataFrame(rows, SCHEMA), **more)
    return [(r.vec_id, r.label, tuple(r.codes), r.error) for r in coded.collect()], hashlib.sha256(v.books_text(books).encode()).hexdigest()


def vectors(n, width=64, seed=1):
    r = random.Random(seed)
    hot = [r.gauss(0, 0.2) for _ in range(width)]
    return [(i, hot if i % 3 == 0 else [r.gauss(0, 0.2) for _ in range(width)], r.choice([None, 1, 2]), "x", 0) for i in range(n)]


def test_rounds_equal_plain_loops(spark, monkeypatch):
    rows = [(i, [float(f"{x:.3f}") for x in e], *m) for i, e, *m in vectors(400)]
    rows = [(i, [__import__("struct").unpack("f", __import__("struct").pack("f", x))[0] for x in e], *m) for i, e, *m in rows]
    want, digest = brute([r[:3] for r in rows])
    for members, cut in ((20_000, 8), (50, 2)):
        monkeypatch.setattr(v, "MEMBERS", members)
        monkeypatch.setattr(v, "CUT", cut)
        got, books = results(spark, rows)
        assert sorted(got, key=repr) == sorted(want, key=repr) and books == digest


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, [0.5] * 10, 1, "x", 0), (3, [0.25] * 10, None, "x", 0), (None, [1.0] * 10, 1, "x", 0), (1, None, 1, "x", 0), (2, [0.5] * 9 + [None], 1, "x", 0),
        (4, [0.5] * 9 + [nan], 1, "x", 0), (5, [inf] + [0.5] * 9, 1, "x", 0), (6, [-0.0001] * 10, 1, "x", 0), (6, [-0.0001] * 10, 1, "x", 0), (7, [1e30] * 10, 2, "x", 0), (9, [0.5] * 4, 2, "x", 0),
    ]
    want, digest = brute([r[:3] for r in rows])
    got, books = results(spark, rows)
    assert sorted(got, key=repr) == sorted(want, key=repr) and books == digest and len(got) == 6
    coded, books = v.compress(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0 and books == [] and coded.columns == ["rid", "vec_id", "label", "codes", "error"]
    coded, _ = v.compress(spark.createDataFrame([(1, [], 1, "x", 0), (2, [], 1, "x", 0)], SCHEMA))
    assert [(r.codes, r.error) for r in coded.collect()] == [([0] * 8, 0)] * 2
    coded, _ = v.compress(spark.createDataFrame([(None, [1.0] * 8, 1, "x", 0)], SCHEMA))
    assert [r.error for r in coded.collect()] == [0]


def test_label_errors(spark):
    coded = spark.createDataFrame([(1, 5), (1, 7), (None, 2), (None, 1), (3, 0)], "label int, error bigint")
    assert sorted((r.label or 0, r.error, r.label_error) for r in v.with_label_errors(coded).collect()) == [(0, 1, 3), (0, 2, 3), (1, 5, 12), (1, 7, 12), (3, 0, 0)]


def test_only_parts_that_change_entry_move(spark):
    """The residents' side of a round keeps its partitioner: the plan of a round has one new shuffle, of those that leave."""
    import numpy as np

    rows = v.numbered(spark.createDataFrame(vectors(200), SCHEMA), "vec_id", "embedding", "label", 4096)
    books = v.cut(np.array(v.first_vectors(rows, 16), np.int64), 8).transpose(1, 0, 2).copy()
    layout = v.Layout(8, 16, 1, 8)
    state = v.settled(rows, books, 64, layout).partitionBy(8, v.owner).mapPartitions(v.gathered, preservesPartitioning=True)
    again = v.migrated(state, books, layout)
    assert "PartitionerAwareUnionRDD" in again.toDebugString().decode() and again.getNumPartitions() == 8
    count = lambda rdd: sum(len(layout.members(m)[0]) for _, m in rdd.collect())
    assert count(state) == count(again) == 8 * 200
    assert sorted(state.collect()) == sorted(again.collect())  # the same books: nobody moves


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_oracle(spark, sf):
    from codecorpus.plans.compare import duck, rows_of

    d = f"/root/testdata/{sf}"
    df = v.query(spark, d)
    cur = duck(d).execute(v.ORACLE)
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())
