import hashlib
import random
import re
import zlib

import pytest

from codecorpus.llm import conversation_repair as c
from tests.llm.conftest import AWKWARD

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, codes string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def brute(rows):
    """Totals, audit and repaired lines of one conversation's (turn, role, text) rows, by a table of least (cost, letters)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(4):
            for state, (cost, letters, lines) in list(best.items()):
                new = (cost + 2, letters + "I", lines + (ROLE[NEXT[state]] + ":",))
                best[NEXT[state]] = min(best.get(NEXT[state], new), new)

    for (_, role, text), fault in zip(rows, faults):
        insert(best)
        now = {}

        def put(state, new):
            now[state] = min(now.get(state, new), new)

        for state, (cost, letters, lines) in best.items():
            put(state, (cost + 3, letters + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if role[:1] == NEXT[state] or state == "" and role[:1] == "s":
                put(role[:1], (cost + extra, letters + "K", lines + (f"{role}:{text}",)))
            put(NEXT[state], (cost + 2 + extra, letters + "R", lines + (f"{ROLE[NEXT[state]]}:{text}",)))
        best = now
    insert(best)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    one, several = c.repair(df)
    found = c.digests(one).unionByName(c.digests(several.repartition("conv").sortWithinPartitions("conv", "part", "seq"))).collect()
    assert len({r.conv for r in found}) == len(found)
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}, one.count()


def conversations(n, lengths, seed):
    r = random.Random(seed)
    texts = ["Hello.", "Yes!", "no", "Why?", "", " ", "More. \n", "cut off", "Ok.", None] + [f"Text {i}." for i in range(30)]
    roles = ["user", "assistant"] * 5 + ["system", "tool", "", None, "User", "s"]
    rows = []
    for k in range(n):
        turns = [r.choice([None, i, i]) for i in range(r.choice(lengths))]
        rows += [(None if k == 3 else k, t, r.choice(roles), r.choice(texts)) for t in turns]
    return rows


@pytest.mark.parametrize("chunk_rows", [4096, 3])
def test_repairs_equal_brute_force(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(c, "CHUNK_ROWS", chunk_rows)
    rows = conversations(60, [1, 2, 3, 4, 6, 9, 14], 7) + conversations(1, [400], 8)
    random.Random(1).shuffle(rows)
    by = {}
    for k, *row in rows:
        by.setdefault(k, []).append(row)
    got, whole = repaired(spark, rows)
    assert got == {k: brute(v) for k, v in by.items()}
    assert whole > 40 if chunk_rows > 3 else whole < 40  # small chunks send the longer conversations the long way


def test_long_texts_and_one_hot_conversation(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK_BYTES", 1000)
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(AWKWARD * 3)] + [(2, None, "user", "Same.") for _ in range(500)]
    by = {}
    for k, *row in rows:
        by.setdefault(k, []).append(row)
    got, _ = repaired(spark, rows)
    assert got == {k: brute(v) for k, v in by.items()}


def test_every_short_lattice():
    """All sequences of up to four rows: the auction finds the cost, the trace the least letters, and runs joined by their tables the same."""
    import itertools

    roles = ["system", "user", "assistant", "tool"]
    for n in range(4):
        for codes in itertools.product(range(9), repeat=n):
            rows = [(i, roles[(k - 1) // 2] if k else "user", f"t{i}" + ("" if k and (k - 1) % 2 else ".") if k else "") for i, k in enumerate(codes)]
            want = brute(rows)
            assert c.solve(bytes(codes)) == want[5:7]
            if n > 1:
                after = c.ENDS
                for code in reversed(codes):
                    costs = c.table_of_costs(bytes([code]))
                    after = tuple(min(costs[4 * s + t] + after[t] for t in range(4)) for s in range(4))
                assert after[c.START] == want[5]


def test_a_long_run_is_priced_in_proportion():
    import time

    def seconds(n):
        r = random.Random(n)
        codes = bytes(r.choice(range(9)) for _ in range(n))
        start = time.perf_counter()
        c.solve(codes)
        return time.perf_counter() - start

    assert seconds(40_000) < 16 * max(seconds(5_000), 0.01)


def damage(rows):
    out = []
    for k, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind != 0:
            out += [(k, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    return out


def test_query(spark, tmp_path):
    rows = conversations(80, [1, 2, 5, 8], 5) + [(100 + k, 0, "user", "Hi.") for k in range(60)]
    spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    left = {k: [] for k, *_ in rows}
    for k, *row in damage(rows):
        left[k].append(row)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in c.query(spark, str(tmp_path)).collect()}
    assert got == {k: brute(v) for k, v in left.items()}
    assert any(not v for v in left.values())


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert c.query(spark, str(tmp_path)).count() == 0


def test_query_equals_oracle(spark, sf_dir):
    from codecorpus.plans.compare import duck, rows_of

    df = c.query(spark, sf_dir)
    cur = duck(sf_dir).execute(c.ORACLE)
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
