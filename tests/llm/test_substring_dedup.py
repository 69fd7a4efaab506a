import hashlib
import random

from codecorpus.llm import blocks, substring_dedup as d
from tests.llm.conftest import AWKWARD


def brute(rows, n):
    first = {}
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    for i, ws in cut:
        for k in range(len(ws) - n + 1):
            w = tuple(ws[k : k + n])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in cut:
        gone = [False] * len(ws)
        for k in range(len(ws) - n + 1):
            if first[tuple(ws[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((i, len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone) if not g)).hexdigest()))
    return sorted(out)


def test_matches_brute_force_over_many_blocks(spark, docs, monkeypatch):
    r = random.Random(9)
    shared = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(40)) for _ in range(4)]
    texts = [" ".join(r.choice([f"w{r.randint(0, 5000)}", r.choice(shared)]) if r.random() < 0.1 else f"w{r.randint(0, 5000)}" for _ in range(r.randint(0, 120))) for _ in range(120)]
    texts += [texts[3]] * 40 + AWKWARD
    ids = list(range(len(texts)))
    r.shuffle(ids)
    ids[7] = ids[8]
    real = blocks.encode_blocks
    monkeypatch.setattr(d, "encode_blocks", lambda *a, **k: real(*a, **k, block_bytes=2000))
    monkeypatch.setattr(d, "GROUP_WINDOWS", 700)
    got = sorted(tuple(x) for x in d.dedup(docs(texts, ids).repartition(3)).collect())
    assert got == brute(list(zip(ids, texts)), 13)


def test_kept_text_and_null_ids(docs):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = d.dedup(docs([f"a {passage}", f"b {passage} c", f"{passage}"], [2, 1, None]), keep_text=True).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: f"b {passage} c", 2: "a", None: ""}


def test_empty_table(docs):
    assert d.dedup(docs([])).count() == 0
    assert d.dedup(docs([None, ""])).collect()[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
