import random

import numpy as np
import pytest
import xxhash

from codecorpus.llm import bottom_k as b
from tests.llm.conftest import AWKWARD


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(texts, ids, size=4):
    """{row number: (size of the set, component)} by comparing every two sets of shingles."""
    sets = []
    for t in texts:
        ws = words(t)
        sets.append({b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(len(s), least.get(find(i)) if s else ids[i]) for i, s in enumerate(sets)]


def text(r, n, of=5000):
    return [f"w{r.randrange(of)}" for _ in range(n)]


def changed(r, ws, k):
    ws = list(ws)
    for i in r.sample(range(len(ws)), k):
        ws[i] = f"x{r.randrange(10**6)}"
    return ws


def family_texts(seed=3):
    """Families around and below the limit, chains, short texts, shared passages, exact copies and the awkward ones."""
    r = random.Random(seed)
    out = []
    for n in (3, 9, 30, 90, 300):
        base = text(r, n)
        out += [changed(r, base, min(n, r.randrange(0, max(2, n // 15)))) for _ in range(12)]
        chain = base
        for _ in range(8):
            chain = changed(r, chain, max(1, n // 60))
            out.append(chain)
    passage = text(r, 120)
    out += [text(r, 100) + passage + text(r, 80) for _ in range(20)]
    out += [passage + text(r, 15) for _ in range(15)]
    out += [["Same", "Words", "again", "and", "again"]] * 10 + [text(r, 5)]
    return [" ".join(ws) for ws in out] + AWKWARD


@pytest.mark.parametrize("block", [200_000, 500])
def test_components_equal_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(b, "BLOCK", block)
    texts = family_texts()
    ids = list(range(len(texts)))
    random.Random(5).shuffle(ids)
    want = dict(zip(ids, brute(texts, ids)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in b.near_duplicates(docs(texts, ids)).collect()}
    assert got == want


def test_ids_missing_or_repeated(docs):
    texts = ["a b c d e f", "a b c d e f", "other words in this text", "other words in this text", None, "", "x"]
    ids = [None, 4, 2, 2, None, 7, None]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in b.near_duplicates(docs(texts, ids)).collect()), key=repr)
    assert got == sorted([(None, 3, 4), (4, 3, 4), (2, 2, 2), (2, 2, 2), (None, 0, None), (7, 0, 7), (None, 1, None)], key=repr)
    assert b.near_duplicates(docs([])).count() == 0


def similar_below_the_limit(n, seed=1):
    """Texts that share most of their words in pairs, no two of them similar enough."""
    r = random.Random(seed)
    base = text(r, 300)
    return [changed(r, base, 12) for _ in range(n)]


def test_links_within_a_block():
    """All linked groups, no row for pairs that are not linked, however many there are."""
    r = random.Random(2)
    texts = similar_below_the_limit(150)
    texts += [changed(r, texts[i], 3) for i in range(40)]
    sets = [b.shingles(" ".join(t)) for t in texts]
    n = len(sets)
    found = b.links_between(np.arange(n), np.arange(n), np.full(n, 2), sets)
    assert len(found) <= n - 1
    got = list(range(n))
    for x, y in found:
        got = [got[x] if g == got[y] else g for g in got]
    want = brute([" ".join(t) for t in texts], range(n))
    assert len(set(zip(got, (c for _, c in want)))) == len(set(got)) == len({c for _, c in want})


def test_families_below_the_limit_make_few_rows(spark, docs, monkeypatch):
    made = []
    link = b.links_across
    monkeypatch.setattr(b, "links_across", lambda *a: made.append(link(*a)) or made[-1])
    stars = []
    est = b.estimated
    monkeypatch.setattr(b, "estimated", lambda pairs, nodes: stars.append(pairs) or est(pairs, nodes))
    texts = [" ".join(t) for t in similar_below_the_limit(200)]
    got = b.near_duplicates(docs(texts))
    assert got.where("doc_id <> component_id").count() == 0
    assert made[0].count() == 0 and stars[0].count() < 200 * 32


def test_sketches_of_similar_sets_share_enough():
    r = np.random.default_rng(7)
    for n in (5, 20, 64, 70, 200, 2000):
        for _ in range(60):
            same = -(-8 * n // 10)
            values = r.integers(-(2**63), 2**63 - 1, n)
            one = np.sort(values[: same + (n - same) // 2])
            other = np.sort(np.r_[values[:same], values[same + (n - same) // 2 :]])
            least = min(-(-min(len(one), len(other), b.K) * 8 // 10), b.LEAST)
            union = np.union1d(one[: b.K], other[: b.K])[: b.K]
            assert len(np.intersect1d(np.intersect1d(one[: b.K], other[: b.K]), union)) >= least


def test_shingles_are_known_by_their_hash():
    assert b.shingles("A b c d E").tolist() == sorted(np.array([xxhash.xxh64_intdigest(x, 42) for x in (b"a b c d", b"b c d e")], np.uint64).view(np.int64).tolist())


def test_query_on_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = brute([r.text for r in rows], [r.doc_id for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in b.query(spark, sf_dir).collect()}
    assert got == {r.doc_id: (n, c, c == r.doc_id) for r, (n, c) in zip(rows, want)}
