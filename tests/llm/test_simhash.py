import random

import numpy as np
import pytest
import xxhash

from codecorpus.llm import simhash as s
from tests.llm.conftest import AWKWARD


def brute_fingerprint(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    lowest = {}
    for i, d in enumerate(ids):
        lowest[find(i)] = min(lowest.get(find(i), d), d)
    return [lowest[find(i)] for i in range(len(fps))]


def test_fingerprints():
    for text in AWKWARD[:5] + AWKWARD[6:] + ["A b C d E f", "one two three four", "x y\x0bz"]:
        assert s.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("bits", [21, 22])
def test_close_values_share_an_anchor(bits):
    r = np.random.default_rng(bits)
    x = r.integers(0, 1 << bits, 500).astype(np.uint64)
    y = np.where(r.random(500) < 0.2, x, x ^ (np.uint64(1) << r.integers(0, bits, 500).astype(np.uint64)))

    def of(values):
        out = [set() for _ in values]
        for at, anchor in s.anchors(values, bits, 1):
            for i, a in zip(at.tolist(), anchor.tolist()):
                assert a not in out[i]
                out[i].add(a)
        return out

    assert all(a & b for a, b in zip(of(x), of(y)))
    assert max(map(len, of(x))) <= 1 + bits - 15 + (bits - 15) * (bits - 16) // 2 + 16


def test_components_of_chains_and_dense_groups(spark, monkeypatch):
    """Chains whose ends are far apart, a dense group, and random fingerprints; also with the search used for small groups."""
    r = np.random.default_rng(4)
    chain = [r.integers(0, 1 << 63)]
    for _ in range(60):
        chain.append(chain[-1] ^ sum(1 << int(b) for b in r.choice(64, 4, replace=False)))
    center = int(r.integers(0, 1 << 63))
    dense = [center ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 5)), replace=False)) for _ in range(300)]
    fps = np.array([x % 2**64 for x in [*map(int, chain), *dense, *map(int, r.integers(0, 1 << 63, 300)), 0, 15, 2**64 - 1]], np.uint64)
    ids = list(range(len(fps)))
    random.Random(2).shuffle(ids)
    distinct = spark.createDataFrame([(int(x),) for x in np.unique(fps).view(np.int64)], "fp bigint")
    want = brute_components(fps, ids)
    for dense_from in (256, 2):
        monkeypatch.setattr(s, "DENSE", dense_from)
        root = {r.node: r.root for r in s.components(s.links(distinct)).collect()}
        lowest = {}
        for f, d in zip(fps.view(np.int64).tolist(), ids):
            k = root.get(f, f)
            lowest[k] = min(lowest.get(k, d), d)
        assert [lowest[root.get(f, f)] for f in fps.view(np.int64).tolist()] == want


def test_rows(docs):
    ids = [5, None, 3, 8, 2, 9, 1, 7, 4]
    rows = s.near_duplicates(docs(AWKWARD, ids)).collect()
    got = {(r.doc_id, r.fp % 2**64): r.component_id for r in rows}
    fps = [brute_fingerprint(t) if t is None or len(t) < 50_000 else s.fingerprint(t) for t in AWKWARD]
    assert len(rows) == len(AWKWARD) and {k[1] for k in got} == set(fps)
    assert got[(5, 0)] == got[(None, 0)] == got[(3, 0)] == 3 and got[(8, fps[3])] == got[(2, fps[4])] == 2
    assert s.near_duplicates(docs([])).count() == 0
