import math
import random
import zlib

import numpy as np
import pytest

from codecorpus.llm import lm_scoring as lm
from tests.llm.conftest import AWKWARD


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


def corpus(n=400, seed=2):
    r = random.Random(seed)
    follow = {f"w{k}": [f"w{r.randint(0, 60)}" for _ in range(3)] for k in range(61)}
    texts = []
    for _ in range(n):
        w = f"w{r.randint(0, 60)}"
        out = []
        for _ in range(r.randint(1, 60)):
            out.append(w)
            w = r.choice(follow[w]) if r.random() < 0.9 else f"w{r.randint(0, 60)}"
        texts.append(" ".join(out))
    return texts


def test_contract_columns_match_brute_force(docs):
    texts = corpus(100) + AWKWARD
    out = {r.doc_id: r for r in lm.score(docs(texts)).collect()}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    count = {}
    for t in train:
        for w in tokens(t):
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        ws = tokens(t)
        base = sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        got = out[i]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(w in count for w in ws), n)
        assert got.base_score == pytest.approx(base) and got.score <= 0


@pytest.mark.parametrize("order", [2, 3])
def test_beats_the_base_on_held_out_texts(docs, order):
    out = lm.score(docs(corpus()), order=order).where("held_out").toPandas()
    assert out.score.sum() > 0.8 * out.base_score.sum()


def test_passes_over_parts_of_the_filter_give_the_same_scores(docs, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_NGRAMS", 500)
    monkeypatch.setattr(lm, "GROUP_WORDS", 20)
    one, many = (sorted(map(tuple, lm.score(docs(corpus(150)), broadcast_bytes=b).collect())) for b in (1 << 30, 600))
    assert one == many


def test_levels_are_never_too_low_and_rarely_too_high():
    r = np.random.default_rng(1)
    h, counts = lm.mix(np.arange(20_000, dtype=np.uint64)), np.minimum(r.zipf(1.6, 20_000), 10**6)
    level = lm.level_of(counts)
    field = np.zeros(-(-int(level.sum()) * lm.BITS // 8) * 8, bool)
    for step in range(1, int(level.max()) + 1):
        for place in lm.places(h[level >= step], step, len(field)):
            field[place] = True
    segment = np.packbits(field, bitorder="little").tobytes()
    read = lm.probe(h, segment).astype(int)
    assert (read >= level).all() and (read > level).mean() < 0.03
    unseen = lm.probe(lm.mix(np.arange(50_000, 70_000, dtype=np.uint64)), segment)
    assert (unseen > 0).mean() < 0.03
    assert (lm.VALUES[level] / counts < 1.45).all() and (counts / lm.VALUES[level] < 1.45).all()


def test_a_mixture_is_a_distribution(docs):
    """With exact counts the interpolation sums to one over the known words and the unknown one."""
    base, seen = np.full(11, 1 / 11), np.array([0.5, 0.5] + [0.0] * 9)
    share = 0.3
    assert (base * (1 - share + share * seen / base)).sum() == pytest.approx(1)


def test_null_ids_and_empty_table(docs):
    assert lm.score(docs([])).count() == 0
    rows = lm.score(docs(["a b", "a b"], [None, None])).collect()
    assert len(rows) == 2 and all(r.n_tokens == 3 for r in rows)


def test_the_filter_is_read_where_it_is_built(spark, docs, monkeypatch):
    """No worker gets the whole filter, and each block's levels are those of the counts in all blocks."""
    from codecorpus.llm import blocks

    monkeypatch.setattr(lm, "GROUP_NGRAMS", 500)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: pytest.fail("the filter was broadcast"))
    texts = corpus(120)
    monkeypatch.setattr(blocks.encode_blocks, "__defaults__", ("doc_id", "text", 1000, False))
    counted, facts = lm.model(docs(texts).repartition(3))
    assert counted.count() > 10
    pairs = {}
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            for pair in zip(["start", *tokens(t)], tokens(t)):
                pairs[pair] = pairs.get(pair, 0) + 1
    high = total = 0
    for row in counted.collect():
        c, at = lm.Counted(row.asDict(), *facts), 0
        for i in c.block.ids:
            ws = tokens(texts[i])
            want = lm.level_of(np.array([pairs.get(p, 0) for p in zip(["start", *ws], ws)]))
            got = c.levels[0][at : at + len(ws)]
            assert (got >= want).all()
            high, total, at = high + (got > want).sum(), total + len(ws), at + len(ws)
    assert total == sum(len(tokens(t)) for t in texts) and high < 0.03 * total
