import random

import numpy as np

from codecorpus.llm import decontaminate as d
from tests.llm.conftest import AWKWARD


def vocabulary(seed=1):
    r = random.Random(seed)
    return ["the", "of", "and", "in"] * 150 + ["".join(r.choices("abcdefghijklmnop", k=r.randint(4, 9))) for _ in range(3000)]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_common_subsequence():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = r.integers(0, 6, r.integers(1, 40)), r.integers(0, 6, r.integers(0, 80))
        assert d.common_subsequence(a, b) == brute_lcs(a.tolist(), b.tolist())


def test_recall_against_brute_force(spark, docs):
    """Whole, edited and shortened items in long documents: every pair that a comparison of all words finds is found."""
    r, words = random.Random(4), vocabulary()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [text(r.randint(6, 90)) for _ in range(40)] + ["the", ""]
    texts, planted = [], []
    for k in range(120):
        host = text(r.randint(0, 400)).split()
        if k < 90:
            item = items[k % 40].split()
            if k >= 40:
                item = [w for w in (x if r.random() > 0.12 else r.choice(words) for x in item) if r.random() > 0.05]
            at = r.randint(0, len(host))
            host[at:at] = [w.upper() if k % 7 == 0 else w + "," if k % 5 == 0 else w for w in item]
            planted.append((k, k % 40))
        texts.append(" ".join(host))
    benchmark = spark.createDataFrame([*enumerate(items), (99, None), (None, "x")], "item_id bigint, text string")
    found = {(x.doc_id, x.item_id) for x in d.leaks(docs(texts + AWKWARD), benchmark, sample=500).collect()}
    bench = d.benchmark_of([(k, t, None) for k, t in enumerate(items[:40])])
    want = {(k, i) for k, i in planted if brute_lcs(bench.items[i].ids.tolist(), bench.ids(texts[k]).tolist()) >= (d.COVER if len(bench.items[i].ids) >= d.SHORT else 1) * len(bench.items[i].ids)}
    assert len(want) > 60 and len(want & found) >= 0.95 * len(want)
    assert {p for p in planted if p[0] < 40} <= found
    assert {x for x in found if x[1] != 40} <= set(planted)
    blocks = {(x.doc_id, x.item_id) for x in d.leaks(docs(texts), benchmark, sample=500, block_items=15).collect()}
    assert len(want & blocks) >= 0.95 * len(want)


def test_answers_decide_about_paraphrases():
    item = d.Item(1, np.arange(20), np.array([3, 4]))
    window = np.r_[np.arange(12), np.full(8, 50)]
    assert d.confirm(window, item, 0, 20, np.ones(60)) == (0.6, True)
    assert d.confirm(window, d.Item(1, np.arange(20), np.array([15, 16])), 0, 20, np.ones(60)) == (0.6, False)


def test_nothing_to_find(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.leaks(docs(["a b c"]), none).count() == 0
    assert d.leaks(docs([]), spark.createDataFrame([(1, "some words of a question")], "item_id bigint, text string")).count() == 0
    kept = d.clean(docs(["some words of a question about things here", "other"], [None, 2]), spark.createDataFrame([(1, "some words of a question about things here")], "item_id bigint, text string"))
    assert kept.count() == 2


def test_recall_in_hosts_of_unknown_words(spark, docs):
    """Items of common words with up to half of them replaced, amid words of another language: every planted item that ``confirm``
    accepts is found, as are whole ones."""
    r = random.Random(9)
    common, rare = [f"c{k}" for k in range(60)], [f"r{k}" for k in range(900)]
    items = [[r.choice(common if r.random() < 0.75 else rare) for _ in range(r.randint(15, 60))] for _ in range(60)]
    texts = [" ".join(r.choices(common, k=64)) for _ in range(400)]
    planted = {}
    for k, item in enumerate(items * 4):
        share = (1.0, 0.85, 0.7, 0.55)[k // 60]
        host = [f"u{r.randrange(10**6)}" for _ in range(300)]
        at = r.randint(0, 300)
        host[at:at] = [w if r.random() < share else f"u{r.randrange(10**6)}" for w in item]
        planted[len(texts)] = (k % 60, at, at + len(item))
        texts.append(" ".join(host))
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    found = {(x.doc_id, x.item_id) for x in d.leaks(docs(texts), benchmark, sample=500).collect()}
    bench = d.benchmark_of([(k, " ".join(t), None) for k, t in enumerate(items)])
    every = [bench.ids(t) for t in texts]
    df = np.bincount(np.concatenate([np.unique(x) for x in every]), minlength=len(bench.vocab) + 1)
    idf = np.log(len(texts) / (1 + df)) + 1
    want = set()
    for doc, (k, start, end) in planted.items():
        cover, answered = d.confirm(every[doc], bench.items[k], start, end, idf)
        if cover >= (d.COVER_WITH_ANSWER if answered else d.COVER):
            want.add((doc, k))
    whole = {(400 + k, k) for k in range(60)}
    assert whole <= want and len(want) > 130
    assert whole <= found and len(want & found) >= 0.98 * len(want)


def test_short_items_are_found_whole(spark, docs):
    """Items of one to seven words, whole, in hosts of unknown words and in hosts of their own common words."""
    r = random.Random(12)
    common = ["the", "of", "and", "in", "a"]
    items = [[r.choice(common + [f"s{k}"]) for _ in range(n)] + [f"s{k}"] for k, n in enumerate([0, 1, 2, 3, 4, 5, 6] * 3)]
    texts = []
    for k, item in enumerate(items * 2):
        host = [f"u{r.randrange(10**6)}" if k < len(items) else r.choice(common) for _ in range(200)]
        at = r.randint(0, 200)
        host[at:at] = item
        texts.append(" ".join(host))
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    found = {(x.doc_id, x.item_id) for x in d.leaks(docs(texts), benchmark, sample=100).collect()}
    assert {(k, k % len(items)) for k in range(len(texts))} <= found


def test_words_of_several_texts():
    texts = [t for t in AWKWARD] + ["", "a", " a", "a ", None, "A,b;C\x0bd\x1ce", " x y"]
    for some in (texts, texts[:1], ["", None], ["x"], []):
        words, counts = d.words_of(some)
        assert words.to_pylist() == [w for t in some for w in d.terms(t)] and counts.tolist() == [len(d.terms(t)) for t in some]
    bench = d.benchmark_of([(1, "one a b the end", None)])
    assert [x.tolist() for x in bench.ids_of(texts)] == [bench.ids(t).tolist() for t in texts] and bench.ids_of([]) == []


def test_counting_holds_a_bounded_part_of_a_batch(monkeypatch):
    """However large a batch is, its texts are cut into words some at a time, and the counts are those of the whole."""
    import pyarrow as pa

    seen = []

    class Counted(d.Benchmark):
        def ids_of(self, texts):
            seen.append(sum(len(t or "") for t in texts))
            return super().ids_of(texts)

    class Docs:
        def mapInArrow(self, run, schema):
            return lambda: [tuple(r.values()) for b in run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for r in b.to_pylist()]

    class Shared:
        value = d.benchmark_of([(1, " ".join(f"w{k}" for k in range(40)), None)])
        value.__class__ = Counted

    texts = [None, ""] + [" ".join(f"w{k * j % 60}" for j in range(k % 150)) for k in range(400)] + [None]
    whole = d.survey(Docs(), Shared, 100)()
    assert len(seen) == 1 and len(whole) > 100
    seen.clear()
    monkeypatch.setattr(d, "TOGETHER", 2000)
    assert d.survey(Docs(), Shared, 100)() == whole
    assert len(seen) > 10 and max(seen) < 2000 + max(len(t or "") for t in texts)


def test_the_space_is_fitted_on_all_passages(spark, docs):
    """The pass over the documents gives every passage, repeated ones too, and the space holds as much of them as the exact one."""
    r, words = random.Random(5), vocabulary()
    texts = [" ".join(r.choices(words, k=r.randint(0, 400))) for _ in range(300)] * 2 + AWKWARD
    items = [" ".join(r.choices(words, k=r.randint(9, 60))) for _ in range(250)]
    bench = d.benchmark_of([(k, t, None) for k, t in enumerate(items)])
    v, all_ids = len(bench.vocab), [bench.ids(t) for t in texts]
    passages = [x[k : k + d.PASSAGE] for x in all_ids for k in range(0, len(x), d.PASSAGE)]
    seen = d.survey(docs(texts).select("text"), spark.sparkContext.broadcast(bench)).collect()
    packed = [d.unpacked(bytes(x.ids)) for x in seen if x.kind == "passages"]
    assert sum(x.n for x in seen if x.kind == "passages") == sum(x.n for x in seen if x.kind == "total") == len(passages)
    got = sorted((tuple(np.repeat(term[place == k], times[place == k])), int(others[k])) for place, term, times, others in packed for k in range(len(others)))
    assert got == sorted((tuple(np.sort(x[x < v])), int((x == v).sum())) for x in passages)

    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    index = d.index_for(docs(texts), benchmark).value
    rows = d.tfidf(np.concatenate(passages), np.array([len(x) for x in passages]), index.idf, np.eye(v, dtype=np.float32)).astype(float)
    own = d.tfidf(np.concatenate([i.ids for i in bench.items]), np.array([len(i.ids) for i in bench.items]), index.idf, np.eye(v, dtype=np.float32)).astype(float)
    whole = rows.T @ rows + len(passages) // len(items) * own.T @ own
    space = index.space / index.idf[:-1, None]
    assert np.allclose(space.T @ space, np.eye(d.RANK), atol=1e-3)
    assert np.trace(space.T @ whole @ space) > 0.95 * np.linalg.eigvalsh(whole)[-d.RANK :].sum()


def test_marks_hold_a_bounded_number_of_windows(spark, docs, monkeypatch):
    """The same matches however many windows are marked at once."""
    r, words = random.Random(8), vocabulary()
    items = [" ".join(r.choices(words, k=r.randint(9, 60))) for _ in range(30)]
    texts = [" ".join(r.choices(words, k=50) + items[k % 30].split() + r.choices(words, k=50)) for k in range(60)]
    bench = d.benchmark_of([(k, t, None) for k, t in enumerate(items)])
    idf = np.ones(len(bench.vocab) + 1)
    index = d.index_of(bench, idf, np.linalg.qr(np.random.default_rng(1).standard_normal((len(bench.vocab), 64)))[0])
    found = []
    for marks in (d.MARKS, 1):
        monkeypatch.setattr(d, "MARKS", marks)
        found.append([[(i.item_id, a, b, c) for i, a, b, c in x] for x in d.search(bench.ids_of(texts), index)])
    assert found[0] == found[1] and all(any(i == k % 30 for i, *_ in x) for k, x in enumerate(found[0]))
