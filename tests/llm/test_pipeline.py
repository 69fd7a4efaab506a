import random

import corpus_pipeline as p
from codecorpus.llm import bottom_k, bpe, secret_scan, simhash


def test_stages_do_what_they_say(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if stage is not p.STAGES[-1][1]:
            assert docs.columns == columns
    first, second, third, fourth, last = seen.values()
    assert set(first) >= set(second) >= set(third) == set(fourth) == set(last)
    assert len({r.text for r in second.values()}) == len(second)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {i for i, r in second.items() if any(x in r.text for x in items)} == set(second) - set(third)
    assert not any(secret_scan.base_spans(r.text) for r in fourth.values())
    assert all(r.text == third[i].text or secret_scan.base_spans(third[i].text) for i, r in fourth.items())
    own = bpe.Encoder(bpe.vocabulary())
    assert all(last[i].n_tokens == len(own.encode(r.text)) // 4 for i, r in fourth.items())
    assert {tuple(r) for r in p.run(spark, sf_dir).collect()} == {tuple(r) for r in last.values()}


def test_rows_without_ids_and_repeated_rows(spark):
    text = "the story of a river and of the stones in it " * 2
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = p.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3]
    assert p.quality(spark, docs.where("false"), "").count() == 0


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_near_copies_against_brute_force(spark):
    """Copies with a few words changed, above and below the limit, and families of copies of copies."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(60):
        base = r.choices(words, k=r.randint(20, 300))
        texts.append(base)
        for _ in range(r.randint(0, 6)):
            base = list(base if r.random() < 0.5 else texts[-1])
            for at in r.sample(range(len(base)), r.randint(1, 1 + len(base) // 30)):
                base[at] = r.choice(words)
            texts.append(base)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    assert 60 < len(set(root)) < len(texts) - 60
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    assert {x.doc_id for x in p.near_duplicates(spark, docs, "").collect()} == set(root)


def test_links_that_miss_the_first_of_a_list(spark, monkeypatch):
    """All texts meet in one list, and links that do not touch its first member are found too."""
    monkeypatch.setattr(bottom_k, "lists", lambda nodes: nodes.selectExpr("0L AS v", "node", "n"))
    texts = [" ".join(f"{g}{k}" for k in range(60)) + f" {g}{end}" for g in "abcd" for end in ("x", "y")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCS)
    assert {x.doc_id for x in p.near_duplicates(spark, docs, "").collect()} == {0, 2, 4, 6}


def test_a_column_with_the_name_of_the_hash_stays(spark):
    text = "the story of a river and of the stones in it " * 2
    docs = spark.createDataFrame([(1, text, 777, "x"), (2, text, 778, "y"), (3, "another text of six words", 779, "z")], "doc_id bigint, text string, h int, H_ string")
    assert sorted((r.doc_id, r.h, r.H_) for r in p.near_duplicates(spark, docs, "").collect()) == [(1, 777, "x"), (3, 779, "z")]


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    sf_dir = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    first, second, leak = (" ".join(f"{c}{k}" for k in range(80)) for c in "xyz")
    rows = [(1, first), (1, second), (1, f"{leak} {item}"), (None, f"{leak} {item}"), (2, leak)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert {(r.doc_id, r.text) for r in p.decontaminated(spark, docs, sf_dir).collect()} == {(1, first), (1, second), (2, leak)}
    rows = [(1, first), (1, second), (2, first + " end"), (2, leak), (3, second + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert {(r.doc_id, r.text) for r in p.near_duplicates(spark, docs, "").collect()} == {(1, first), (1, second), (2, leak)}


def test_near_copies_in_no_list_are_found_by_their_fingerprints(spark, monkeypatch):
    """SimHash gives candidates of its own, and the sets decide about them."""
    monkeypatch.setattr(bottom_k, "lists", lambda nodes: nodes.selectExpr("0L AS v", "node", "n").where("false"))
    r = random.Random(6)
    texts = [" ".join(r.choices([f"{g}{k}" for k in range(500)], k=900)) for g in "abcd"]
    # Within the bits of SimHash, but few of the words in the one are in the other.
    apart = ["same " * 1000 + f"{c} " + " ".join(f"{c}{k}" for k in range(40)) for c in "xy"]
    own = simhash.fingerprint(apart[0]) ^ simhash.fingerprint(apart[1])
    assert own.bit_count() <= simhash.THRESHOLD
    rows = [(k, t) for k, t in enumerate([*texts, *(f"{t} end" for t in texts), *apart])]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)
    assert {x.doc_id for x in p.near_duplicates(spark, docs, "").collect()} == {0, 1, 2, 3, 8, 9}
