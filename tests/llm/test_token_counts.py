import public_tokenizers
from tokenizers import Tokenizer

from codecorpus.llm import token_counts as c
from tests.llm.conftest import AWKWARD


def test_lines_match_the_library_offsets(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = AWKWARD + ["a\n\n\n\nb\n", "\n", "x \n y\n\n  z", "é\nü\n日本\n語"]
    found = {}
    for r in c.line_counts(docs(texts), *c.vocabulary()).collect():
        found.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        rows = sorted(found[i], key=lambda r: r.section)
        t = text or ""
        lines = t.splitlines(keepends=True) if not any(x in t for x in "\x0b\x0c\x1c\x85 ") else [x + "\n" for x in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else [])
        assert [t[r.start : r.end] for r in rows] == (lines or [""])
        enc = library.encode(t, add_special_tokens=False)
        assert sum(r.n_tokens for r in rows) == len(enc.ids) == rows[0].doc_tokens
        if t.isascii():
            owner = [k for k, x in enumerate(lines) for _ in x]
            want = [0] * max(1, len(lines))
            for a, b in enc.offsets:
                per = {}
                for k in owner[a:b]:
                    per[k] = per.get(k, 0) + 1
                want[max(per, key=lambda k: (per[k], -k))] += 1
            assert want == [r.n_tokens for r in rows]


def test_given_sections(spark):
    given = [[("title", 0, 5), ("body", 6, 99), ("none", None, 3), ("empty", 4, 4)], None, [("late", 50, 60)]]
    table = spark.createDataFrame(list(zip([1, 2, 3], ["Hello big world", "one two", None], given)), "doc_id bigint, text string, sections array<struct<name:string,start:int,end:int>>")
    got = {(r.doc_id, r.name): r.n_tokens for r in c.section_counts(table, *c.vocabulary()).collect()}
    # " big" has one byte in neither section and three in the body, so it counts for the body.
    assert got == {(1, "title"): 1, (1, "body"): 2, (1, "empty"): 0, (1, None): 0, (2, None): 2, (3, "late"): 0, (3, None): 0}


def test_ties_go_to_the_first():
    import numpy as np

    assert c.attribute(np.array([2, 4]), np.array([0, 1, 3]), np.array([1, 3, 4])).tolist() == [0, 1]
    assert c.attribute(np.array([2, 4]), np.array([3]), np.array([4])).tolist() == [-1, 0]


def test_empty_table(docs):
    assert c.line_counts(docs([]), *c.vocabulary()).count() == 0
