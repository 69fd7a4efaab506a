import re
import random

from pyspark.sql import functions as F

from codecorpus.llm import quality_rules as q
from tests.llm.conftest import AWKWARD


def brute(text):
    ws = [w.decode() for w in (text or "").encode().split()]
    windows = {}
    for i in range(len(ws) - 2):
        windows.setdefault(tuple(ws[i : i + 3]), []).append(i)
    covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_facts_match_brute_force(docs):
    r = random.Random(3)
    texts = AWKWARD + [" ".join(r.choice(["a", "b", "cc", "d#", "\n", "e|"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    rows = q.facts(docs(texts)).orderBy("doc_id").collect()
    got = [(f.n_words, f.word_chars, f.n_symbols, f.lines.dup, f.n_repeat_words) for f in (x.facts for x in rows)]
    assert got == [brute(t) for t in texts]


def test_junk_goes_and_clean_text_stays(docs):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abdeilmnorstu", k=r.randint(3, 8)))
    clean = [" ".join(r.choice(["the", "of", word(), word(), word(), word()]) for _ in range(120)) + "." for _ in range(300)]
    junk = [" ".join(w + "###" for w in t.split()) for t in clean[:30]] + [" ".join(["buy now cheap"] * 60)] * 10
    out = {x.doc_id: x for x in q.quality(docs(clean + junk + ["short text"]), ["doc_id"]).collect()}
    assert all(out[i].kept for i in range(300))
    assert not any(out[i].kept for i in range(300, 341))
    assert all(out[i].base_failed for i in range(330, 341)) and not out[300].base_failed


def test_a_bad_vote_never_helps():
    good, table = q.estimate([([1] * 8, 900), ([1, 1, -1, -1, 1, 1, 1, -1], 60), ([-1, 0, 0, 0, 0, 0, 0, 0], 40)])
    assert all(w[-1] <= 0 <= w[1] and w[0] == 0 for w in table)
    assert q.estimate([])[0] > 0


def test_only_expressions(docs):
    plan = q.judge(q.votes(q.facts(docs(["a b"]))), q.estimate([]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table_and_nulls(docs):
    assert q.quality(docs([]), ["doc_id", "count"]).count() == 0
    out = q.quality(docs(["a", "a"], [None, None]), ["doc_id"]).collect()
    assert len(out) == 2 and not any(x.kept for x in out)


def test_kept_columns_with_names_of_results_are_replaced(spark):
    docs = spark.createDataFrame([(1, "some words " * 60, "x", 5, True)], "doc_id bigint, text string, facts string, Votes int, kept boolean")
    out = q.quality(docs, ["doc_id", "facts", "Votes", "kept"])
    assert out.columns == ["doc_id", "facts", "votes", "p_good", "base_failed", "kept"] and out.first().facts.n_words == 120
