import random

import pytest

from codecorpus.llm import license_scan as l
from tests.llm.conftest import AWKWARD


@pytest.fixture(scope="module")
def prose():
    r = random.Random(1)
    words = ["the", "of", "terms", "work", "free", "use", "under", "version", "public", "stone", "river", "walked", "green"] + [f"w{k}" for k in range(300)]
    return [" ".join(r.choice(words) for _ in range(r.randint(3, 40))) for _ in range(900)]


def test_held_out_accuracy(docs, prose):
    notices = {
        "Apache-2.0": "This file: licensed under the Apache License, Version 2.0 (the \"License\")", "MIT": "released under the mit license.",
        "GPL-3.0": "The work is licensed under the GNU General Public License, version 3!", "CC-BY-NC-4.0": "Text: Licensed under CC BY-NC 4.0.", "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    }
    texts = [f"{prose[k]}\n\n{n}\n{prose[k + 100]}" for k, n in enumerate(notices.values())] + prose[200:] + ["You need a licence to fish.", "permission to speak"]
    table = docs(texts + AWKWARD)
    model = l.train(l.examples(*l.sample(table)))
    rows = l.scan(table, model).collect()
    confirmed = {(r.doc_id, r.paragraph, r.family) for r in rows if r.confirmed}
    assert confirmed == {(k, 2, f) for k, f in enumerate(notices)}
    assert sum(not r.confirmed for r in rows) <= 0.02 * len(texts)


def test_unknown_words_are_unknown(prose):
    model = l.train(l.examples([], prose))
    p = model.probabilities(model.logits(*model.features(*model.encode([[b"zzz", b"yyy"]])[:2]), model.encode([[b"zzz", b"yyy"]])[2]))
    assert p[0].argmax() == 0 and abs(p.sum() - 1) < 1e-9


def test_template_share():
    assert l.covered([b"a", b"b", b"c"], [b"x", b"a", b"c"]) == pytest.approx(2 / 3)
    assert l.covered([b"a"], []) == 0


def test_empty_table(docs):
    assert l.scan(docs([]), l.train(l.examples(*l.sample(docs([]))))).count() == 0


def test_wrapped_notices_and_notices_in_long_paragraphs(docs, prose):
    """Every template, wrapped at different widths, in comments, and amid a paragraph of some hundred words."""
    texts, want = [], set()
    for f, templates in l.TEMPLATES.items():
        for t in templates:
            for k in range(3):
                ws = t.split()
                lines = [" ".join(ws[i : i + 4 + k]) for i in range(0, len(ws), 4 + k)]
                around = [" ".join(prose[len(texts) + i] for i in range(8)) for _ in range(2)]
                want.add((len(texts), f))
                texts.append(["\n".join(lines), f"{prose[k]}\n\n" + "\n".join(f" * {x}" for x in lines), f"{around[0]} {t} {around[1]}"][k])
    table = docs(texts + prose[300:])
    rows = l.scan(table, l.train(l.examples(*l.sample(table)))).where("confirmed").collect()
    assert {(r.doc_id, r.family) for r in rows} == want


def test_runs_against_brute_force(prose):
    for k, t in enumerate(t for ts in l.TEMPLATE_WORDS.values() for t in ts):
        span = -(-3 * len(t) // 2)
        for drop in (0, 1, 2, 5):
            kept = [w for i, w in enumerate(t) if not drop or i % (drop + 3)]
            ws = l.tokens(prose[k].encode()) * 9 + kept + l.tokens(prose[k + 50].encode()) * 9
            some = any(l.covered(t, ws[i : i + span]) >= l.CONFIRMED for i in range(len(ws)))
            got = any(l.covered(t, ws[a:b]) >= l.CONFIRMED for _, a, b in l.runs(ws))
            assert got >= some


def test_the_sample_has_the_smallest_hashes(docs, monkeypatch):
    """Few paragraphs reach the driver, and they are those a sort of all would give; long ones are cut."""
    monkeypatch.setattr(l, "SAMPLE_LIKE", 5)
    monkeypatch.setattr(l, "SAMPLE_OTHER", 7)
    monkeypatch.setattr(l, "SAMPLE_CHARS", 30)
    lines = [f"a licence line {k}" for k in range(60)] + [f"other line {k}" for k in range(300)] + ["licence " + "x" * 500]
    table = docs(["\n".join(lines[k::9]) for k in range(9)] * 2 + [None, ""])
    by = table.selectExpr("explode(split(text, '\n')) AS p").where("p <> ''").selectExpr("p", "xxhash64(p) AS h").distinct().orderBy("h").collect()
    like, other = l.sample(table)
    cut = lambda ps, n: [p if len(p) <= 30 else None for p in ps][:n]
    assert [p if len(p) < 30 else None for p in like] == cut([r.p for r in by if "licence" in r.p], 5)
    assert other == [r.p for r in by if "licence" not in r.p][:7]
    assert l.sample(docs([])) == ([], [])
    assert l.sample(docs(["only one line"])) == ([], ["only one line"])
