import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from codecorpus.llm import bpe
from tests.llm.conftest import AWKWARD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_same_ids_as_the_library(library):
    own, r = bpe.Encoder(bpe.vocabulary()), random.Random(8)
    texts = [t or "" for t in AWKWARD] + ["don't I've it's'sve'll 'tis", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|x|>", "ſK ﷺ ΐ", " ̈a é é", "12 3½²", "!!??..--##"]
    texts += ["".join(r.choice("abcdeghilnorstuyé'. 1ñ") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randint(33, 0x250), r.randint(0x250, 0x3000), r.randint(0x1F300, 0x1F700)])) for _ in range(12)) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert ids(own.encode(t)) == want, t
        assert own.decode(own.encode(t)) == library.decode(want, skip_special_tokens=False)


def test_small_tables_give_the_same_ids(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT", 3)
    own = bpe.Encoder(bpe.vocabulary())
    text = "the quick brown foxes jumped over unbelievably lazy dogs " * 5
    assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_pairs_that_the_merges_would_join_are_refused():
    own = bpe.Encoder(bpe.vocabulary())
    name = {t: i for i, t in own.text_of.items()}
    assert not own.follows(name["t"], name["h"]) and own.follows(name["th"], name["x"])


def test_columns(docs, library):
    table = docs(AWKWARD)
    rows = {r.doc_id: r for r in bpe.digests(table, bpe.vocabulary(), ["doc_id", "count"]).collect()}
    for i, t in enumerate(AWKWARD):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(want) and rows[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_texts(table, bpe.vocabulary())
    assert encoded.columns == ["doc_id", "row", "count", "ids"]
    back = bpe.decode_ids(encoded, bpe.vocabulary()).where("doc_id = 3").first()
    assert back.decoded == "one</w>" and back["row"] == "x"
    assert bpe.encode_texts(docs([]), bpe.vocabulary()).count() == 0


def test_a_worker_keeps_no_tables_for_other_stages(spark, docs):
    """Workers are used again by later stages: tables stay empty there, and results are those of one encoder."""
    texts = [f"word{k} other{k}, {k}" for k in range(500)]

    def kept(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t) for e in bpe._ENCODERS.values() for t in (e.units, e.pieces, e.pairs))], pa.int64())], ["n"])

    for job in (lambda: bpe.digests(docs(texts), bpe.vocabulary(), ["doc_id"]), lambda: bpe.encode_texts(docs(texts), bpe.vocabulary())):
        assert job().count() == len(texts) and len(job().collect()) == len(texts)
        assert sum(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").collect()) == 0


def test_the_library_normalises_and_cuts_as_with_its_entries(library):
    own = bpe.Encoder(bpe.vocabulary()).library
    assert own.get_vocab_size() == 0
    for t in ["Ünïcode ΑΣ İ 日本語 👍🏽", "don't<|endoftext|> 12 3½²", "ſK ﷺ ΐ \u0308a"]:
        assert own.normalizer.normalize_str(t) == library.normalizer.normalize_str(t)
        assert own.pre_tokenizer.pre_tokenize_str(t) == library.pre_tokenizer.pre_tokenize_str(t)
