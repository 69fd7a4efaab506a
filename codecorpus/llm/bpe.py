"""BPE encoding and decoding by dynamic programming over prefixes.

A BPE encoding has one last token for every prefix of a word, and a token may follow another exactly if no merge across
their border would have come before the merges inside them. So one walk over the suffix matches of the vocabulary (an
Aho-Corasick automaton, longest match first) stores, for every prefix, the one vocabulary entry that ends there and is
compatible with the last token of the prefix before it; back-pointers give the ids. No merge loop runs over the text.

The vocabulary file is a parameter. Normalising and cutting into pieces follow the file too, through the tokenizers library,
once for each new string between white space; both kinds of result are kept in tables of bounded size.

Defined results: a null text counts as empty; an empty text has no ids and the decoded text "". Rows with null or repeated ids
are encoded like others; an empty table gives no rows. Texts of any length take memory in proportion to one batch.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codecorpus.llm.common import table

#: Entries of the tables that a worker keeps during a task: white-space separated strings, pieces, and compatible pairs.
KEPT = 400_000
#: Stands for the word-end mark inside a piece; no byte maps to it.
END = "\0"
#: Strings of visible ASCII and Latin letters, which are in normal form already and whose classes need no Unicode tables.
SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e]+")


class Encoder:
    """Encodes with the BPE model, normaliser and pre-tokenizer of a tokenizers JSON file with a word-end suffix."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        model = json.load(open(path, encoding="utf-8"))
        # The library normalises and cuts only; without entries and merges it holds no second copy of the vocabulary.
        self.library = Tokenizer.from_str(json.dumps(model | {"model": model["model"] | {"vocab": {}, "merges": []}, "added_tokens": []}))
        suffix = model["model"]["end_of_word_suffix"]
        ids = model["model"]["vocab"]

        def plain(token: str) -> str:
            return token[: -len(suffix)] + END if token.endswith(suffix) else token

        self.text_of = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.merge: dict[int, int] = {}
        self.rank = {i: -1 for i in ids.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merge[left << 20 | right] = rank
            if max(self.rank[left], self.rank[right]) >= rank:
                raise ValueError("a merge comes before its parts; prefixes would not have one last token")
            if whole not in self.parts:
                self.parts[whole] = (left, right)
                self.rank[whole] = rank
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            # Entries that no merge makes and that are longer than one symbol can't occur.
            if i in self.parts or len(plain(token).rstrip(END)) == 1:
                self.automaton.add_word(plain(token), (i, len(plain(token))))
        self.automaton.make_automaton()
        # The pattern of the file, stated for simple strings: the classes of letters and digits are spelled out.
        split = next(p for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        letters = "a-z\u00df-\u00f6\u00f8-\u017e"
        self.cut = re.compile(split.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", f"[^{letters}0-9]")).findall
        if self.cut("a1!'s") != ["a", "1", "!'", "s"] or "p{" in split.replace(r"[\p{L}]", "").replace(r"[\p{N}]", "").replace(r"[^\s\p{L}\p{N}]", ""):
            raise ValueError(f"the pattern {split} is not one that this encoder knows")
        self.letter = {b: self.library.pre_tokenizer.pre_tokenize_str(chr(b))[0][0] for b in range(33, 127)}
        self.letter |= {ord(a): b for a, b in self.byte_letters().items()}
        self.units: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def forget(self) -> None:
        """Empties the tables, which hold what the texts brought."""
        for kept in (self.units, self.pieces, self.pairs):
            kept.clear()

    def byte_letters(self) -> dict[str, str]:
        """Byte (as a Latin-1 character) to byte-level letter, for the bytes of two-byte characters."""
        out = {}
        for c in range(0xC0, 0x180):
            if chr(c) in "\u00d7\u00f7":
                continue
            seen = self.library.pre_tokenizer.pre_tokenize_str(chr(c))[0][0]
            out |= dict(zip(chr(c).encode().decode("latin-1"), seen))
        return out

    def cut_pieces(self, text: str) -> list[str]:
        """Byte-level pieces of a string without white space."""
        if not SIMPLE.fullmatch(text):
            text = self.library.normalizer.normalize_str(text)
            return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        pieces = self.cut(text.lower())
        return pieces if text.isascii() else [p if p.isascii() else p.encode().decode("latin-1").translate(self.letter) for p in pieces]

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand after token ``a``: walking both back in time along the border, no pair of neighbours
        has a merge that comes before the merges which used them up (of equal merges, the one further left comes first)."""
        merge, rank, parts = self.merge, self.rank, self.parts
        used_a = used_b = 1 << 60
        while True:
            m = merge.get(a << 20 | b)
            if m is not None and m < used_a and m <= used_b:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                used_a, a = ra, parts[a][1]
            else:
                used_b, b = rb, parts[b][0]

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-tokenised piece (byte-level letters, no word-end mark) as unsigned 32-bit integers."""
        end = len(piece) + 1
        last = [-1] * (end + 1)
        back = [0] * (end + 1)
        pairs, follows = self.pairs, self.follows
        for at, (token, size) in self.automaton.iter(piece + END):
            at += 1
            if last[at] >= 0:
                continue
            start = at - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 20 | token
                good = pairs.get(key)
                if good is None:
                    good = pairs[key] = follows(before, token)
                if not good:
                    continue
            last[at] = token
            back[at] = start
        out = array("I")
        while end:
            out.append(last[end])
            end = back[end]
        out.reverse()
        if len(pairs) > 5 * KEPT:
            pairs.clear()
        return out.tobytes()

    def unit(self, raw: bytes) -> bytes:
        """Ids of a string without white space."""
        text = raw.decode("utf-8")
        if "<|" in text:
            for mark, i in self.special.items():
                if mark in text:
                    a, b = text.split(mark, 1)
                    return self.unit(a.encode()) + array("I", [i]).tobytes() + self.unit(b.encode())
        out = []
        for piece in self.cut_pieces(text):
            got = self.pieces.get(piece)
            if got is None:
                if len(self.pieces) >= KEPT:
                    self.pieces.clear()
                got = self.pieces[piece] = self.piece(piece)
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers. White space always ends a piece, so strings between
        white space are encoded apart."""
        units, out = self.units, []
        for raw in (text or "").encode("utf-8").split():
            got = units.get(raw)
            if got is None:
                if len(units) >= KEPT:
                    units.clear()
                got = self.unit(raw)
                if len(raw) < 64:
                    units[raw] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space: what the library does for a file without a decoder."""
        return " ".join(map(self.text_of.__getitem__, array("I", ids)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@contextmanager
def tables(path: str) -> Iterator[Encoder]:
    """The worker's encoder for one task. Its tables go at the end: Spark gives the worker to other stages, which need the memory."""
    own = encoder(path)
    try:
        yield own
    finally:
        own.forget()


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) in place of ``text``."""
    rest = [c for c in docs.columns if c not in (text, ids)]
    schema = docs.select(*rest).schema.add(ids, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tables(path) as own:
            for batch in batches:
                done = pa.array([own.encode(t.as_py()) for t in batch.column(text)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], done], [*rest, ids])

    return docs.select(*rest, text).mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the decoded ``text`` in place of ``ids``."""
    rest = [c for c in docs.columns if c not in (text, ids)]
    schema = docs.select(*rest).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode
        for batch in batches:
            done = pa.array([decode(t.as_py() or b"") for t in batch.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], done], [*rest, text])

    return docs.select(*rest, ids).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded and decoded in one pass, so neither
    ids nor decoded texts leave the worker."""
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tables(path) as own:
            for batch in batches:
                ids = [own.encode(t.as_py()) for t in batch.column(text)]
                cols = [
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary(), ["doc_id"])
