"""Token counts by section from one encoding of the whole document.

A document is encoded once, as a whole; the tokens' spans follow from the byte lengths of their vocabulary entries. An
interval join (two sorted lists of borders) then finds the sections that a token touches. Rule for a token that crosses a border:
it counts whole for the section with most of its bytes; if that is a tie, for the first of them. Tokens that touch no section
count as outside. So the counts of a document's sections and its outside always add up to its tokens.

Sections are the lines of a text, each with its line feed, or a column of (name, start, end) in characters, end exclusive, in any
order and not overlapping.

Defined results: a null or empty text has one empty section without tokens (given sections: all without tokens). Sections that reach
beyond the text are cut at its end; null or empty ones have no token. Rows with null or repeated ids are counted like others; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.common import table


class Spans:
    """Encodes with a rank file and knows the byte length of each token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset at which each token of a text ends."""
        return np.cumsum(self.size[np.array(self.encoding.encode_ordinary(text), np.int64)])


_SPANS: dict[str, Spans] = {}


def spans(path: str, pattern: str) -> Spans:
    if path not in _SPANS:
        _SPANS[path] = Spans(path, pattern)
    return _SPANS[path]


def attribute(ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each token the number of its section, or -1. Sections are [first, last) in bytes, sorted and apart."""
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    # Sections low..high are those that end after the token's start and begin before its end.
    low = np.searchsorted(last, starts, side="right")
    high = np.searchsorted(first, ends, side="left") - 1
    out = np.where(low <= high, low, -1)
    for t in np.flatnonzero(high > low):
        some = slice(low[t], high[t] + 1)
        shared = np.minimum(last[some], ends[t]) - np.maximum(first[some], starts[t])
        out[t] = low[t] + int(np.argmax(shared))
    return out


def line_borders(raw: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text end."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return at if len(at) and at[-1] == len(raw) else np.r_[at, len(raw)]


def char_offsets(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Character offset of byte offsets."""
    lead = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return lead[at]



def line_counts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, doc_tokens) for each line; start and end in characters."""
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema
    names = ["section", "start", "end", "n_tokens", "doc_tokens"]
    for name in names:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spans(path, pattern)
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in names]
            row = []
            for at, value in enumerate(batch.column(1)):
                body = value.as_py() or ""
                raw = body.encode("utf-8")
                last = line_borders(raw)
                first = np.r_[0, last[:-1]]
                ends = own.ends(body) if body else np.zeros(0, np.int64)
                counts = np.bincount(attribute(ends, first, last), minlength=len(last)) if body else np.zeros(1, np.int64)
                chars = char_offsets(raw, np.r_[0, last])
                for col, part in zip(cols, (np.arange(len(last)), chars[:-1], chars[1:], counts, np.full(len(last), len(ends)))):
                    col.append(part.astype(np.int64))
                row.append(np.full(len(last), at, np.int64))
            if row:
                ids = batch.column(0).take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate(c)) for c in cols]], ["doc_id", *names])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def section_counts(docs: DataFrame, path: str, pattern: str, sections: str = "sections", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, name, start, end, n_tokens) for each given section, and a row with null name, start and end for what is outside."""
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.add("name", "string").add("start", "long").add("end", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spans(path, pattern)
        for batch in batches:
            rows = []
            for at, (value, given) in enumerate(zip(batch.column(1), batch.column(2))):
                body = value.as_py() or ""
                given = sorted((g for g in given.as_py() or [] if g and g["start"] is not None and g["end"] is not None), key=lambda g: (g["start"], g["end"]))
                width = np.r_[0, np.cumsum([len(c.encode()) for c in body])].astype(np.int64)
                real = [g for g in given if max(g["start"], 0) < min(g["end"], len(body))]
                first = width[[max(g["start"], 0) for g in real]] if real else np.zeros(0, np.int64)
                last = width[[min(g["end"], len(body)) for g in real]] if real else np.zeros(0, np.int64)
                found = attribute(own.ends(body), first, last) if body else np.zeros(0, np.int64)
                counts = dict(zip(map(id, real), np.bincount(found[found >= 0], minlength=len(real)).tolist()))
                rows += [(at, g["name"], g["start"], g["end"], counts.get(id(g), 0)) for g in given]
                rows.append((at, None, None, None, int((found < 0).sum())))
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[c + 1] for r in rows], k) for c, k in enumerate(kinds)]], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(sections).alias("sections")).mapInArrow(run, schema)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(table(spark, sf_dir, "documents"), *vocabulary())
