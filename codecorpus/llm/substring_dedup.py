"""Substring deduplication with a count-min prefilter.

First pass: every block of documents sketches its windows (13 words) into the cells of two rows, a window counting once per
document; the sketches of all blocks are merged cell by cell, in groups of cells, and each block learns which of its cells
hold two or more. The estimate, the smaller of the two cells, is never too low, so no repeated window is lost. Second pass:
only windows estimated repeated are grouped exactly, by a 128-bit digest of their words, with the smallest document id.

The number of cells follows the number of windows, so the share of windows that pass by chance is the same at every size.

Defined results: a null text has no words; a text shorter than a window loses nothing. A row with a null id comes after all
others: its windows remove nothing elsewhere. Rows with equal ids do not remove each other's words. Repeated rows stay; an
empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.blocks import Block, ask, encode_blocks, from_planes, group_of, mix, planes, runs, window_hashes, with_answers
from codecorpus.llm.common import stored, table

WINDOW = 13
#: Rows of the sketch, cells per window in each row, and windows in a group on average.
ROWS, CELLS, GROUP_WINDOWS = 2, 4, 1_500_000
LAST = np.iinfo(np.int64).max
OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class Windows:
    """Windows of a block: place, document, and hash of each; windows that span documents are left out."""

    def __init__(self, block: Block, size: int):
        self.hashes = block.word_hashes(1)[block.codes] if len(block.codes) else np.zeros(0, np.uint64)
        whole = window_hashes(self.hashes, size)
        owner = block.owners()
        self.at = np.flatnonzero(owner[: len(whole)] == owner[size - 1 :]) if len(whole) else np.zeros(0, np.int64)
        self.first = whole[self.at]
        ids = np.array([LAST if i is None else i for i in block.ids], np.int64)
        self.doc = ids[owner[self.at]]
        self.block, self.size = block, size

    def second(self, at: np.ndarray) -> np.ndarray:
        """Second 64 bits of the digest, for the windows numbered ``at``."""
        return window_hashes(self.block.word_hashes(2)[self.block.codes], self.size)[self.at[at]]


class Sketch:
    """Where windows fall in the rows of the sketch."""

    def __init__(self, groups: int, cells: int):
        self.groups, self.cells = groups, cells

    def cells_of(self, w: Windows, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct cells of a block (group in the upper half), their counts up to two, and the cell of each window."""
        h = mix(w.first + np.uint64(row + 1))
        cell = group_of(h, self.groups) << np.uint64(32) | (((h & np.uint64(0xFFFFFFFF)) * np.uint64(self.cells)) >> np.uint64(32))
        order = np.argsort(cell, kind="stable")
        c, d = cell[order], w.doc[order]
        new = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
        other = np.r_[False, d[1:] != d[:-1]] & ~new if len(c) else new
        place = np.cumsum(new) - 1
        many = np.zeros(int(new.sum()), np.uint8)
        many[place[other]] = 1
        # A block holds a cell twice if two of its documents do.
        back = np.empty(len(c), np.int64)
        back[order] = place
        return c[new], many + np.uint8(1), back

    def send(self, block: Block, size: int) -> Iterator[tuple[int, bytes, bytes]]:
        w = Windows(block, size)
        for row in range(ROWS):
            cells, counts, _ = self.cells_of(w, row)
            names, spans = runs(cells >> np.uint64(32))
            low = cells.astype(np.uint32)
            for name, (a, b) in zip(names.tolist(), spans):
                yield row * self.groups + name, planes(np.diff(low[a:b], prepend=np.uint32(0))), counts[a:b].tobytes()

    def merge(self, keys: list[bytes], counts: list[bytes]) -> list[bytes]:
        total = np.zeros(self.cells, np.uint8)
        cells = [np.cumsum(from_planes(k, np.uint32), dtype=np.uint32) for k in keys]
        for c, n in zip(cells, counts):
            total[c] = np.minimum(total[c] + np.frombuffer(n, np.uint8), 2)
        return [np.packbits(total[c] >= 2).tobytes() for c in cells]

    def repeated(self, w: Windows, answers: dict[int, bytes]) -> np.ndarray:
        """Numbers of the windows whose estimate is two or more."""
        keep = np.ones(len(w.at), bool)
        for row in range(ROWS):
            cells, _, back = self.cells_of(w, row)
            names, spans = runs(cells >> np.uint64(32))
            full = np.zeros(len(cells), bool)
            for name, (a, b) in zip(names.tolist(), spans):
                full[a:b] = np.unpackbits(np.frombuffer(answers[row * self.groups + name], np.uint8), count=b - a)
            keep &= full[back]
        return np.flatnonzero(keep)


class Digests:
    """Windows estimated repeated, as sorted distinct digests with the block's smallest document of each."""

    def __init__(self, w: Windows, at: np.ndarray):
        first, second, doc = w.first[at], w.second(at) if len(at) else np.zeros(0, np.uint64), w.doc[at]
        order = np.lexsort((doc, second, first))
        a, b = first[order], second[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        self.back = np.empty(len(a), np.int64)
        self.back[order] = np.cumsum(new) - 1
        self.first, self.second, self.least = a[new], b[new], doc[order][new]


def least_elsewhere(keys: list[bytes], docs: list[bytes]) -> list[bytes]:
    """For each block, which of its digests start in a document before the block's own."""
    parts = [np.frombuffer(k, np.uint64).reshape(2, -1) for k in keys]
    doc = np.concatenate([from_planes(d, np.int64) for d in docs])
    first, second = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((doc, second, first))
    a, b, d = first[order], second[order], doc[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    least = np.empty(len(d), np.int64)
    least[order] = d[new][np.cumsum(new) - 1]
    ends = np.cumsum([p.shape[1] for p in parts])
    return [np.packbits(x).tobytes() for x in np.split(least < doc, ends[:-1])]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for each row of ``docs``. ``kept`` is what is left of the text."""
    blocks = stored(encode_blocks(docs, doc_id, text))
    total = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    groups = max(1, -(-total // GROUP_WINDOWS))
    sketch = Sketch(groups, max(1024, CELLS * -(-total // groups)))
    full = stored(ask(blocks, lambda b: sketch.send(b, window), sketch.merge, "full"))

    def digests(block: Block, got: dict) -> pa.Table:
        w = Windows(block, window)
        d = Digests(w, sketch.repeated(w, got.get("full", {})))
        names, spans = runs(group_of(d.first, groups))
        return pa.table({
            "grp": pa.array(names.astype(np.int64)), "block": pa.array([block.name] * len(spans), pa.string()),
            "keys": pa.array([np.stack([d.first[a:b], d.second[a:b]]).tobytes() for a, b in spans], pa.binary()),
            "more": pa.array([planes(d.least[a:b]) for a, b in spans], pa.binary()),
        })

    from codecorpus.llm.blocks import QUESTION, reply

    earlier = reply(with_answers(blocks, full, digests, QUESTION), least_elsewhere, "earlier")

    def remove(block: Block, got: dict) -> pa.Table:
        w = Windows(block, window)
        at = sketch.repeated(w, got.get("full", {}))
        d = Digests(w, at)
        names, spans = runs(group_of(d.first, groups))
        before = np.zeros(len(d.first), bool)
        for name, (a, b) in zip(names.tolist(), spans):
            before[a:b] = np.unpackbits(np.frombuffer(got["earlier"][name], np.uint8), count=b - a)
        drop = w.at[at[before[d.back] | (w.doc[at] > d.least[d.back])]]
        edge = np.zeros(len(block.codes) + 1, np.int64)
        np.add.at(edge, drop, 1)
        np.add.at(edge, drop + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        left, word = [], block.vocab.__getitem__
        for start, end in zip((block.ends - block.lens).tolist(), block.ends.tolist()):
            left.append(b" ".join(map(word, block.codes[start:end][~gone[start:end]].tolist())))
        removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), block.ends - block.lens) * (block.lens > 0)
        out = {
            "doc_id": pa.array(block.ids, pa.int64()), "n_words": pa.array(block.lens), "n_removed": pa.array(removed),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
        }
        return pa.table(out | ({"kept": pa.array([x.decode() for x in left], pa.string())} if keep_text else {}))

    return with_answers(blocks, full.unionAll(earlier), remove, OUT + ", kept string" * keep_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
