"""Blocks: a few megabytes of whole documents, dictionary-encoded into one row of arrays, and questions between blocks.

Counts over a corpus (words, n-grams, windows) go by *asking*: each block sends its distinct keys, packed into arrays, to
groups chosen by the key's hash; a group sees all blocks that hold its keys and answers each of them in the order of its keys.
So a key travels once per block however often it occurs, a group holds a bounded number of keys because the number of groups
follows the number of keys, and nothing goes through the driver. Documents are never cut: a longer one is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text after which a block is closed.
BLOCK_BYTES = 2 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SCHEMA = "block string, ids array<bigint>, lens binary, codes binary, vocab binary, n_words bigint, n_distinct bigint"


def encode_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, lower: bool = False) -> DataFrame:
    """One row per block: ids of its documents, words per document, codes of the words (:func:`planes`), and the distinct words joined by ``\\n``.
    Write the result before using it twice: a block's name is its place in the run that made it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, lens, codes, vocab, size = [], [], [], {}, 0

        def close() -> pa.RecordBatch:
            row = [f"{part}-{n}", ids, np.array(lens, np.int32).tobytes(), planes(np.frombuffer(b"".join(codes), np.int32)), b"\n".join(vocab), sum(lens), len(vocab)]
            kinds = [pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            names = ["block", "ids", "lens", "codes", "vocab", "n_words", "n_distinct"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                raw = (value.as_py() or "").encode("utf-8")
                ws = (raw.translate(LOWER) if lower else raw).split()
                for w in ws:
                    if w not in vocab:
                        vocab[w] = len(vocab)
                codes.append(np.fromiter(map(vocab.__getitem__, ws), np.int32, len(ws)).tobytes())
                ids.append(key.as_py())
                lens.append(len(ws))
                size += len(raw)
                if size >= block_bytes:
                    yield close()
                    n += 1
                    ids, lens, codes, vocab, size = [], [], [], {}, 0
        if ids:
            yield close()

    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


class Block:
    """One row of :func:`encode_blocks` as arrays."""

    def __init__(self, row: dict):
        self.name = row["block"]
        self.ids = row["ids"]
        self.lens = np.frombuffer(row["lens"], np.int32).astype(np.int64)
        self.codes = from_planes(row["codes"], np.int32)
        #: Distinct words in the order of their codes; none if the block has no word.
        self.vocab = row["vocab"].split(b"\n") if row.get("vocab") else []
        self.ends = np.cumsum(self.lens)

    def owners(self) -> np.ndarray:
        """Number of the document of each word."""
        return np.repeat(np.arange(len(self.lens)), self.lens)

    def word_hashes(self, seed: int) -> np.ndarray:
        """64-bit hash of each distinct word."""
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w, seed) for w in self.vocab), np.uint64, len(self.vocab))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes: a polynomial in an odd number, mixed."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + n]
    return mix(out)


def group_of(h: np.ndarray, groups: int) -> np.ndarray:
    """Group of a hash by its upper 32 bits: sorted hashes have sorted groups."""
    return ((h >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)


def runs(sorted_groups: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Distinct values of a sorted array and the span of each."""
    if not len(sorted_groups):
        return sorted_groups, []
    cuts = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1], True])
    return sorted_groups[cuts[:-1]], list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def planes(values: np.ndarray) -> bytes:
    """Bytes of unsigned numbers with all first bytes together, then all second ones, ...: small numbers compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


QUESTION = "grp bigint, block string, keys binary, more binary"
ANSWER = "block string, kind string, grp bigint, answer binary"


def ask(blocks: DataFrame, send: Callable[[Block], Iterator[tuple[int, bytes, bytes]]], answer: Callable[[list[bytes], list[bytes]], list[bytes]], kind: str) -> DataFrame:
    """Answers (block, kind, grp, answer): ``send`` gives (group, keys, more) of a block; ``answer`` gets keys and more of all
    blocks that ask one group and answers each."""
    return reply(question(blocks, send), answer, kind)


def question(blocks: DataFrame, send: Callable[[Block], Iterator[tuple[int, bytes, bytes]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = list(send(Block(row)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([p[0] for p in parts], pa.int64()), pa.array([row["block"]] * len(parts), pa.string()),
                    pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary()),
                ], ["grp", "block", "keys", "more"])

    return blocks.mapInArrow(run, QUESTION)


def reply(asked: DataFrame, answer: Callable[[list[bytes], list[bytes]], list[bytes]], kind: str) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        got = answer(group.column("keys").to_pylist(), group.column("more").to_pylist())
        names = group.column("block").to_pylist()
        return pa.table({
            "block": pa.array(names, pa.string()), "kind": pa.array([kind] * len(names), pa.string()),
            "grp": group.column("grp").combine_chunks(), "answer": pa.array(got, pa.binary()),
        })

    return asked.groupBy("grp").applyInArrow(run, ANSWER)


def with_answers(blocks: DataFrame, answers: DataFrame, fn: Callable[[Block, dict[str, dict[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """``fn`` of every block and its answers by kind and group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[str, dict[int, bytes]] = {}
        for row in right.to_pylist():
            got.setdefault(row["kind"], {})[row["grp"]] = row["answer"]
        out = [fn(Block(row), got) for row in left.to_pylist()]
        return pa.concat_tables(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
