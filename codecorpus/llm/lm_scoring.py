"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs (or longer n-grams) of the training documents are quantised to a logarithmic scale, and the filter holds the
n-gram once for each step up to its level. A count is read back by probing step after step until one is missing, so an error of
the filter can only raise a level, and rarely by more than one. The filter is cut into segments by the n-gram's hash; each is built
where all counts of its n-grams meet, and read there for all blocks that ask for them. A segment holds a bounded number of n-grams and
lives as long as its group's task: no worker holds the filter, whatever the size of the corpus, and the blocks are read once.

Probability of a word: an interpolation that starts with the smoothed word distribution (the base) and adds, for each order, the
n-gram's relative frequency with a weight that depends on how often its context was seen. Weights are fitted by leaving out each
training token once, from a histogram over all training documents.

Defined results: a null text counts as empty and consists of the end token. A null id is hashed as the empty text. Repeated rows are
counted and scored like others. With no training token at all the model is uniform over nothing, and scores are those of the
smoothing alone. An empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.blocks import Block, ask, encode_blocks, from_planes, group_of, mix, planes, runs, with_answers
from codecorpus.llm.common import stored, table

ORDER, SMOOTHING, FOLDS = 2, 0.1, 10
#: Entries of the filter: bits for each on average, and places probed for each.
BITS, PROBES = 10, 5
#: Distinct words or n-grams in a group on average.
GROUP_WORDS, GROUP_NGRAMS = 300_000, 700_000
#: Level l stands for counts from STEPS[l - 1] to below STEPS[l]: every count up to four, then two steps for each doubling.
STEPS = np.unique(np.ceil(2.0 ** (np.arange(0, 96) / 2)))
VALUES = np.r_[0.0, np.where(STEPS[:-1] < 4, STEPS[:-1], np.sqrt(STEPS[:-1] * (STEPS[1:] - 1))), STEPS[-1]]
#: Histogram of leave-one-out ratios: bins of a factor sqrt(2), and contexts by doublings of their count.
BIN_LOW, BINS, CONTEXTS = -24, 96, 40
#: Bits of an n-gram's hash that are used: 48 keep it apart from all others far better than the filter does, and travel in half the bytes.
KEPT_BITS, CUT = np.uint64(0xFFFFFFFFFFFF0000), np.uint64(16)
STARTS_WITH = np.uint64(0x5DEECE66D)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == 0


class Tokens:
    """Words and end tokens of a block in order. The end has the code after the last word's."""

    def __init__(self, block: Block):
        self.n_docs, self.end = len(block.lens), len(block.vocab)
        self.lens = block.lens + 1
        self.stops = np.cumsum(self.lens)
        self.starts = self.stops - self.lens
        self.codes = np.insert(block.codes.astype(np.int64), block.ends, self.end)
        self.out = np.array([held_out(i) for i in block.ids], bool)
        self.train = np.repeat(~self.out, self.lens)

    def ngrams(self, hashes: np.ndarray, order: int) -> np.ndarray:
        """Hash of the ``order`` tokens that end at each token; before the first word stand starts of text."""
        own = hashes[self.codes]
        total = own.copy()
        before = own
        for k in range(1, order):
            before = np.r_[STARTS_WITH, before[:-1]]
            before[self.starts] = STARTS_WITH
            total += before * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        return mix(total + np.uint64(order)) & KEPT_BITS


def token_hashes(block: Block) -> np.ndarray:
    return np.r_[block.word_hashes(3), np.uint64(0xE9D)]


def send_words(groups: int):
    """Distinct words of a block with their counts in its training documents, by group."""

    def send(block: Block) -> Iterator[tuple[int, bytes, bytes]]:
        t = Tokens(block)
        counts = np.bincount(t.codes[t.train], minlength=t.end + 1)[: t.end].astype(np.int64)
        where = group_of(mix(block.word_hashes(3)), groups).astype(np.int64)
        order = np.argsort(where, kind="stable")
        names, spans = runs(where[order])
        for name, (a, b) in zip(names.tolist(), spans):
            at = order[a:b]
            yield name, b"\n".join(map(block.vocab.__getitem__, at.tolist())), planes(counts[at])

    return send


def count_words(keys: list[bytes], counts: list[bytes]) -> list[bytes]:
    """Counts in all blocks, after a head with the group's tokens and distinct tokens in training documents."""
    words = [k.split(b"\n") for k in keys]
    total: dict[bytes, int] = {}
    for ws, n in zip(words, counts):
        for w, c in zip(ws, from_planes(n, np.int64).tolist()):
            total[w] = total.get(w, 0) + c
    head = np.array([sum(total.values()), sum(c > 0 for c in total.values())], np.int64).tobytes()
    return [head + planes(np.fromiter(map(total.__getitem__, ws), np.int64, len(ws))) for ws in words]


def send_ngrams(order: int, groups: int):
    """Distinct n-grams of a block with their counts in its training documents, by group."""

    def send(block: Block) -> Iterator[tuple[int, bytes, bytes]]:
        t = Tokens(block)
        marked = np.sort(t.ngrams(token_hashes(block), order) | t.train.astype(np.uint64))  # the lower bits are free
        at = np.flatnonzero(np.r_[True, marked[1:] >> CUT != marked[:-1] >> CUT])
        h, n = marked[at] & KEPT_BITS, np.add.reduceat(marked & np.uint64(1), at)
        names, spans = runs(group_of(h, groups))
        for name, (a, b) in zip(names.tolist(), spans):
            yield name, planes(np.diff(h[a:b] >> CUT, prepend=np.uint64(0))), planes(n[a:b].astype(np.uint32))

    return send


def places(h: np.ndarray, step: int, bits: int) -> list[np.ndarray]:
    """Bits of a segment that stand for step ``step`` of an n-gram."""
    a = mix(h + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
    b = mix(a) | np.uint64(1)
    return [((a + np.uint64(k) * b) & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32) for k in range(PROBES)]


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, counts, side="right")


def segment(h: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter's segment of distinct n-grams with their counts."""
    level = level_of(counts)
    bits = -(-int(level.sum()) * BITS // 8) * 8
    field = np.zeros(bits, bool)
    for step in range(1, int(level.max(initial=0)) + 1):
        for place in places(h[level >= step], step, bits):
            field[place] = True
    return np.packbits(field, bitorder="little").tobytes()


def probe(h: np.ndarray, segment: bytes) -> np.ndarray:
    """Levels of n-grams by repeated membership probes in their segment."""
    level, field, step = np.zeros(len(h), np.uint8), np.frombuffer(segment, np.uint8), 1
    bits, at = np.uint64(8 * len(field)), np.arange(len(h) if len(field) else 0)
    while len(at) and step < len(STEPS):
        a = mix(h[at] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        b = mix(a) | np.uint64(1)
        here = np.arange(len(at))
        for k in range(PROBES):  # most n-grams that are missing leave at the first probe
            bit = ((a[here] + np.uint64(k) * b[here]) & np.uint64(0xFFFFFFFF)) * bits >> np.uint64(32)
            here = here[(field[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        at = at[here]
        level[at] = step
        step += 1
    return level


def read_levels(keys: list[bytes], counts: list[bytes]) -> list[bytes]:
    """Levels of the n-grams of each block in a group, from the segment that their counts in all blocks make."""
    each = [np.cumsum(from_planes(x, np.uint64), dtype=np.uint64) for x in keys]
    h = np.concatenate(each) << CUT
    n = np.concatenate([from_planes(x, np.uint32) for x in counts]).astype(np.int64)
    order = np.argsort(h)
    ascending = h[order]
    new = np.r_[True, ascending[1:] != ascending[:-1]]
    cuts = np.flatnonzero(new)
    h, n = ascending[cuts], np.add.reduceat(n[order], cuts)
    level = np.empty(len(order), np.uint8)
    level[order] = probe(h, segment(h[n > 0], n[n > 0]))[np.cumsum(new) - 1]
    return [x.tobytes() for x in np.split(level, np.cumsum([len(x) for x in each])[:-1])]


COUNTED = "block string, ids array<bigint>, lens binary, codes binary, counts binary, levels array<binary>"
COUNTED_ARROW = pa.schema({
    "block": pa.string(), "ids": pa.list_(pa.int64()), "lens": pa.binary(), "codes": pa.binary(),
    "counts": pa.binary(), "levels": pa.list_(pa.binary()),
})


class Counted:
    """A block with the training count of each of its words and the levels of its n-grams of each order from two."""

    def __init__(self, row: dict, n: int, v: int, ends: int):
        self.block = Block(row | {"vocab": None})
        counts = from_planes(row["counts"], np.int64)
        self.block.vocab = [b""] * len(counts)
        self.tokens = Tokens(self.block)
        self.counts = np.r_[counts, ends].astype(np.float64)[self.tokens.codes]
        self.base = (self.counts + SMOOTHING) / (n + SMOOTHING * (v + 1))
        self.levels = [np.frombuffer(x, np.uint8) for x in row["levels"]]
        self.ends = ends

    def contexts(self, k: int) -> np.ndarray:
        """Count of the tokens before each token: of a word exactly, of more words by their level. Before the first word the count of
        texts, which is that of ends."""
        before = self.counts if k == 0 else VALUES[self.levels[k - 1]]
        before = np.r_[self.ends, before[:-1]]
        before[self.tokens.starts] = self.ends
        return before

    def ratio(self, k: int, lower: np.ndarray, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Context class, and relative frequency of the n-gram of order ``k + 2`` over the probability of the lower order."""
        own, context = VALUES[self.levels[k]], self.contexts(k)
        if leave_out:
            own, context = np.maximum(own - 1, 0), np.maximum(context - 1, 0)
        frequency = np.where(context > 0, np.minimum(own / np.maximum(context, 1), 1.0), 0.0)
        return np.minimum(np.log2(context + 1), CONTEXTS - 1).astype(np.int64), frequency / lower

    def probability(self, weights: list[np.ndarray], leave_out: bool = False) -> np.ndarray:
        p = self.base
        for k, weight in enumerate(weights):
            context, ratio = self.ratio(k, p, leave_out)
            share = np.where(context > 0, weight[context], 0.0)
            p = p * (1 - share + share * ratio)
        return p


def fit(histogram: np.ndarray) -> np.ndarray:
    """Weight of each context class that makes the histogram of ratios most likely (the likelihood has one maximum)."""
    middle = np.r_[0.0, 2.0 ** ((np.arange(1, BINS) + BIN_LOW) / 2)]
    out = np.zeros(CONTEXTS)
    for c in range(CONTEXTS):
        n = histogram[c] + np.eye(1, BINS, 0)[0]
        low, high = 0.0, 0.999
        for _ in range(40):
            mid = (low + high) / 2
            slope = float((n * (middle - 1) / (1 - mid + mid * middle)).sum())
            low, high = (mid, high) if slope > 0 else (low, mid)
        out[c] = low
    return out


def model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> tuple[DataFrame, tuple[int, int, int]]:
    """Blocks with counts and levels (:data:`COUNTED`); training tokens, distinct training tokens and training documents."""
    blocks = stored(encode_blocks(docs, doc_id, text, lower=True))
    total, distinct = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    word_groups, groups = max(1, -(-distinct // GROUP_WORDS)), max(1, -(-total // GROUP_NGRAMS))
    answers = stored(ask(blocks, send_words(word_groups), count_words, "words"))
    heads = answers.groupBy("grp").agg(F.first(F.expr("substring(answer, 1, 16)")).alias("head")).collect()
    n, v = (int(x) for x in sum((np.frombuffer(r["head"], np.int64) for r in heads), np.zeros(2, np.int64)))
    trained = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % FOLDS != 0
    ends = blocks.select(F.explode("ids").alias("id")).where(trained).count()
    for k in range(2, order + 1):
        answers = answers.unionAll(stored(ask(blocks, send_ngrams(k, groups), read_levels, f"levels {k}")))

    def start(block: Block, got: dict) -> pa.Table:
        counts = np.zeros(len(block.vocab), np.int64)
        where = group_of(mix(block.word_hashes(3)), word_groups).astype(np.int64)
        by = np.argsort(where, kind="stable")
        names, spans = runs(where[by])
        for name, (a, b) in zip(names.tolist(), spans):
            counts[by[a:b]] = from_planes(got["words"][name][16:], np.int64)
        tokens, hashes, levels = Tokens(block), token_hashes(block), []
        for k in range(2, order + 1):
            h, back = np.unique(tokens.ngrams(hashes, k), return_inverse=True)
            read = b"".join(got[f"levels {k}"][name] for name in runs(group_of(h, groups))[0].tolist())
            levels.append(np.frombuffer(read, np.uint8)[back].tobytes())
        values = [block.name, block.ids, block.lens.astype(np.int32).tobytes(), planes(block.codes), planes(counts), levels]
        return pa.Table.from_pylist([dict(zip(COUNTED_ARROW.names, values))], schema=COUNTED_ARROW)

    return stored(with_answers(blocks, answers, start, COUNTED)), (n + ends, v + (ends > 0), ends)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, broadcast_bytes: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``. Nothing is broadcast any more;
    ``broadcast_bytes`` is taken for callers that still name it."""
    counted, (n, v, ends) = model(docs, doc_id, text, order)
    weights: list[np.ndarray] = []
    for k in range(order - 1):
        weights.append(fit(histogram(counted, (n, v, ends), weights, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Counted(row, n, v, ends)
                t = c.tokens
                known = np.add.reduceat((c.counts > 0).astype(np.int64), t.starts)
                base = np.add.reduceat(np.log10(c.base), t.starts)
                full = np.add.reduceat(np.log10(c.probability(weights)), t.starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(c.block.ids, pa.int64()), pa.array(t.out), pa.array(t.lens), pa.array(known),
                    pa.array(np.full(t.n_docs, n, np.int64)), pa.array(base), pa.array(full),
                ], OUT_NAMES)

    return counted.mapInArrow(run, OUT)


OUT_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def histogram(counted: DataFrame, facts: tuple[int, int, int], weights: list[np.ndarray], k: int) -> np.ndarray:
    """Training tokens by context class and bin of the leave-one-out ratio, for order ``k + 2`` over all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CONTEXTS * BINS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                c = Counted(row, *facts)
                context, ratio = c.ratio(k, c.probability(weights, True), True)
                at = np.clip(np.rint(2 * np.log2(np.maximum(ratio, 1e-30))) - BIN_LOW, 1, BINS - 1)
                cell = context * BINS + np.where(ratio > 0, at, 0).astype(np.int64)
                total += np.bincount(cell[c.tokens.train], minlength=CONTEXTS * BINS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["cell", "n"])

    out = np.zeros(CONTEXTS * BINS)
    for row in counted.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(CONTEXTS, BINS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
