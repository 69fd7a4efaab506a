"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words of the documents, benchmark items are the queries. Terms are the words of the items; TF-IDF weights
use passage counts over all documents. A randomised SVD of all passages of all documents and, with the same total weight, of the
items gives the latent space: it starts from the directions of the items, and one sum over the partitions of the passages does the rest. Every window of every document is projected into it and compared
with all items of its length class by cosine. Candidates are then checked word by word: the longest common subsequence with the
item must cover most of it, or a smaller part (a paraphrase) together with the item's answer.

Which windows and items are compared at all is decided by an exact bound: a match covers at least ``needed`` words of an item, so of any ``r`` of
its words at least ``r`` less what may be missing are in the window and the words around it. Lists from the rarer words of the items
(``RARE`` of each) to the items count them for all windows of some documents at once. No window that could be confirmed is left out.

There is one space and one vocabulary for all items, broadcast with the items: some 0.6 KB for each distinct word of the benchmark, 60 MB for 100,000
words. Within a task items are counted in blocks of ``BLOCK_ITEMS``, which bounds memory and changes no result.

Defined results: null or empty texts match nothing; null and empty items are left out; an item with fewer than ``SHORT`` words must
be found whole. Rows with a null id are not reported, since nobody could find them; repeated rows are reported each. Without
items or documents there are no matches. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.blocks import from_planes, planes
from codecorpus.llm.common import stored, table

#: Rank of the latent space and extra directions of the random projection.
RANK, EXTRA = 128, 16
#: Words of a passage (a byte holds each of its counts), and the commonest terms, which are summed as a dense matrix.
PASSAGE, OFTEN = 64, 256
#: Window lengths; an item belongs to the first that holds it. Windows start every half length.
SCALES = (16, 32, 64, 128, 256)
#: Least cosine of a candidate.
COSINE = 0.35
#: Share of an item that the common subsequence must cover: alone, and together with the answer.
COVER, COVER_WITH_ANSWER, SHORT = 0.7, 0.5, 8
#: The answer of an item without one: its rarest terms, this share of them; found if most of them are there in order.
ANSWER_SHARE, ANSWER_FOUND = 0.25, 0.75
BLOCK_ITEMS = 2_000
#: Share of an item's words, the rarest, that the lists hold.
RARE = 0.65
#: Characters of the documents counted or searched together, and counters (window, item) held at once.
TOGETHER, COUNTERS = 200_000, 4_000_000
#: Terms in a piece of a summed matrix, and marks (window, term) held at once.
PIECE, MARKS = 4096, 2_000_000

#: Upper case to lower case, and punctuation to white space.
PLAIN = bytes(32 if chr(c) in "\"'()[]{}<>.,;:!?*#$%&|_=+-/\\`~^@" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(PLAIN).split()


SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """:func:`terms` of several texts one after another, and how many each has."""
    raw = [(t or "").encode("utf-8") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw).translate(PLAIN), np.uint8)
    gap = SPACE[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(gap) and not gap[0]:
        edges = np.r_[0, edges]
    begins, ends = edges[::2], edges[1::2]  # every text ends with a space, and so does every word
    offsets = np.r_[0, np.cumsum(ends - begins)].astype(np.int32)
    letters = np.ascontiguousarray(data[~gap])
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    limits = np.cumsum([len(r) for r in raw])
    upto = np.searchsorted(begins, limits)
    return words, np.diff(upto, prepend=0)


def together(texts: pa.Array) -> Iterator[list[str | None]]:
    """All texts in order, some at a time: a list ends with the text that brings it to ``TOGETHER`` characters."""
    held, size = [], 0
    for value in texts:
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Item:
    item_id: int
    ids: np.ndarray
    answer: np.ndarray | None


@dataclass
class Benchmark:
    """A block of items over their own vocabulary; number ``len(vocab)`` stands for every other term."""

    vocab: dict[bytes, int]
    items: list[Item]

    def ids(self, text: str | None) -> np.ndarray:
        ts, get, other = terms(text), self.vocab.get, len(self.vocab)
        return np.fromiter(map(get, ts, repeat(other)), np.int32, len(ts))

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """``ids`` of several texts, cut into words and looked up together."""
        words, counts = words_of(texts)
        ids = pc.index_in(words, value_set=pa.array(self.vocab, pa.binary())).fill_null(len(self.vocab)).to_numpy()
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


def benchmark_of(rows: list[tuple[int, str, str | None]]) -> Benchmark:
    vocab: dict[bytes, int] = {}
    for _, text, answer in rows:
        for t in terms(text) + terms(answer):
            vocab.setdefault(t, len(vocab))
    out = Benchmark(vocab, [])
    for item_id, text, answer in rows:
        ids = out.ids(text)
        if len(ids):
            out.items.append(Item(item_id, ids, out.ids(answer) if answer and terms(answer) else None))
    return out


def starts(n: int, size: int) -> np.ndarray:
    """Starts of windows over ``n`` words: every half size; the last one is cut short by the end."""
    return np.arange(0, max(n - size // 2, min(n, 1)), size // 2)


def counted(parts: list[np.ndarray], v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, times) of the distinct terms of passages one after another, and the words of each passage that are no term."""
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return counted_at(np.repeat(np.arange(len(parts)), [len(x) for x in parts]), ids, len(parts), v)


def counted_at(place: np.ndarray, ids: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    known = ids < v
    key = np.sort(place[known] * max(v, 1) + ids[known])
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times, key = np.diff(np.r_[cuts, len(key)]), key[cuts]
    return key // max(v, 1), key % max(v, 1), times, np.bincount(place[~known], minlength=n)


def packed(place: np.ndarray, term: np.ndarray, times: np.ndarray, others: np.ndarray) -> bytes:
    """:func:`counted` passages of at most ``PASSAGE`` words as bytes."""
    lens = np.bincount(place, minlength=len(others))
    return b"".join([np.int32(len(others)).tobytes(), *(x.astype(np.uint8).tobytes() for x in (lens, others, times)), planes(term.astype(np.int32))])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int32, 1)[0])
    lens, others = (np.frombuffer(data, np.uint8, n, 4 + k * n) for k in range(2))
    size = int(lens.sum())
    return np.repeat(np.arange(n), lens), from_planes(data[4 + 2 * n + size :], np.int32), np.frombuffer(data, np.uint8, size, 4 + 2 * n), others


def survey(docs: DataFrame, shared, sample: int | None = None) -> DataFrame:
    """(kind, n, h, ids) from one pass: ``count`` rows with passage counts of each term, a ``total`` of passages, and ``passages`` rows with all
    passages, :func:`packed`, ``n`` in a row. With ``sample`` instead of these the ``passage`` rows with the smallest hashes, no more than that from a task."""
    import xxhash

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["kind", "n", "h", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        v = len(bench.vocab)
        df, total, pool = np.zeros(v, np.int64), 0, []
        limit = 1 << 64
        for texts in (held for batch in batches for held in together(batch.column(0))):
            places, at, every = [], 0, bench.ids_of(texts)
            for ids in every:
                places.append(np.arange(len(ids)) // PASSAGE + at)
                n = -(-len(ids) // PASSAGE)
                for k in range(n if sample is not None else 0):
                    part = ids[k * PASSAGE : (k + 1) * PASSAGE].tobytes()
                    h = xxhash.xxh3_64_intdigest(part)
                    if h < limit:
                        pool.append((h, part))
                at += n
                if sample is not None and len(pool) > 2 * sample:
                    pool = sorted(set(pool))[:sample]
                    limit = pool[-1][0] + 1 if len(pool) == sample else limit
            total += at
            if at:
                passages = counted_at(np.concatenate(places), np.concatenate(every), at, v)
                df += np.bincount(passages[1], minlength=v)
                if sample is None:
                    yield table_of([("passages", at, 0, packed(*passages))])
        rows = [("count", int(n), int(t), None) for t, n in enumerate(df) if n] + [("total", total, 0, None)]
        yield table_of(rows + [("passage", 1, h - (1 << 63), part) for h, part in sorted(set(pool))[:sample]])

    return docs.mapInArrow(run, "kind string, n bigint, h bigint, ids binary")


def tfidf(ids: np.ndarray, lens: np.ndarray, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Products of unit TF-IDF rows (concatenated terms and their number per row) with ``matrix``. A row's length counts every
    occurrence; terms outside the vocabulary have a length only."""
    v = len(idf) - 1
    owner = np.repeat(np.arange(len(lens)), lens)
    w = idf[ids]
    norm = np.sqrt(np.bincount(owner, w * w, len(lens)))
    known = ids < v
    out = np.zeros((len(lens), matrix.shape[1]), np.float32)
    add_rows(out, owner[known], matrix[ids[known]] * w[known, None])
    return out / np.maximum(norm, 1e-9)[:, None].astype(np.float32)


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds ``rows`` to the rows ``at`` of ``out``."""
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[cuts]] += np.add.reduceat(rows[order], cuts, axis=0)


@dataclass
class Sum:
    """``A' (A M)`` over passages A, added up some at a time. The commonest terms hold most of the counts and go as a dense matrix."""

    matrix: np.ndarray
    idf: np.ndarray
    often: np.ndarray

    def __post_init__(self):
        self.total = np.zeros(self.matrix.shape, np.float32)
        self.slot = np.full(len(self.matrix), -1)
        self.slot[self.often] = np.arange(len(self.often))

    def add(self, place: np.ndarray, term: np.ndarray, times: np.ndarray, others: np.ndarray) -> None:
        """Adds :func:`counted` passages; rows are unit TF-IDF rows as in :func:`tfidf`."""
        w, n = self.idf[term], len(others)
        norm = np.sqrt(np.bincount(place, times * w * w, n) + others * self.idf[-1] ** 2)
        a = (times * w / norm[place]).astype(np.float32)
        slot = self.slot[term]
        dense = slot >= 0
        matrix = np.zeros((n, len(self.often)), np.float32)
        matrix[place[dense], slot[dense]] = a[dense]
        place, term, a = place[~dense], term[~dense], a[~dense, None]
        y = matrix @ self.matrix[self.often]
        add_rows(y, place, self.matrix[term] * a)
        self.total[self.often] += matrix.T @ y
        add_rows(self.total, term, y[place] * a)


def summed(passages: DataFrame, matrix: np.ndarray, idf: np.ndarray, often: np.ndarray) -> np.ndarray:
    """:class:`Sum` of all rows of packed passages, added up piece by piece in tasks."""
    width = matrix.shape[1]
    sent = passages.sparkSession.sparkContext.broadcast((matrix, idf, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sum(*sent.value)
        for batch in batches:
            for x in batch.column(0):
                own.add(*unpacked(x.as_py()))
        pieces = [own.total[a : a + PIECE] for a in range(0, len(own.total), PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "part"])

    def add(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.float32) for x in group.column("part").to_pylist()]
        return pa.table({"piece": group.column("piece")[:1].combine_chunks(), "part": pa.array([np.sum(parts, axis=0, dtype=np.float64).astype(np.float32).tobytes()], pa.binary())})

    schema = "piece bigint, part binary"
    rows = passages.mapInArrow(run, schema).groupBy("piece").applyInArrow(add, schema).collect()
    sent.unpersist()
    got = [np.frombuffer(r["part"], np.float32) for r in sorted(rows, key=lambda r: r["piece"])]
    return np.concatenate(got).reshape(-1, width) if got else np.zeros(matrix.shape, np.float32)


def latent_space(passages: DataFrame, items: list[Item], times: int, idf: np.ndarray, often: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF passages and ``times`` times the items: a randomised SVD of the items gives the
    directions, which one product with the whole matrix turns into its own (the Nyström approximation of a positive matrix)."""
    v = len(idf) - 1

    def of_items(matrix: np.ndarray) -> np.ndarray:
        own = Sum(matrix.astype(np.float32), idf, often)
        for at in range(0, len(items), 256):
            own.add(*counted([i.ids for i in items[at : at + 256]], v))
        return own.total.astype(np.float64)

    noise = np.random.default_rng(7).standard_normal((v, min(rank + EXTRA, v)))
    q = np.linalg.qr(noise)[0]
    for _ in range(3):
        y = of_items(q)
        q = np.linalg.qr(y + 1e-4 * np.linalg.norm(y) / np.linalg.norm(noise) * noise)[0]  # the items may have fewer directions
    y = summed(passages, q.astype(np.float32), idf, often) + times * of_items(q)
    y += 1e-7 * np.linalg.norm(y) * q  # keeps the root real whatever is rounded
    root, vectors = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    kept = root > 1e-9 * root[-1]
    u = np.linalg.svd(y @ (vectors[:, kept] / np.sqrt(root[kept])), full_matrices=False)[0]
    return u[:, : min(rank, v)].astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time as the bits of a number."""
    masks: dict[int, int] = {}
    for k, t in enumerate(a.tolist()):
        masks[t] = masks.get(t, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for t in b.tolist():
        m = masks.get(t)
        if m is not None:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


@dataclass
class Limit:
    """What ``confirm`` asks of some items of a length class: it looks at ``margin`` words at most on each side of a window, ``needed`` of the
    words of an item (row of ``padded``) must be there, and ``least`` of its rarer words. The latter are listed by word: the
    items of word ``t``, and how often each holds it, are ``members`` and ``times`` from ``ends[t - 1]`` to ``ends[t]``."""

    margin: int
    padded: np.ndarray
    needed: np.ndarray
    least: np.ndarray
    ends: np.ndarray
    members: np.ndarray
    times: np.ndarray

    def possible(self, here: np.ndarray, words: np.ndarray, lens: np.ndarray, window: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which of the pairs (window, item) have enough words of the item among the window's; ``words`` of windows one after another, ``lens`` of
        each. ``here`` has a row for each window and a column for each word, all false before and after."""
        marks = np.repeat(np.arange(len(lens)), lens), words
        here[marks] = True
        here[:, -1] = False
        sure = here[window[:, None], self.padded[items]].sum(axis=1) >= self.needed[items]
        here[marks] = False
        return sure


@dataclass
class Index:
    """What the search broadcasts: items and their directions in the latent space, by length class, in blocks."""

    bench: Benchmark
    idf: np.ndarray
    #: Latent directions of the terms, times their weights.
    space: np.ndarray
    #: (window length, directions, items, limit).
    classes: list[tuple[int, np.ndarray, list[Item], Limit]]
    #: Items of fewer than ``SHORT`` words by their rarest word, with its place.
    short: dict[int, list[tuple[int, Item]]]


def needed(item: Item) -> int:
    """Least words of the item that a confirmed match covers."""
    return len(item.ids) if len(item.ids) < SHORT else int(np.ceil(COVER_WITH_ANSWER * len(item.ids)))


def margin(item: Item) -> int:
    """Words on each side of a window that ``confirm`` looks at."""
    return len(item.ids) // 2 if len(item.ids) <= SCALES[-1] else len(item.ids)


def limit_of(items: list[Item], idf: np.ndarray) -> Limit:
    other = len(idf) - 1
    padded = np.full((len(items), max(len(i.ids) for i in items)), other, np.int32)
    rare, owner, least = [], [], []
    for k, (row, item) in enumerate(zip(padded, items)):
        row[: len(item.ids)] = item.ids
        missing = len(item.ids) - needed(item)
        r = min(len(item.ids), max(missing + 1, int(np.ceil(RARE * len(item.ids)))))
        rare.append(item.ids[np.argsort(-idf[item.ids], kind="stable")[:r]])
        owner.append(np.full(r, k))
        least.append(r - missing)
    pairs, times = np.unique(np.concatenate(rare).astype(np.int64) * len(items) + np.concatenate(owner), return_counts=True)
    ends = np.cumsum(np.bincount(pairs // len(items), minlength=other + 1))
    return Limit(max(margin(i) for i in items), padded, np.array([needed(i) for i in items]), np.array(least), ends, pairs % len(items), times)


def index_of(bench: Benchmark, idf: np.ndarray, space: np.ndarray, block_items: int = BLOCK_ITEMS) -> Index:
    by: dict[int, list[Item]] = {}
    for item in bench.items:
        by.setdefault(next((s for s in SCALES if s >= len(item.ids)), SCALES[-1]), []).append(item)
    classes = []
    for size, all_items in by.items():
        for at in range(0, len(all_items), block_items):
            items = all_items[at : at + block_items]
            q = tfidf(np.concatenate([i.ids for i in items]), np.array([len(i.ids) for i in items]), idf, space)
            classes.append((size, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9), items, limit_of(items, idf)))
    return Index(bench, idf, (space * idf[:-1, None]).astype(np.float32), classes, short_items(bench, idf))


def short_items(bench: Benchmark, idf: np.ndarray) -> dict[int, list[tuple[int, Item]]]:
    out: dict[int, list[tuple[int, Item]]] = {}
    for item in bench.items:
        if len(item.ids) < SHORT:
            place = int(np.argmax(idf[item.ids]))
            out.setdefault(int(item.ids[place]), []).append((place, item))
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct values in order; by a sort, which is faster here than a hash table."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def spread(begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places ``begin .. begin + len - 1`` of all spans, one span after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + lens, lens)


def hopeful(docs: list[np.ndarray], size: int, limit: Limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place of the window, item) of all windows of a length that can hold enough of an item's rarer words."""
    half, n_items = size // 2, len(limit.least)
    lens = np.array([len(d) for d in docs])
    windows = np.where(lens > 0, np.maximum(1, -(-(lens - half) // half)), 0)
    first = np.cumsum(windows) - windows
    words = np.concatenate(docs).astype(np.int64)
    at = np.arange(len(words)) - np.repeat(np.cumsum(lens) - lens, lens)
    lists = np.diff(limit.ends, prepend=0)
    listed = np.flatnonzero(lists[words])
    if not len(listed):
        return (np.zeros(0, np.int64),) * 3
    # Distinct words of each piece of half a window; a window and its margins are some pieces that follow each other.
    vocab = len(limit.ends)
    pieces = -(-lens // half)
    base = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(docs)), lens)[listed]
    key = distinct((base[owner] + at[listed] // half) * vocab + words[listed])
    piece, word = key // vocab, key % vocab
    doc = np.searchsorted(base, piece, "right") - 1
    local, reach = piece - base[doc], -(-limit.margin // half)
    keys = []
    for back in range(-reach, reach + 2):
        q = local - back
        valid = (q >= 0) & (q < windows[doc])
        keys.append((first[doc[valid]] + q[valid]) * vocab + word[valid])
    key = distinct(np.concatenate(keys))
    window, word = key // vocab, key % vocab
    found_w, found_i = [], []
    step = max(1, COUNTERS // n_items)
    cuts = np.searchsorted(window, np.arange(0, int(windows.sum()) + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a == b:
            continue
        n = lists[word[a:b]]
        post = spread(limit.ends[word[a:b]] - n, n)
        low = k * step
        counts = np.bincount((np.repeat(window[a:b], n) - low) * n_items + limit.members[post], limit.times[post], minlength=n_items)
        hit = np.flatnonzero(counts)
        hit = hit[counts[hit] >= limit.least[hit % n_items]]
        found_w.append(low + hit // n_items)
        found_i.append(hit % n_items)
    window, item = np.concatenate(found_w), np.concatenate(found_i)
    doc = np.searchsorted(first + windows, window, "right")
    return doc, (window - first[doc]) * half, item


def projected(docs: list[np.ndarray], doc: np.ndarray, at: np.ndarray, size: int, space: np.ndarray) -> np.ndarray:
    """Unit latent vectors of windows. Windows start every half length, so each is the sum of two halves, which are projected once."""
    half, lens = size // 2, np.array([len(d) for d in docs])
    words, begins, pieces = np.concatenate(docs), np.cumsum(lens) - lens, -(-lens // half)
    base = np.cumsum(pieces) - pieces
    left = base[doc] + at // half
    second = at + half < lens[doc]
    wanted = distinct(np.r_[left, left[second] + 1])
    owner = np.searchsorted(base + pieces, wanted, "right")
    start = (wanted - base[owner]) * half
    n = np.minimum(half, lens[owner] - start)
    sums = np.zeros((len(wanted) + 1, space.shape[1]), np.float32)
    for k in range(0, len(wanted), 512):
        part, row = words[spread(begins[owner[k : k + 512]] + start[k : k + 512], n[k : k + 512])], np.repeat(np.arange(k, min(k + 512, len(wanted))), n[k : k + 512])
        known = np.flatnonzero(part < len(space))
        if len(known):
            row = row[known]
            cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sums[row[cuts]] = np.add.reduceat(space[part[known]], cuts, axis=0)
    place = np.searchsorted(wanted, left)
    out = sums[place] + sums[np.where(second, place + 1, len(wanted))]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def verbatim(ids: np.ndarray, index: Index) -> list[tuple[Item, int, int, float]]:
    """The first place of each short item whose words stand in the document one after the other."""
    if not index.short:
        return []
    mark = np.zeros(len(index.idf), bool)
    mark[list(index.short)] = True
    found: dict[int, tuple[Item, int, int, float]] = {}
    for p in np.flatnonzero(mark[ids]).tolist():
        for place, item in index.short[int(ids[p])]:
            start = p - place
            if start >= 0 and id(item) not in found and np.array_equal(ids[start : start + len(item.ids)], item.ids):
                found[id(item)] = (item, start, start + len(item.ids), 1.0)
    return list(found.values())


def search(docs: list[np.ndarray], index: Index) -> list[list[tuple[Item, int, int, float]]]:
    """Candidates (item, start, end, cosine) of each document."""
    out: list[list[tuple[Item, int, int, float]]] = [verbatim(ids, index) if len(ids) else [] for ids in docs]
    if not sum(map(len, docs)):
        return out
    lens = np.array([len(ids) for ids in docs])
    words, begins = np.concatenate(docs), np.cumsum(lens) - lens
    here = np.zeros((max(1, min(512, MARKS // len(index.idf))), len(index.idf)), bool)
    for size, directions, items, limit in index.classes:
        doc, at, item = hopeful(docs, size, limit)
        if not len(doc):
            continue
        # One vector for each window; pairs come window by window.
        new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])]
        vectors, of = projected(docs, doc[new], at[new], size, index.space), np.cumsum(new) - 1
        near = np.concatenate([np.einsum("nk,nk->n", vectors[of[k : k + 4096]], directions[item[k : k + 4096]]) for k in range(0, len(of), 4096)])
        close = np.flatnonzero(near >= COSINE)
        for k in range(0, len(close), len(here)):
            some = close[k : k + len(here)]
            new = np.r_[True, of[some[1:]] != of[some[:-1]]]
            d, start = doc[some[new]], at[some[new]]
            end = np.minimum(start + size, lens[d])
            low, high = np.maximum(0, start - limit.margin), np.minimum(end + limit.margin, lens[d])
            window = np.cumsum(new) - 1
            sure = limit.possible(here, words[spread(begins[d] + low, high - low)], high - low, window, item[some])
            for w, i, cosine in zip(window[sure].tolist(), item[some[sure]].tolist(), near[some[sure]].tolist()):
                out[d[w]].append((items[i], int(start[w]), int(end[w]), cosine))
    return out


def confirm(ids: np.ndarray, item: Item, start: int, end: int, idf: np.ndarray) -> tuple[float, bool]:
    """Share of the item covered by its longest common subsequence with the window and half a length around it, and whether the
    answer is there."""
    need = len(item.ids)
    window = ids[max(0, start - need // 2) : end + need // 2] if need <= SCALES[-1] else ids[max(0, start - need) : end + need]
    there = set(window.tolist())
    if sum(t in there for t in item.ids.tolist()) / need < COVER_WITH_ANSWER:  # no more words than that can be covered
        return 0.0, False
    cover = common_subsequence(item.ids, window) / need
    answer = item.answer
    if answer is None:
        rare = np.sort(np.argsort(-idf[item.ids], kind="stable")[: max(1, round(ANSWER_SHARE * need))])
        answer = item.ids[rare]
    return cover, common_subsequence(answer, window) >= ANSWER_FOUND * len(answer)


def best_of(ids: np.ndarray, candidates: list[tuple[Item, int, int, float]], idf: np.ndarray) -> dict[int, tuple]:
    """The best confirmed match of each item in one document."""
    best: dict[int, tuple] = {}
    for item, start, end, cosine in candidates:
        cover, answered = confirm(ids, item, start, end, idf)
        least = 1.0 if len(item.ids) < SHORT else COVER_WITH_ANSWER if answered else COVER
        if cover >= least and (item.item_id not in best or (cover, cosine) > best[item.item_id][4:2:-1]):
            best[item.item_id] = (item.item_id, start, end, cosine, cover, answered)
    return best


def found(texts: pa.Array, index: Index) -> Iterator[dict[int, tuple]]:
    """The best confirmed match of each item in each of some documents, which are searched together up to ``TOGETHER`` characters."""
    for held in together(texts):
        docs = index.bench.ids_of(held)
        yield from (best_of(ids, candidates, index.idf) for ids, candidates in zip(docs, search(docs, index)))


MATCH = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, cosine double, cover double, answer_found boolean"


def matches(docs: DataFrame, shared, doc_id: str, text: str) -> DataFrame:
    """Best confirmed match of each document and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            rows = []
            for key, best in zip(batch.column(0), found(batch.column(1), index)):
                rows += [(key.as_py(), *m) for m in best.values()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], MATCH_NAMES)

    return docs.select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, MATCH)


MATCH_NAMES = [c.split()[0] for c in MATCH.split(", ")]


def index_for(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, sample: int | None = None, block_items: int = BLOCK_ITEMS):
    """The broadcast index of all items; None without any. The space is fitted on all passages, or with ``sample`` on so many with the smallest hashes."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer"))
    rows = [(r["id"], r["text"], r["answer"]) for r in items.where("id IS NOT NULL AND trim(text) <> ''").orderBy("id", "text").collect()]
    bench = benchmark_of(rows)
    if not bench.items:
        return None
    v = len(bench.vocab)
    shared = spark.sparkContext.broadcast(bench)
    seen = stored(survey(docs.select(text), shared, sample))
    df, total = np.zeros(v), 0
    for r in seen.where("kind IN ('count', 'total')").groupBy("kind", "h").agg(F.sum("n").alias("n")).collect():
        if r["kind"] == "total":
            total = r["n"]
        else:
            df[r["h"]] = r["n"]
    # A term outside the vocabulary weighs as much as the benchmark's rarest.
    idf = np.log((1 + total) / (1 + np.r_[df, 0.0])) + 1
    idf[v] = idf[:v].max()
    if sample is None:
        fitted, n = seen.where("kind = 'passages'").select("ids"), total
    else:
        picked = stored(seen.where("kind = 'passage'").select("ids", "h").distinct().orderBy("h").limit(sample).select("ids"))
        fitted, n = picked.mapInArrow(pack_rows(v), "ids binary"), picked.count()
    # The items weigh as much as the passages, so that the space tells them apart and not only common words.
    space = latent_space(fitted, bench.items, max(1, n // len(bench.items)), idf, np.argsort(-df, kind="stable")[:OFTEN])
    shared.unpersist()
    return spark.sparkContext.broadcast(index_of(bench, idf, space, block_items))


def pack_rows(v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = packed(*counted([np.frombuffer(x.as_py(), np.int32) for x in batch.column(0)], v))
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["ids"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, sample: int | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, cosine, cover, answer_found) of every leaked item found in ``docs``."""
    docs = docs.where(F.col(doc_id).isNotNull())
    index = index_for(docs, benchmark, text, item_id, item_text, answer, sample, block_items)
    return docs.sparkSession.createDataFrame([], MATCH) if index is None else matches(docs, index, doc_id, text)


def clean(docs: DataFrame, benchmark: DataFrame, unnamed: bool = False) -> DataFrame:
    """``docs`` without the rows that hold a leaked item, each judged by its own text; with ``unnamed`` also those without an id."""

    def without_leaks(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for batch in batches:
                rows = zip(batch.column("doc_id"), found(batch.column("text"), index))
                yield batch.filter(pa.array([not unnamed and not key.is_valid or not best for key, best in rows], pa.bool_()))

        return run

    index = index_for(docs, benchmark)
    return docs if index is None else docs.mapInArrow(without_leaks(index), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
