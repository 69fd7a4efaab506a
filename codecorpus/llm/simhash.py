"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks so that two fingerprints within the threshold agree in some block up to ``threshold // blocks``
bits. The anchors of a block are the words of a covering code: the perfect (15, 11) code on 15 of its bits, which has covering
radius one, and all values of the other bits. A fingerprint is replicated to every anchor within covering radius plus the
block's threshold. Of two fingerprints within that threshold, the anchor nearest to the one is then also an anchor of the
other, so each linked pair meets at an anchor and none is lost.

Distinct fingerprints only are compared. At an anchor they are compared within blocks of shifted arrays or, if there are
many, by a search that takes each fingerprint it reaches out of the rest, and only links that join two groups are kept: at most
one less than there are fingerprints, however dense they lie. Links become components by alternating star contraction.

Defined results: a null or empty text has the fingerprint zero, linked like any other. Rows with a null id get a fingerprint and
their component's smallest id, null if it has none. Repeated rows stay. An empty table gives no rows. Results keep only the
id and the columns named here, so other columns can't clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.common import stored, table

SEED, SHINGLE, THRESHOLD = 42, 4, 4
#: (lowest bit, bits) of each block; a block has 15 coded bits, the others stand for themselves.
BLOCKS = [(0, 22), (22, 21), (43, 21)]
CODED = 15
#: Anchors of one exchange row, in bits of the anchor's number: replicas travel as arrays for so many groups of anchors.
GROUPS_PER_TASK = 8
#: Fingerprints at an anchor from which the search is used instead of comparing all.
DENSE = 256
UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """Hashes of the shingles of ``size`` lower-cased words, repeats included; of fewer words, of all of them; none without words."""
    import xxhash

    ws = (text or "").encode("utf-8").translate(UPPER).split()
    if not ws:
        return []
    if len(ws) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(ws), SEED)]
    line = b" ".join(ws)
    ends = list(itertools.accumulate(map(len, ws), lambda at, n: at + n + 1))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash over the shingles of ``size`` lower-cased words, repeats included."""
    hashes = shingle_hashes(text, size)
    if not hashes:
        return 0
    total, counts = len(hashes), np.zeros(64, np.int64)
    values = np.array(hashes, dtype=">u8")
    for at in range(0, total, 1 << 16):
        part = values[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's bits as a signed long."""
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def syndrome(coded: np.ndarray) -> np.ndarray:
    """Zero for words of the (15, 11) code, else the place (from 1) of the bit that leads to the nearest one."""
    out = np.zeros(len(coded), np.uint64)
    for bit in range(CODED):
        out ^= np.where(coded >> np.uint64(bit) & np.uint64(1), np.uint64(bit + 1), np.uint64(0))
    return out


def anchors(values: np.ndarray, bits: int, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, anchors): every anchor within ``1 + reach`` of each value of a block with ``bits`` bits.

    The anchor splits into a code word and free bits. Flipping any ``k`` free bits leaves ``1 + reach - k`` for the code word,
    and all words of the code within ``r`` of a value are found by flipping up to ``r`` coded bits and keeping those with
    syndrome zero."""
    low, free = values & np.uint64((1 << CODED) - 1), values >> np.uint64(CODED)
    near: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for r in range(reach + 2):
        found = []
        for flips in itertools.combinations(range(CODED), r):
            word = low ^ np.uint64(sum(1 << f for f in flips))
            at = np.nonzero(syndrome_table()[word.astype(np.int64)] == 0)[0]
            found.append((at, word[at]))
        near.append(found)
    out = []
    for k in range(reach + 2):
        for flips in itertools.combinations(range(bits - CODED), k):
            high = (free ^ np.uint64(sum(1 << f for f in flips))) << np.uint64(CODED)
            for r in range(reach + 2 - k):
                out += [(at, word | high[at]) for at, word in near[r]]
    return out


_SYNDROMES: list[np.ndarray] = []


def syndrome_table() -> np.ndarray:
    if not _SYNDROMES:
        _SYNDROMES.append(syndrome(np.arange(1 << CODED, dtype=np.uint64)).astype(np.uint8))
    return _SYNDROMES[0]


def links_at(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the groups of fingerprints joined at each anchor; ``keys`` are anchors, sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    size = np.repeat(sizes, sizes)
    for lag in range(1, int(min(sizes.max(initial=0), DENSE))):
        at = np.flatnonzero((size <= DENSE) & (place + lag < size))
        hit = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= threshold]
        left.append(fps[hit])
        right.append(fps[hit + lag])
    for start, n in zip(starts[sizes > DENSE], sizes[sizes > DENSE]):
        rest, edge = fps[start : start + n], []
        while len(rest) or edge:
            if not edge:
                edge, rest = [rest[0]], rest[1:]
            here = edge.pop()
            close = np.bitwise_count(rest ^ here) <= threshold
            if close.any():
                reached = rest[close]
                left.append(np.full(len(reached), here, np.uint64))
                right.append(reached)
                edge += list(reached)
                rest = rest[~close]
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node but the roots: the groups that the links (a, b) join, with one link for each further member."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    member = root != np.arange(len(nodes))
    return nodes[member], nodes[root[member]]


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that span the groups within ``threshold`` bits."""
    reach = threshold // len(BLOCKS)
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_groups = np.uint64(tasks * GROUPS_PER_TASK)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replicas of a batch, as arrays of anchors and fingerprints for each group of anchors."""
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, reps = [], []
            for n, (low, bits) in enumerate(BLOCKS):
                part = fps >> np.uint64(low) & np.uint64((1 << bits) - 1)
                for at, anchor in anchors(part, bits, reach):
                    keys.append(anchor | np.uint64(n << 32))
                    reps.append(fps[at])
            if not len(fps):
                continue
            key, rep = np.concatenate(keys), np.concatenate(reps)
            group = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % n_groups
            order = np.argsort(group, kind="stable")
            key, rep, group = key[order], rep[order], group[order]
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[cuts[:-1]].astype(np.int64)), pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([rep[a:b].tobytes() for a, b in spans], pa.binary())],
                ["grp", "keys", "fps"],
            )

    def compare(group: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint64)
        fps = np.frombuffer(b"".join(group.column("fps").to_pylist()), np.uint64)
        order = np.argsort(key, kind="stable")
        a, b = forest(*links_at(key[order], fps[order], threshold))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    spread_out = distinct.select("fp").mapInArrow(spread, "grp bigint, keys binary, fps binary")
    return spread_out.groupBy("grp").applyInArrow(compare, "a bigint, b bigint").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node in ``pairs`` (a, b): alternating large-star and small-star steps, whose rounds grow with the
    logarithm of a chain's length. Each round is written to the shared folder; only counts reach the driver."""
    edges = stored(pairs.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    mark = None
    while True:
        both = edges.unionAll(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").selectExpr("b AS a", "m AS b").unionAll(least.selectExpr("a", "m AS b"))
        edges = stored(small.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a <> b").distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return edges.selectExpr("a AS node", "b AS root")
        mark = seen


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest id reachable over links."""
    marked = stored(fingerprints(docs, doc_id, text))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct, threshold))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    owners = grouped.join(smallest, "root").select("fp", "component_id")
    return marked.join(owners, "fp", "left").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
