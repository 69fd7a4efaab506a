"""MinHash near-duplicates by bottom-k sketches of one hash function.

A text's set is that of its distinct shingles, a shingle its 64-bit hash. Its sketch keeps the ``K`` smallest hashes. If two sets have a
similarity of ``TENTHS`` tenths, their sketches share at least ``LEAST`` of the K smallest values of the union but for one case in some
10^7 (sets of at most K shingles: always their due part), and so share one of the rarest ``K - LEAST + 1`` values of each. Only these
are put into inverted lists, rarest first by their counts over all distinct sets; a value that no other set holds needs no list. So texts whose
sketches are mostly their own are in no list, whatever passages they share.

Lists become links in two steps, neither of which makes a row for each pair of a list:

1. Each member of a list is compared with the list's first one: the overlap of the sketches within the union's sketch estimates the
   similarity, and the exact sets decide. A family of copies becomes one group at about one comparison a member.
2. Lists whose members are then in several groups are joined into clusters, and their members are cut into blocks of a bounded number of shingles,
   large groups into blocks of their own. Every two blocks meet in one task, unless they are of one group; within
   it each text is compared with all of other groups by sketch, those near enough by set, and only links that join two groups are given out.

Sets are known by a 128-bit digest; equal sets are one node. Components come from star contraction.

Defined results: a null text or one without words has the empty set and is linked with nothing; fewer words than a shingle are one shingle. Rows
with a null id get their component's smallest id, null if it has none. Repeated rows stay. An empty table gives no rows. Results
keep only the id and the columns named here, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from codecorpus.llm.common import stored, table
from codecorpus.llm.simhash import components, shingle_hashes

SHINGLE = 4
#: Least similarity, in tenths.
TENTHS = 8
#: Values of a sketch, and how many of the union's sketch two similar sets share at least.
K, LEAST = 64, 33
#: Shingles of a block, and the group of blocks that hold small groups (groups have numbers from zero on).
BLOCK = 200_000
POOL = -1


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64).view(np.int64))


def digest(values: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(values.tobytes())


def marks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, h, d, n, sketch) of each row: hash of its text, digest and size of its set, smallest values."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([digest(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[:K] for x in sets], pa.list_(pa.int64()))],
                ["doc_id", "h", "d", "n", "sketch"],
            )

    return rows.mapInArrow(run, rows.select("doc_id", "h").schema.add("d", "binary").add("n", "long").add("sketch", ArrayType(LongType())))


def due(n):
    """How many values sketches share at least, by the size of one of the sets."""
    return F.least(F.ceil(n * TENTHS / 10), F.lit(LEAST))


def lists(nodes: DataFrame) -> DataFrame:
    """(v, node, n): members of the inverted lists of the rarest values of each sketch that some other sketch holds."""
    held = nodes.select("node", "n", F.explode("sketch").alias("v"))
    counts = held.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    shared = held.join(counts, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("by_count"))
    # Values of its own come first; what is left of the places goes to the rarest others.
    kept = F.least("n", F.lit(K))
    places = (kept - due(kept) + 1 - (kept - F.size("by_count"))).cast("int")
    return shared.where(places > 0).select("node", "n", F.explode(F.slice("by_count", F.lit(1), places)).alias("x")).select(F.col("x.v").alias("v"), "node", "n")


def sizes_fit(a: str, b: str):
    return F.least(a, b) * 10 >= F.greatest(a, b) * TENTHS


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches share enough of the union's sketch."""
    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    other = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return pairs.join(one, "a").join(other, "b").where(shared >= due(F.least("na", "nb"))).select("a", "b")


def exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("xa", "xb")).alias("same"), (F.size("xa") + F.size("xb")).alias("sizes"))
    return counted.where(F.col("same") * 10 >= (F.col("sizes") - F.col("same")) * TENTHS).select("a", "b")


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, text: str, size: int) -> DataFrame:
    """(node, x): the sets of the wanted nodes, each from one of its texts. Only those texts are read again."""
    chosen = stored(nodes.join(wanted, "node", "left_semi").select("node", "d", "h"))
    found = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text")).join(chosen.select("h").distinct(), "h", "left_semi").select("h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task are read once
        for batch in batches:
            new = []
            for k, h in enumerate(batch.column(0).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    new.append(k)
            sets = [shingles(batch.column(1)[k].as_py(), size) for k in new]
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["d", "x"])

    return found.mapInArrow(run, "d binary, x array<bigint>").dropDuplicates(["d"]).join(chosen.select("node", "d"), "d").select("node", "x")


def links_between(nodes: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between similar sets that join two groups. ``sides`` 0 and 1 are compared with each other, 2 with all."""
    n = np.array([len(x) for x in sets])
    order = np.argsort(n, kind="stable")
    nodes, sides, sets, n = nodes[order], sides[order], [sets[i] for i in order], n[order]
    root = np.unique(labels[order], return_inverse=True)[1]
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    starts = ends - n
    kept = np.minimum(n, K)
    # Sketches one after another, with the place of each value in its sketch.
    place = np.concatenate([np.arange(k) for k in kept])
    at = np.repeat(starts, kept) + place
    sketch, sketch_starts = codes[at], np.cumsum(kept) - kept
    need = np.minimum(-(-kept * TENTHS // 10), LEAST)
    rank, mark = np.zeros(len(values), np.int32), np.zeros(len(values), bool)
    found = []
    for i in range(len(n) - 1):
        upto = int(np.searchsorted(n * TENTHS, n[i] * 10, "right"))  # sizes ascend: beyond it all are too large
        if upto <= i + 1 or not (root[i + 1 : upto] != root[i]).any():
            continue
        lo, hi = sketch_starts[i + 1], (sketch_starts[upto] if upto < len(n) else len(sketch))
        own = codes[starts[i] : starts[i] + kept[i]]
        rank[own] = np.arange(1, kept[i] + 1)
        ranks = rank[sketch[lo:hi]]
        rank[own] = 0
        same = ranks > 0
        begins = sketch_starts[i + 1 : upto] - lo
        before = np.cumsum(same)
        base = np.repeat(before[begins] - same[begins], kept[i + 1 : upto])
        within = same & (ranks + place[lo:hi] + 1 - (before - base) <= K)
        shared = np.add.reduceat(within.astype(np.int64), begins)
        side = sides[i + 1 : upto]
        apart = (side == 2) | (sides[i] == 2) | (side != sides[i])
        near = i + 1 + np.flatnonzero((shared >= np.minimum(need[i], need[i + 1 : upto])) & (root[i + 1 : upto] != root[i]) & apart)
        if not len(near):
            continue
        full = codes[starts[i] : ends[i]]
        mark[full] = True
        hits = mark[np.concatenate([codes[starts[j] : ends[j]] for j in near])]
        mark[full] = False
        inter = np.add.reduceat(hits.astype(np.int64), np.cumsum(n[near]) - n[near])
        for j in near[inter * 10 >= (n[i] + n[near] - inter) * TENTHS]:
            if root[j] != root[i]:
                found.append((int(nodes[i]), int(nodes[j])))
                root[root == root[j]] = root[i]
    return found


def links_across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members (node, n, label, v) of lists that hold several groups."""
    first = members.groupBy("v").agg(F.min("node").alias("a"))
    joined = components(members.join(first, "v").select("a", F.col("node").alias("b")))
    each = members.select("node", "n", "label").distinct().join(joined.select("node", F.col("root").alias("r")), "node", "left")
    each = stored(each.select("node", "n", "label", F.coalesce("r", "node").alias("cluster")))
    groups = each.groupBy("cluster", "label").agg(F.sum("n").alias("w")).withColumn("own", F.col("w") >= BLOCK)
    pools = groups.where("NOT own").groupBy("cluster").agg(F.sum("w").alias("pool"))
    plan = groups.join(pools, "cluster", "left").select(
        "cluster", "label", F.when(F.col("own"), F.col("label")).otherwise(POOL).alias("of"), F.ceil(F.when(F.col("own"), F.col("w")).otherwise(F.col("pool")) / BLOCK).alias("blocks"),
    )
    key = F.when(F.col("of") == POOL, F.xxhash64("label")).otherwise(F.xxhash64("node"))
    placed = each.join(plan, ["cluster", "label"]).select("node", "label", "cluster", F.struct("of", F.pmod(key, F.col("blocks")).alias("k")).alias("block"))
    placed = stored(placed)
    blocks = placed.select("cluster", "block").distinct()
    left, right = blocks.withColumnRenamed("block", "one"), blocks.withColumnRenamed("block", "two")
    # Blocks of one group need no comparison; a block of several groups meets itself too.
    meet = left.join(right, "cluster").where((F.col("one") <= F.col("two")) & ((F.col("one.of") != F.col("two.of")) | (F.col("one.of") == POOL)))
    sent = meet.select("cluster", "one", "two", F.explode(F.when(F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("block"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("one").alias("block"), F.lit(0).alias("side")), F.struct(F.col("two").alias("block"), F.lit(1).alias("side"))))).alias("x"))
    sent = sent.select("cluster", F.xxhash64("cluster", "one", "two").alias("tile"), F.col("x.block").alias("block"), F.col("x.side").alias("side"))

    def compare(group: pa.Table) -> pa.Table:
        flat = group.combine_chunks()
        sets = [np.array(x, np.int64) for x in flat.column("x").to_pylist()]
        # A tile's number is a hash: two tiles that share one are only compared more than needed.
        found = links_between(*(flat.column(c).to_numpy() for c in ("node", "label", "side")), sets)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    tiles = placed.join(sent, ["cluster", "block"]).select("tile", "node", "label", "side").join(sets, "node")
    return tiles.groupBy("tile").applyInArrow(compare, "a bigint, b bigint")


def lists_of(also: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, node, n): members of the lists that ``also`` names by the hashes of their texts, of those with several sets."""
    found = also.join(marked.select("h", "d").distinct(), "h").join(nodes.select("d", "node", "n"), "d").select("v", "node", "n").distinct()
    return found.join(found.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v"), "v").select("v", "node", "n")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, d, n) of each row, and (d, root, first_id) of each distinct set that is not empty: sets with the same root are joined by a
    chain of links; ``first_id`` is the smallest id of the set's rows. Texts (hash ``h``) that share a ``v`` in ``also`` are a list too."""
    marked = stored(marks(docs, doc_id, text, size))
    nodes = marked.where("n > 0").groupBy("d", "n").agg(F.min("doc_id").alias("first_id"), F.min("h").alias("h"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = stored(lists(nodes) if also is None else lists(nodes).unionAll(lists_of(also, marked, nodes)))
    first = members.groupBy("v").agg(F.min(F.struct("node", "n")).alias("x"))
    stars = members.join(first, "v").where(F.col("node") != F.col("x.node")).where(sizes_fit("n", "x.n")).select(F.col("x.node").alias("a"), F.col("node").alias("b")).distinct()
    sets = stored(sets_of(docs, nodes, members.select("node").distinct(), text, size))
    near = stored(exact(estimated(stars, nodes), sets))
    labelled = members.join(components(near).withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("v", "node", "n", F.coalesce("root", "node").alias("label"))
    labelled = stored(labelled)
    mixed = labelled.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("v")
    across = links_across(stored(labelled.join(mixed, "v", "left_semi")), sets)
    roots = components(near.unionByName(stored(across)))
    return marked.select("doc_id", "h", "d", "n"), stored(nodes.join(roots, "node", "left").select("d", F.coalesce("root", "node").alias("root"), "first_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest id reachable over links."""
    marked, sets = grouped(docs, doc_id, text, size)
    least = sets.groupBy("root").agg(F.min("first_id").alias("component_id"))
    owners = sets.join(least, "root").select("d", "component_id")
    found = marked.join(owners, "d", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
