"""Vector code compression: product quantisation whose Lloyd rounds leave every part where it lives.

A vector becomes whole numbers, floor(scale * x), and is cut into equal parts. The members of a codebook entry live with that entry's
owners: parts are dealt over partitions by (position, entry, salt) and stay there. In a round each owner adds up its resident
members; sums and counts, one row for each entry, make the next codebook, which is the only thing sent to all owners. An owner then finds the
nearest entry of each resident, keeps those that stay and sends only those that change entry to their new owners. The residents'
side of a round has the same partitioner before and after, so it is no shuffle: what migrates is what moved.

The salt is a hash of the row, and there are so many salts that an owner holds about ``MEMBERS`` parts even if all rows are in one
entry, so a vector repeated in a third of the rows does no harm. Sums are added up in the partitions first. The rows of a round depend
on those of the last one and on the parts that migrated; every ``CUT`` rounds they are checkpointed in the shared folder, so a
lost executor's part is computed again from there.

Defined results: a vector that is null or holds a null, NaN or infinite component is left out. The codebooks start from the
smallest ids there are, of rows that share one the least vector counts; fewer rows make fewer entries; rows without an id are coded but
start nothing, unless no row has an id, when the least vectors start. Vectors have the length of the first starting one, others are left out; if it is no
multiple of ``positions``, the last parts are filled up with zeros, and a vector of no components has parts of none. Whole numbers
beyond 2^27 in size are cut to that. Repeated rows stay, each with its code; an empty table gives no rows. Only the columns named
here are kept, so others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.common import stored, table
from codecorpus.sources.workdir import shared_root

POSITIONS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 27
#: Parts that an owner holds about, and rounds after which the rows are checkpointed.
MEMBERS = 20_000
CUT = 8
#: Parts compared with a codebook at once.
STRIP = 8192


def whole(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * scale))).cast("int"))


def numbered(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(rid, vec_id, label, v) of the rows that count; written, so that a row keeps its number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & ~bad)
    return stored(kept.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole(F.col(vector), scale).alias("v")))


def first_vectors(rows: DataFrame, entries: int) -> list[list[int]]:
    """The vectors that start the codebooks, at most ``entries``."""
    ids = [r.vec_id for r in rows.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return [list(r.v) for r in rows.select("v").distinct().orderBy("v").limit(entries).collect()]
    return [list(r.v) for r in rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()]


def cut(vectors: np.ndarray, positions: int) -> np.ndarray:
    """Vectors (n, length) as parts (n, positions, width), zeros filled up."""
    width = -(-vectors.shape[1] // positions)
    out = np.zeros((len(vectors), positions * width), np.int64)
    out[:, : vectors.shape[1]] = vectors
    return out.reshape(len(vectors), positions, width)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part (n, width) in a book (entries, width); ties go to the lower index."""
    entry, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), STRIP):
        gap = parts[at : at + STRIP, None, :] - book[None]
        d = np.einsum("nek,nek->ne", gap, gap)
        entry[at : at + STRIP] = d.argmin(axis=1)
        far[at : at + STRIP] = d.min(axis=1)
    return entry, far


def owner(cell: int) -> int:
    """Partition of a cell, before the modulus."""
    return cell


class Layout:
    """Numbers of the cells (position, entry, salt), and the residents' records: (cell, (row numbers, parts))."""

    def __init__(self, positions: int, entries: int, salts: int, width: int):
        self.positions, self.entries, self.salts, self.width = positions, entries, salts, width

    def cell(self, position, entry, rids: np.ndarray) -> np.ndarray:
        salt = (rids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.salts
        return (position * self.salts + salt) * self.entries + entry

    def position(self, cell: int) -> int:
        return cell // (self.entries * self.salts)

    def records(self, cells: np.ndarray, rids: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, tuple[bytes, bytes]]]:
        order = np.argsort(cells, kind="stable")
        cells, rids, parts = cells[order], rids[order], parts[order]
        cuts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True]) if len(cells) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(cells[a]), (rids[a:b].tobytes(), parts[a:b].astype(np.int32).tobytes())

    def members(self, record: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
        rids = np.frombuffer(record[0], np.int64)
        return rids, np.frombuffer(record[1], np.int32).astype(np.int64).reshape(len(rids), self.width)


def settled(rows: DataFrame, books: np.ndarray, length: int, layout: Layout) -> RDD:
    """Records of all parts at the owners of their nearest entries, before the first round."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = cut(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rids), length), layout.positions)
            out = []
            for p in range(layout.positions):
                entry, _ = nearest(parts[:, p], books[p])
                out += layout.records(layout.cell(p, entry, rids), rids, parts[:, p])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1][0] for x in out], pa.binary()), pa.array([x[1][1] for x in out], pa.binary())], ["cell", "rids", "parts"])

    sent = rows.where(F.size("v") == length).select("rid", "v").mapInArrow(spread, "cell bigint, rids binary, parts binary")
    return sent.rdd.map(lambda r: (r[0], (bytes(r[1]), bytes(r[2]))))


def gathered(records: Iterator[tuple[int, tuple[bytes, bytes]]]) -> Iterator[tuple[int, tuple[bytes, bytes]]]:
    """One record for each cell of a partition."""
    cells: dict[int, list[tuple[bytes, bytes]]] = {}
    for cell, record in records:
        cells.setdefault(cell, []).append(record)
    for cell, all_of in cells.items():
        yield cell, (b"".join(r[0] for r in all_of), b"".join(r[1] for r in all_of))


def renewed(state: RDD, books: np.ndarray, layout: Layout) -> np.ndarray:
    """The next codebooks: the mean of each entry's members, rounded down; entries without any stay."""

    def sums(records):
        for cell, record in records:
            rids, parts = layout.members(record)
            if len(rids):
                yield (layout.position(cell), cell % layout.entries), np.r_[len(rids), parts.sum(axis=0)]

    out = books.copy()
    for (p, e), total in state.mapPartitions(sums).reduceByKey(lambda a, b: a + b).collect():  # at most positions x entries rows
        out[p, e] = total[1:] // total[0]
    return out


def migrated(state: RDD, books: np.ndarray, layout: Layout) -> RDD:
    """The records after every part has gone to its nearest entry: residents stay, the others are dealt to their new owners."""

    def split(record: tuple[int, tuple[bytes, bytes]]):
        cell, members = record
        rids, parts = layout.members(members)
        p = layout.position(cell)
        entry, _ = nearest(parts, books[p])
        return p, rids, parts, entry, entry == cell % layout.entries

    def staying(records):
        for record in records:
            p, rids, parts, entry, stays = split(record)
            if stays.any():
                yield record[0], (rids[stays].tobytes(), parts[stays].astype(np.int32).tobytes())

    def leaving(records):
        for record in records:
            p, rids, parts, entry, stays = split(record)
            goes = ~stays
            if goes.any():
                yield from layout.records(layout.cell(p, entry[goes], rids[goes]), rids[goes], parts[goes])

    arriving = state.mapPartitions(leaving).partitionBy(state.partitioner.numPartitions, owner)
    return state.mapPartitions(staying, preservesPartitioning=True).union(arriving).mapPartitions(gathered, preservesPartitioning=True)


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[list[int]]]]:
    """(rid, vec_id, label, codes array<int>, error) of each row that counts, and the codebooks by position and entry."""
    spark = vectors.sparkSession
    rows = numbered(vectors, vec_id, vector, label, scale)
    start = first_vectors(rows, entries)
    nothing = spark.createDataFrame([], "rid bigint, codes array<int>, error bigint")
    if not start:
        return rows.select("rid", "vec_id", "label").join(nothing, "rid"), []
    length = len(start[0])
    start = [v for v in start if len(v) == length]
    books = cut(np.array(start, np.int64).reshape(len(start), length), positions).transpose(1, 0, 2).copy()
    salts = -(-rows.count() // MEMBERS)
    layout = Layout(positions, books.shape[1], salts, books.shape[2])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), positions * salts)
    first = settled(rows, books, length, layout).partitionBy(tasks, owner)
    state = first.mapPartitions(gathered, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [state]
    for n in range(1, rounds + 1):
        books = renewed(state, books, layout)
        if n == rounds:
            break
        state = migrated(state, books, layout).persist(StorageLevel.MEMORY_AND_DISK)
        if n % CUT == 0:
            spark.sparkContext.setCheckpointDir(shared_root(spark))
            state.checkpoint()
        kept.append(state)

    def coded(records):
        for cell, record in records:
            rids, parts = layout.members(record)
            entry, far = nearest(parts, books[layout.position(cell)])
            yield layout.position(cell), bytearray(record[0]), bytearray(entry.tobytes()), bytearray(far.tobytes())

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, *columns in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rids, entry, far = (np.frombuffer(c, np.int64) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(np.full(len(rids), p, np.int64)), pa.array(entry), pa.array(far)], ["rid", "p", "entry", "far"])

    packed = spark.createDataFrame(state.mapPartitions(coded), "p bigint, rids binary, entry binary, far binary", verifySchema=False)
    parts = stored(packed.mapInArrow(unpacked, "rid bigint, p bigint, entry bigint, far bigint"))
    for old in kept:
        old.unpersist()
    codes = F.array(*[F.max(F.when(F.col("p") == p, F.col("entry"))).cast("int") for p in range(positions)])
    coded_rows = parts.groupBy("rid").agg(codes.alias("codes"), F.sum("far").alias("error"))
    return rows.select("rid", "vec_id", "label").join(coded_rows, "rid"), books.tolist()


def books_text(books: list[list[list[int]]]) -> str:
    return ",".join(str(x) for book in books for entry in book for x in entry)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with ``label_error``: the error of all rows with an equal label, null labels together."""
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    return coded.join(errors, F.col("label").eqNullSafe(F.col("l"))).drop("l")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return with_label_errors(stored(coded)).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds written out one after another."""
    rounds = ""
    for r in range(ROUNDS + 1):
        rounds += f""",
a{r} AS (SELECT rid, p, min(d * {ENTRIES} + e) AS m FROM (
    SELECT c.rid, c.p, b.e, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM comp c JOIN b{r} b ON b.p = c.p AND b.j = c.j GROUP BY c.rid, c.p, b.e
  ) GROUP BY rid, p)"""
        if r < ROUNDS:
            rounds += f""",
b{r + 1} AS (SELECT b.p, b.e, b.j, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT c.p, a.m % {ENTRIES} AS e, c.j, CAST(floor(CAST(sum(c.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM comp c JOIN a{r} a ON a.rid = c.rid AND a.p = c.p GROUP BY c.p, a.m % {ENTRIES}, c.j
  ) n ON n.p = b.p AND n.e = b.e AND n.j = b.j)"""
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding AS v, len(embedding) // {POSITIONS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
comp AS (
  SELECT rid, (i - 1) // w AS p, (i - 1) % w AS j, CAST(floor({SCALE} * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT rid, v, w, unnest(range(1, len(v) + 1)) AS i FROM kept)
),
b0 AS (SELECT p, rid - 1 AS e, j, x FROM comp WHERE rid <= {ENTRIES}){rounds},
coded AS (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(hex(a.m % {ENTRIES})), 2, '0'), '' ORDER BY a.p) AS code, CAST(sum(a.m // {ENTRIES}) AS BIGINT) AS error
  FROM a{ROUNDS} a JOIN kept k ON k.rid = a.rid GROUP BY k.rid, k.vec_id, k.label
),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM books) AS codebooks_sha256 FROM coded
"""


ORACLE = _oracle()
