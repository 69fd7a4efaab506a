"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation's rows and the states of its pattern ``(s?(ua)+)?`` span a lattice: node (row, state), arcs for the edits Delete, Insert, Keep
and Rerole at integer costs. Every node has a price, never above the cost of any arc plus the price at its end. The
auction works on one path: if the price at its end is below the best of the arcs there, it rises to it and the path is contracted;
otherwise the path is extended along the best arc. Origins are taken from the last row to the first, and a path ends where it meets a node whose price has
converged, so each row costs a bounded number of steps. The converged prices are the costs still to come; an arc is tight if price and
price differ by its cost, all cheapest repairs run along tight arcs only, and the trace takes the tight arc of the least letter.

Rows are sorted into ranges by (conversation, turn, role, text), so a long conversation spreads over tasks. A conversation that
lies within a task in one chunk is repaired there. Others are known to the next steps by one byte a row: each task's run of the
conversation is priced once for each exit state, which gives a 4 x 4 table of costs; one task for each conversation folds the tables, one
for each run, into the prices at every run's end, and from the exits that traces from every entry reach, the state at every run's start; then
runs are traced apart. What was seen earlier is told to a run by digests, grouped over all runs. Texts are only
read in order again for the digest of the repaired conversation, which is sequential by nature: they stream through.

Defined results: a null role or text is one space, so the row is blank, or needs another role. Rows of one turn go by role, then by
the MD5 of the text; null turns come first. A null ``conv_id`` is a conversation like any other. Rows of roles other than ``s...``, ``u...`` and ``a...`` can be deleted
or get another role. Repeated rows are duplicates; an empty table gives no rows. Only the columns named are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codecorpus.llm.common import stored, table

BLANKS = " \t\n\x0b\x0c\r"
#: States of the pattern: nothing yet, after s, after u, after a. The role that may come next, by insertion or a new role.
START, S, U, A = range(4)
NEXT = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
#: Costs: delete, insert, new role, and what a truncated row that stays adds.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
NEVER = 1 << 40
#: Rows and bytes of text of a chunk; rows of a conversation whose repair is remembered, and how many repairs are.
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20
KNOWN_ROWS, KNOWN = 64, 100_000

#: A row's code: 0 must go; else 1 + 2 * (place of its initial in this list) + 1 if truncated.
INITIALS = ["s", "u", "a", None]
KEPT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}


def _arcs(code: int, state: int) -> list[tuple[str, int, bool, int]]:
    """(letter, cost, whether the row is consumed, next state) of a node, letters in order."""
    out = [("D", DELETE, True, state), ("I", INSERT, False, NEXT[state])]
    if code:
        initial, extra = INITIALS[(code - 1) // 2], CUT_OFF * ((code - 1) % 2)
        if initial in KEPT[state]:
            out.append(("K", extra, True, KEPT[state][initial]))
        out.append(("R", REROLE + extra, True, NEXT[state]))
    return out


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(9)]
#: After the last row: stop where the pattern may end, else insert.
LAST = [[("", 0, True, state)] * (state in (START, A)) + [("I", INSERT, False, NEXT[state])] for state in range(4)]


def settle(arcs: list[list[tuple[str, int, bool, int]]], after: tuple[int, ...], closed: tuple[bool, ...] = (False,) * 4) -> tuple[int, ...]:
    """Prices of the four nodes before a row, given those after it, by path extension and contraction. ``closed`` nodes reach no end.
    All start at the least price after the row, which no arc undercuts, so that they rise by a few steps however far the end is."""
    price = [NEVER if c else min(after) for c in closed]
    done = list(closed)
    for origin in range(4):
        path = [origin]
        while not done[path[-1]]:
            at = path[-1]
            best, stays, state = min((cost + (after[to] if over else price[to]), not over, to) for _, cost, over, to in arcs[at])
            best = min(best, NEVER)
            if price[at] < best:
                price[at] = best
                if len(path) > 1:
                    path.pop()
            elif stays:
                path.append(state)
            else:
                break  # the path leaves the row for a node whose price has converged
        for node in path:
            done[node] = True
    return tuple(price)


def prices(codes: bytes, after: tuple[int, ...], closed: tuple[bool, ...] = (False,) * 4) -> array:
    """Prices of all nodes of a run, four for each row and four after the last, given those of the last."""
    out = array("q", bytes(32 * (len(codes) + 1)))
    out[4 * len(codes) :] = array("q", after)
    for i in range(len(codes) - 1, -1, -1):
        after = settle(ARCS[codes[i]], after, closed)
        out[4 * i : 4 * i + 4] = array("q", after)
    return out


#: Prices after the last row of a conversation.
ENDS = settle(LAST, (0, 0, 0, 0))


def trace(codes: bytes, price: array, state: int, last: bool) -> tuple[list[str], int]:
    """(letters of each row, inserted ones before it, and of the end if ``last``; the state reached) along tight arcs, least letter first."""
    out, here = [], ""
    for i, code in enumerate(codes):
        over = False
        while not over:
            now = price[4 * i + state]
            letter, _, over, to = next(a for a in ARCS[code][state] if now == a[1] + price[4 * (i + a[2]) + a[3]])
            here, state = here + letter, to
        out.append(here)
        here = ""
    if last:
        over = False
        while not over:
            now = price[4 * len(codes) + state]
            letter, _, over, to = next(a for a in LAST[state] if now == a[1] + (0 if a[2] else price[4 * len(codes) + a[3]]))
            here, state = here + letter, to
        out.append(here)
    return out, state


@lru_cache(KNOWN)
def known(codes: bytes) -> tuple[int, str]:
    return solve(codes)


def solve(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    price = prices(codes, ENDS)
    return price[START], "".join(trace(codes, price, START, True)[0])


def table_of_costs(codes: bytes) -> list[int]:
    """Cheapest way from each entry state (row) of a run to each exit state (column); 16 numbers."""
    columns = []
    for to in range(4):
        # Nothing leads back to the start, and only the start leads to s.
        closed = tuple(state > to for state in range(4)) if to in (START, S) else (False,) * 4
        price = prices(codes, tuple(0 if state == to else NEVER for state in range(4)), closed)
        columns.append(price[:4])
    return [columns[to][state] for state in range(4) for to in range(4)]


def fault(role: str, text: str, seen: bool) -> tuple[str | None, int]:
    """(fault, code) of a row."""
    stripped = text.strip(BLANKS)
    if not stripped:
        return "blank", 0
    if seen:
        return "duplicate", 0
    kind = INITIALS.index(role[:1]) if role[:1] in INITIALS else 3
    short = stripped[-1] not in ".!?"
    return "truncated" if short else None, 1 + 2 * kind + short


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def rewritten(letters: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    out, at = [], 0
    for letter in letters:
        if letter == "D":
            at += 1
        elif letter == "I":
            state = NEXT[state]
            out.append((ROLE[state], ""))
        elif letter == "K":
            state = KEPT[state][roles[at][:1]]
            out.append((roles[at], texts[at]))
            at += 1
        else:
            state = NEXT[state]
            out.append((ROLE[state], texts[at]))
            at += 1
    return [r for r, _ in out], [t for _, t in out]


CHUNKS = "part long, seq long, whole boolean, codes binary, digests binary, roles array<string>, texts array<string>, turns array<long>, firsts array<string>, illegal long"
TOTALS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _schema(df: DataFrame, rest: str) -> StructType:
    """The conversation's id as it is in ``df``, and more columns."""
    return StructType([df.schema["conv"], *StructType.fromDDL(rest).fields])


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(kinds))], schema=kinds)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def chunks(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Conversations in order, one row for each chunk. ``whole``: the chunk is certainly all of the conversation. ``codes`` know
    duplicates within the chunk; ``turns``: least, greatest and number of distinct ones; ``firsts``: initials of its first and last row."""
    import xxhash

    named = rows.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")
    ).withColumn("m", F.md5("text")).withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("m"), F.col("salt")]
    schema = _schema(named, CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first = TaskContext.get().partitionId(), 0, True
        held: list[tuple[str, str, int | None]] = []
        conv, size = None, 0

        def close(whole: bool) -> tuple:
            codes, seen, digests = bytearray(), set(), []
            for r, t, _ in held:
                digest = xxhash.xxh3_128_digest(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"))
                codes.append(fault(r, t, digest in seen)[1])
                seen.add(digest)
                digests.append(digest)
            turns = [n for *_, n in held if n is not None]
            starts = [r[:1] for r, *_ in held]
            return (
                conv, part, seq, whole, bytes(codes), b"".join(digests), [r for r, *_ in held], [t for _, t, _ in held],
                [turns[0], turns[-1], len(set(turns))] if turns else [], [starts[0], starts[-1]], sum(not legal(a, b) for a, b in zip(starts, starts[1:])),
            )

        out = []
        for batch in batches:
            for key, n, r, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                full = len(held) >= CHUNK_ROWS or size >= CHUNK_BYTES
                if held and (key != conv or full):
                    # The first conversation of a task may have begun in the one before.
                    out.append(close(key != conv and seq == 0 and not first))
                    seq, first, held, size = (seq + 1, first, [], 0) if key == conv else (0, False, [], 0)
                conv = key
                held.append((r, t, n))
                size += len(t)
            if len(out) >= 256:
                yield _batch(out, schema)
                out = []
        if held:
            out.append(close(False))
        if out:
            yield _batch(out, schema)

    spread = named.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(spread.select("conv", "turn", "role", "text").mapInArrow(run, schema))


RESULT = f"part bigint, seq bigint, audit string, roles array<string>, texts array<string>, {TOTALS}"


def _counts(codes: bytes, roles: list[str], texts: list[str]) -> tuple[int, int, int]:
    blank = sum(not t.strip(BLANKS) for t in texts)
    return blank, codes.count(0) - blank, sum(c > 0 and (c - 1) % 2 for c in codes)


def in_one(chunked: DataFrame) -> DataFrame:
    """Repairs of the conversations that are one chunk."""
    schema = _schema(chunked, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, seq, codes, roles, texts, turns, illegal in _rows(batch):
                cost, audit = known(codes) if len(codes) <= KNOWN_ROWS else solve(codes)
                gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
                out.append((conv, part, seq, audit, *rewritten(audit, START, roles, texts), gaps, *_counts(codes, roles, texts), illegal, cost))
            yield _batch(out, schema)

    return chunked.where("whole").select("conv", "part", "seq", "codes", "roles", "texts", "turns", "illegal").mapInArrow(run, schema)


def in_runs(chunked: DataFrame) -> DataFrame:
    """Repairs of the conversations that lie in several chunks or tasks."""
    parts = stored(chunked.where("NOT whole").withColumn("at", F.struct("part", "seq")))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a"))

    # What an earlier chunk has seen.
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, seq, joined in _rows(batch):
                own = list({joined[k : k + 16] for k in range(0, len(joined), 16)})
                yield _batch([(conv, part, seq, d) for d in own], digest_schema)

    digest_schema = _schema(parts, "part bigint, seq bigint, digest binary")
    held = stored(parts.select("conv", "part", "seq", "digests").mapInArrow(digests, digest_schema)).select("conv", F.struct("part", "seq").alias("at"), "digest")
    first = held.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").selectExpr("conv AS c", "digest AS d", "first")
    again = held.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where(F.col("first") < F.col("at"))
    again = again.groupBy("conv", "at").agg(F.collect_list("digest").alias("again")).selectExpr("conv AS c", "at AS a", "again")

    # The codes of a run, and its table of costs.
    def priced(group: pa.Table) -> pa.Table:
        rows = sorted(_rows(group.combine_chunks().to_batches()[0]), key=lambda r: r[2])
        codes, blank = [], 0
        for *_, own, joined, seen, empty in rows:
            gone = set(seen or [])
            codes.append(bytes(0 if joined[16 * k : 16 * k + 16] in gone else c for k, c in enumerate(own)))
            blank += empty
        turns = [r[3] for r in rows if r[3]]
        edges = [(a[4][1], b[4][0]) for a, b in zip(rows, rows[1:])]
        all_codes = b"".join(codes)
        distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
        return pa.Table.from_batches([_batch([(
            rows[0][0], rows[0][1], all_codes, [len(c) for c in codes], table_of_costs(all_codes), [turns[0][0], turns[-1][1], distinct] if turns else [], [rows[0][4][0], rows[-1][4][1]],
            sum(r[5] for r in rows) + sum(not legal(a, b) for a, b in edges), blank, all_codes.count(0) - blank, sum(c > 0 and (c - 1) % 2 for c in all_codes),
        )], run_schema)])

    run_schema = _schema(parts, "part bigint, codes binary, lens array<bigint>, costs array<bigint>, turns array<bigint>, firsts array<string>, illegal bigint, blank bigint, duplicate bigint, truncated bigint")
    blanks = F.size(F.filter("texts", lambda t: F.length(F.translate(t, BLANKS, "")) == 0)).cast("bigint").alias("blanks")
    facts = parts.select("conv", "at", "part", "seq", "turns", "firsts", "illegal", "codes", "digests", blanks).join(again, same, "left")
    runs = stored(facts.select("conv", "part", "seq", "turns", "firsts", "illegal", "codes", "digests", "again", "blanks").groupBy("conv", "part").applyInArrow(priced, run_schema))

    # One task for each conversation: prices at the end of each run, and the totals with its first run.
    def folded(group: pa.Table) -> pa.Table:
        rows = sorted(_rows(group.combine_chunks().to_batches()[0]), key=lambda r: r[1])
        after, out = ENDS, []
        for r in reversed(rows):
            out.append((r[0], r[1], list(after)))
            after = tuple(min(r[2][4 * s + t] + after[t] for t in range(4)) for s in range(4))
        turns = [r[3] for r in rows if r[3]]
        distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
        gaps = turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0
        illegal = sum(r[5] for r in rows) + sum(not legal(a[4][1], b[4][0]) for a, b in zip(rows, rows[1:]))
        totals = (gaps, *(sum(r[k] for r in rows) for k in (6, 7, 8)), illegal, after[START])
        out.reverse()
        return pa.Table.from_batches([_batch([(*r, k == len(out) - 1, *(totals if k == 0 else (None,) * 6)) for k, r in enumerate(out)], fold_schema)])

    fold_schema = _schema(parts, f"part bigint, ends array<bigint>, last boolean, {TOTALS}")
    ends = stored(runs.select("conv", "part", "costs", "turns", "firsts", "illegal", "blank", "duplicate", "truncated").groupBy("conv").applyInArrow(folded, fold_schema))
    here = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    with_ends = runs.select("conv", "part", "codes", "lens").join(ends.withColumnsRenamed({"conv": "c", "part": "p"}), here).drop("c", "p")

    # The exit each entry leads to; then, one task for each conversation, the entry of each run.
    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, codes, after in _rows(batch):
                price = prices(codes, tuple(after))
                out.append((conv, part, [trace(codes, price, s, False)[1] for s in range(4)]))
            yield _batch(out, exit_schema)

    exit_schema = _schema(parts, "part bigint, exits array<bigint>")

    def entries(group: pa.Table) -> pa.Table:
        state, out = START, []
        for conv, part, to in sorted(_rows(group.combine_chunks().to_batches()[0]), key=lambda r: r[1]):
            out.append((conv, part, state))
            state = to[state]
        return pa.Table.from_batches([_batch(out, entry_schema)])

    entry_schema = _schema(parts, "part bigint, entry bigint")
    entered = with_ends.select("conv", "part", "codes", "ends").mapInArrow(exits, exit_schema).groupBy("conv").applyInArrow(entries, entry_schema)
    ready = with_ends.join(stored(entered).withColumnsRenamed({"conv": "c", "part": "p"}), here).drop("c", "p")

    # The letters and the state at the start of each chunk.
    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, codes, lens, after, last, entry, *totals in _rows(batch):
                letters, _ = trace(codes, prices(codes, tuple(after)), entry, last)
                at, state, out = 0, entry, []
                for seq, n in enumerate(lens):
                    own = "".join(letters[at : at + n] + (letters[at + n :] if seq == len(lens) - 1 else []))
                    out.append((conv, part, seq, own, state, *(totals if seq == 0 else (None,) * 6)))
                    for k in range(at, at + n):
                        for letter in letters[k]:
                            state = next(a[3] for a in ARCS[codes[k]][state] if a[0] == letter)
                    at += n
                yield _batch(out, trace_schema)

    trace_schema = _schema(parts, f"part bigint, seq bigint, audit string, entry bigint, {TOTALS}")
    found = ready.select("conv", "part", "codes", "lens", "ends", "last", "entry", *[f.name for f in StructType.fromDDL(TOTALS)]).mapInArrow(traced, trace_schema)
    found = stored(found).withColumn("a", F.struct("part", "seq")).withColumnRenamed("conv", "c").drop("part", "seq")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(conv, part, seq, audit, *rewritten(audit, entry, roles, texts), *totals) for conv, part, seq, audit, entry, roles, texts, *totals in _rows(batch)], result_schema)

    result_schema = _schema(parts, RESULT)
    both = parts.drop("illegal").join(found, same)
    return both.select("conv", "part", "seq", "audit", "entry", "roles", "texts", *[f.name for f in StructType.fromDDL(TOTALS)]).mapInArrow(edited, result_schema)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables of (conv, part, seq, audit, roles, texts, gaps, blank, duplicate, truncated, illegal, cost): conversations repaired in one row, and
    those in several rows, ordered by (part, seq), with the totals in one of them."""
    chunked = chunks(rows, conv_id, turn, role, text)
    return in_one(chunked), in_runs(chunked)


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation, whose rows follow each other in order: totals, audit and the digest of the repaired ``role:text`` lines."""
    schema = _schema(repaired, f"audit string, repaired_sha256 string, {TOTALS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, lines, totals, open_ = None, [], hashlib.sha256(), 0, None, False

        def close() -> tuple:
            return conv, "".join(audit), sha.hexdigest(), *totals

        for batch in batches:
            out = []
            for key, letters, roles, texts, *own in _rows(batch):
                if open_ and key != conv:
                    out.append(close())
                if not open_ or key != conv:
                    conv, audit, sha, lines, totals, open_ = key, [], hashlib.sha256(), 0, None, True
                audit.append(letters)
                for r, t in zip(roles, texts):
                    sha.update((("\n" if lines else "") + f"{r}:{t}").encode())
                    lines += 1
                totals = own if own[0] is not None else totals
            if out:
                yield _batch(out, schema)
        if open_:
            yield _batch([close()], schema)

    return repaired.select("conv", "audit", "roles", "texts", *[f.name for f in StructType.fromDDL(TOTALS)]).mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the query damages them, by the checksum of ``conv_id:turn``."""
    space = F.lit(" ")
    text = F.coalesce("text", space)
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    marked = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return marked.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    one, several = repair(damaged(conversations))
    found = digests(one).unionByName(digests(several.repartition("conv").sortWithinPartitions("conv", "part", "seq")))
    every = conversations.select("conv_id").distinct()
    names = [f.name for f in StructType.fromDDL(TOTALS)]
    empty = hashlib.sha256().hexdigest()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )


def _oracle() -> str:
    """The cheapest edits row by row: for each state the least of (cost, letters) as one text that sorts so."""

    def add(key: str, cost: str, letter: str) -> str:
        return f"CASE WHEN {key} = 'z' THEN 'z' ELSE lpad(CAST(CAST({key}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}' END"

    def when(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} ELSE 'z' END"

    grown = f"least(ku, {add('k0', '2', 'I')}, {add('ks', '2', 'I')}, {add('ka', '2', 'I')})"
    inserted = f"SELECT conv_id, i, k0, ks, ku, least(ka, {add('ku', '2', 'I')}) AS ka FROM (SELECT conv_id, i, k0, ks, {grown} AS ku, ka FROM %s)"
    kept = lambda state, initial: when(f"c = '{initial}' AND NOT must", add(state, "t", "K"))
    other = lambda state: when("NOT must", add(state, "2 + t", "R"))
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
),
hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS kind FROM src
),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE kind <> 0
),
num AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM dam),
f AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM num
),
g AS (SELECT conv_id, i, c, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM f),
counts AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id
),
st AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS k0, 'z' AS ks, 'z' AS ku, 'z' AS ka FROM counts
  UNION ALL
  SELECT s.conv_id, g.i, {add('k0', '3', 'D')}, least({add('ks', '3', 'D')}, {kept('k0', 's')}),
    least({add('ku', '3', 'D')}, {kept('k0', 'u')}, {kept('ks', 'u')}, {kept('ka', 'u')}, {other('k0')}, {other('ks')}, {other('ka')}),
    least({add('ka', '3', 'D')}, {kept('ku', 'a')}, {other('ku')})
  FROM ({inserted % 'st'}) s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i + 1
),
best AS (SELECT c.*, least(e.k0, e.ka) AS k FROM ({inserted % 'st'}) e JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.n = e.i),
letters AS (SELECT conv_id, o, substr(k, 9 + CAST(o AS INT), 1) AS l FROM (SELECT conv_id, k, unnest(range(1, length(k) - 8)) AS o FROM best)),
placed AS (SELECT conv_id, o, l, sum(CASE WHEN l = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN l = 'D' THEN 0 ELSE 1 END) OVER w AS n FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY o)),
lines AS (SELECT p.conv_id, p.o, p.l, p.n, f.role, f.text, max(CASE WHEN p.n = 1 AND p.l = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS s
  FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE p.l <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (n - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS repaired FROM lines GROUP BY conv_id)
SELECT e.conv_id, coalesce(b.gaps, 0) AS gaps, coalesce(b.blank, 0) AS blank, coalesce(b.duplicate, 0) AS duplicate, coalesce(b.truncated, 0) AS truncated, coalesce(b.illegal, 0) AS illegal,
  coalesce(CAST(b.k[1:9] AS BIGINT), 0) AS cost, coalesce(substr(b.k, 10), '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _oracle()
