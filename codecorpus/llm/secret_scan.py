"""Secret scans by grammar inference.

Three base patterns give labelled credentials of three formats. From the labelled ones a probabilistic automaton is inferred
per format: their prefix tree is folded by merging states, in order from the root, whose next-symbol and end frequencies
agree by Hoeffding's bound, with all their successors. Symbols are character classes, so that a state speaks of a
format and not of one key. The same is learned from ordinary strings. Every candidate string of the texts is then scored: it is a
secret of a format if that automaton makes it likelier per character, by a margin, than the automaton of ordinary strings.

Base spans always stay; inferred spans come on top where no base span lies.

Defined results: a null text counts as empty; an empty text has no spans. Rows with null or repeated ids are scanned like others. If
no labelled credential of a format exists, no automaton of it is used. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import table

#: Fixed patterns of the base formats.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex"]
LEAST = {"assign": 8, "access": 16, "hex": 32}
FOUND = "inferred"

#: Strings of at least as many credential characters as the shortest labelled credential has are candidates.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}", re.A)
DIGIT = re.compile(r"[0-9]")
_ASSIGN = re.compile(ASSIGN, re.A | re.I)
_ACCESS, _HEX = re.compile(ACCESS, re.A), re.compile(HEX, re.A)
#: A lower-cased text without any of these has no assignment.
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]

#: The classifier's sample: at most so many labelled strings of each format and of ordinary ones, chosen by a hash of the string.
SAMPLE = 400
#: Confidence of the merge test, and how much likelier (in natural log per character) a secret must be than an ordinary string.
ALPHA, MARGIN = 0.05, 0.5
END = "$"
#: Groups in which the strings with the smallest hashes are found first, and strings whose verdict a task remembers.
SHARES, KNOWN = 64, 200_000


def base_spans(text: str, found: list[tuple[int, int, str]] | None = None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base patterns, by start and then kind. Access keys and hexadecimal strings are
    looked for inside the long runs ``found`` in the text, which hold every one of them whole."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out = [("assign", m.start(), m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    for start, _, run in runs_of(text) if found is None else found:
        for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
            out += [(kind, start + m.start(), start + m.end(), m.group()) for m in pattern.finditer(run) if len(m.group()) >= LEAST[kind]]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def runs_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, string) of the runs of credential characters."""
    return [(m.start(), m.end(), m.group()) for m in CANDIDATE.finditer(text)]


def classes(s: str) -> str:
    """Hexadecimal letters, other letters of either case, digits, and every other character itself."""
    return s.translate(_CLASSES)


_CLASSES = {ord(c): ("h" if c in "abcdef" else "w" if c.islower() else "U" if c.isupper() else "9" if c.isdigit() else c) for c in map(chr, range(128)) if c.isalnum()}


class Automaton:
    """Probabilistic automaton inferred from strings of symbols."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for s in strings:
            at = 0
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][c]
            self.count[at][END] = self.count[at].get(END, 0) + 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self.total = [sum(c.values()) for c in self.count]

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            nx, ny = sum(self.count[x].values()), sum(self.count[y].values())
            if not nx or not ny:
                continue
            gap = self.bound * (1 / math.sqrt(nx) + 1 / math.sqrt(ny))
            for c in self.count[x].keys() | self.count[y].keys():
                if abs(self.count[x].get(c, 0) / nx - self.count[y].get(c, 0) / ny) > gap:
                    return False
            todo += [(self.next[x][c], self.next[y][c]) for c in self.next[x].keys() & self.next[y].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to state ``a`` and what follows it."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            for c, n in self.count[y].items():
                self.count[x][c] = self.count[x].get(c, 0) + n
            for c, below in self.next[y].items():
                if c in self.next[x]:
                    todo.append((self.next[x][c], below))
                else:
                    self.next[x][c] = below

    def _infer(self) -> None:
        """Settled states are red; their successors outside (roots of trees) are merged into one of them or become red."""
        red = [0]
        while True:
            blue = next(((r, c, t) for r in red for c, t in sorted(self.next[r].items()) if t not in red), None)
            if blue is None:
                return
            source, symbol, target = blue
            home = next((r for r in red if self._compatible(r, target)), None)
            if home is None:
                red.append(target)
            else:
                self.next[source][symbol] = home
                self._fold(home, target)

    def score(self, s: str) -> float:
        """Natural log of the probability per symbol; an unseen symbol or end counts as half an observation of many."""
        at, total = 0, 0.0
        for c in s + END:
            n = self.total[at]
            total += math.log((self.count[at].get(c, 0) + 0.01) / (n + 1))
            if c != END:
                if c not in self.next[at]:
                    return -math.inf
                at = self.next[at][c]
        return total / (len(s) + 1)


Model = dict[str, Automaton]


def candidates(found: list[tuple[int, int, str]], spans: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """The runs that touch no base span."""
    if not spans:
        return found
    out, at, n = [], 0, len(spans)
    for start, end, run in found:
        while at < n and spans[at][2] <= start:
            at += 1
        if not any(a < end and start < b for _, a, b, _ in itertools.takewhile(lambda x: x[1] < end, itertools.islice(spans, at, None))):
            out.append((start, end, run))
    return out


def examples(text: str) -> Iterator[tuple[str, str]]:
    """(format, string) of everything in a text that the automata learn from; ordinary strings are those with a digit and words."""
    found = runs_of(text)
    spans = base_spans(text, found)
    for kind, _, _, s in spans:
        yield kind, s
    for s in {s for _, _, s in candidates(found, spans)}:
        yield "other" if DIGIT.search(s) else "word", s


def labelled(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict[str, list[str]]:
    """At most ``sample`` distinct strings of each format, those with the smallest hashes over all texts. No task passes on more
    than ``sample`` of a format."""

    def least(own: dict[str, str]) -> dict[str, str]:
        return dict(sorted(own.items(), key=lambda x: x[1])[:sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[str, str]] = {}
        for batch in batches:
            for value in batch.column(0):
                for kind, s in examples(value.as_py() or ""):
                    own = seen.setdefault(kind, {})
                    if s not in own:
                        own[s] = hashlib.md5(s.encode()).hexdigest()
            seen = {k: least(own) if len(own) > 2 * sample else own for k, own in seen.items()}
        rows = [(k, s, h) for k, own in seen.items() for s, h in least(own).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(3)], ["kind", "s", "h"])

    found = docs.select(text).mapInArrow(run, "kind string, s string, h string").distinct()
    # First within shares of a format, so that what meets for one format does not grow with the number of tasks.
    share = F.pmod(F.xxhash64("s"), F.lit(SHARES))
    near = F.row_number().over(Window.partitionBy("kind", "share").orderBy("h", "s"))
    found = found.withColumn("share", share).withColumn("n", near).where(F.col("n") <= sample)
    first = F.row_number().over(Window.partitionBy("kind").orderBy("h", "s"))
    out: dict[str, list[str]] = {}
    for row in found.withColumn("n", first).where(F.col("n") <= sample).orderBy("kind", "n").collect():
        out.setdefault(row["kind"], []).append(row["s"])
    return out


def learn(strings: dict[str, list[str]]) -> Model:
    """An automaton for each format with labelled credentials, and one for everything ordinary."""
    model = {k: Automaton([classes(s) for s in strings[k]]) for k in KINDS if strings.get(k)}
    model["ordinary"] = Automaton([classes(s) for k in ("other", "word") for s in strings.get(k, [])])
    return model


def likely(s: str, model: Model, margin: float = MARGIN) -> bool:
    """Whether a string is likelier as a credential than as an ordinary string."""
    symbols = classes(s)
    best = max((a.score(symbols) for k, a in model.items() if k != "ordinary"), default=-math.inf)
    return best > max(model["ordinary"].score(symbols), -50.0) + margin


def inferred_spans(found: list[tuple[int, int, str]], spans: list[tuple[str, int, int, str]], model: Model, known: dict[str, bool] | None = None) -> list[tuple[str, int, int]]:
    """Every candidate is scored; ``known`` remembers verdicts, since most are words that come again."""
    out, known = [], {} if known is None else known
    for start, end, s in candidates(found, spans):
        secret = known.get(s)
        if secret is None:
            secret = likely(s, model)
            if len(known) >= KNOWN:
                known.clear()
            if len(s) <= 64:
                known[s] = secret
        if secret:
            out.append((FOUND, start, end))
    return out


def all_spans(text: str, model: Model, known: dict[str, bool] | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, all) spans (kind, start, end) of a text by start, base kinds first."""
    found = runs_of(text)
    base = base_spans(text, found)
    plain = [s[:3] for s in base]
    more = inferred_spans(found, base, model, known)
    order = [*KINDS, FOUND]
    return plain, sorted(plain + more, key=lambda s: (s[1], order.index(s[0])))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with counts of base spans by kind, the digest of the base spans, and all spans."""
    schema = docs.select(*keep).schema
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            found = [all_spans(t.as_py() or "", model, known) for t in batch.column(text)]
            cols = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            cols.append(pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()))
            cols.append(pa.array([listed(every) for _, every in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a text replaced by ``mask``; spans that overlap are replaced together."""
    names = docs.columns

    def clean(value: str | None, known: dict[str, bool]) -> str | None:
        if not value:
            return value
        out, at, open_until = [], 0, 0
        for _, start, end in all_spans(value, model, known)[1]:
            if start >= open_until:
                out += [value[at:start], mask]
            at = open_until = max(open_until, end)
        return "".join([*out, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            cols = [pa.array([clean(t.as_py(), known) for t in batch.column(c)], pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(labelled(docs)), ["doc_id"])
