"""Regular-expression and text helpers shared by every operator.

Source code is scanned with Python regex semantics: ``\\w``, ``\\s`` and ``\\b`` are Unicode-aware. Java's defaults are
ASCII-only, so :func:`rx` expands these classes to explicit ones before the pattern reaches Catalyst.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as understood by str.strip / str.isspace (fixed values).
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

_WORD_SET = r"\p{L}\p{N}_"
_SPACE_SET = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORD = f"[{_WORD_SET}]"
SPACE = f"[{_SPACE_SET}]"
NONSPACE = f"[^{_SPACE_SET}]"
BLANK_RUN = "[" + _SPACE_SET.replace(r"\t-\r", r"\t\x0B-\r") + "]"  # white space except the newline
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def rx(pattern: str) -> str:
    """Expand ``\\w \\s \\S \\b`` to Unicode-aware Java equivalents (``\\w`` may also appear inside a class)."""
    return (
        pattern.replace(r"[^\s]", NONSPACE)
        .replace(r"\S", NONSPACE)
        .replace(r"\w", WORD)
        .replace(r"\s", SPACE)
        .replace(r"\b", BOUNDARY)
    )


def count_re(col: Column, pattern: str, flags: str = "") -> Column:
    """Number of non-overlapping matches of a Python-style pattern."""
    return F.regexp_count(col, F.lit(flags + rx(pattern)))


def search(col: Column, pattern: str, flags: str = "") -> Column:
    return col.rlike(flags + rx(pattern))


def literal_of(pattern: str) -> str:
    """Longest lower-case literal every match of an alternation-free pattern must contain, '' when there is none."""
    pattern = re.sub(r"\(\?<?[!=][^)]*\)", "", pattern)  # look-arounds consume nothing
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            c = pattern[i] if not pattern[i].isalpha() else ""
        elif c == "[":
            i = pattern.index("]", i + 1)
            c = ""
        elif c in "^$.(){}|":
            c = ""
        elif c in "*?":
            run, c = run[:-1], ""
        elif c == "+":
            c = ""
        run += c
        if not c:
            runs.append(run)
            run = ""
        i += 1
    return max([*runs, run], key=len).lower()


def group(col: Column, pattern: str, idx: int, flags: str = "") -> Column:
    """Group ``idx`` of the first match, '' when there is none."""
    return F.regexp_extract(col, flags + rx(pattern), idx)


def sub(col: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Replace every match; ``replacement`` uses Java ``$n`` references."""
    return F.regexp_replace(col, flags + rx(pattern), replacement)


def word_count(col: Column, word: str) -> Column:
    """Occurrences of ``word`` as a whole word. The literal leads and the look-behind follows it, so the engine can skip ahead."""
    return F.regexp_count(col, F.lit(whole_word(word)))


def whole_word(word: str) -> str:
    return f"{word}(?<!{WORD}{word})(?!{WORD})"


def count_of(col: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal substring (byte lengths: no regex engine, stays in codegen)."""
    size = len(needle.encode())
    gone = F.octet_length(F.replace(col, F.lit(needle), F.lit("")))
    return ((F.octet_length(col) - gone) / size).cast("int")


def count_any(col: Column, needles: list[str]) -> Column:
    """Sum of the separate counts of each needle (overlaps between different needles count for both)."""
    total = F.lit(0)
    for needle in needles:
        total = total + count_of(col, needle)
    return total


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WS_CHARS))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WS_CHARS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WS_CHARS))


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(lstrip(line))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def split_lines(col: Column) -> Column:
    """``split('\\n')``: a trailing newline yields a final empty line."""
    return F.split(col, "\n", -1)


def line_total(col: Column) -> Column:
    """Number of lines of :func:`split_lines` without building the array."""
    return count_of(col, "\n") + 1


def nonblank_lines(col: Column) -> Column:
    """Lines with at least one non-space character: each match eats the rest of its line."""
    return F.regexp_count(col, F.lit(NONSPACE + r"[^\n]*"))


def long_lines(col: Column, limit: int) -> Column:
    """Lines longer than ``limit`` characters (the greedy run makes one match per line)."""
    return F.regexp_count(col, F.lit("[^\\n]{%d,}" % (limit + 1)))


def lines_containing(col: Column, pattern: str) -> Column:
    """Lines on which ``pattern`` is found at least once."""
    return F.regexp_count(col, F.lit(f"(?:{rx(pattern)})[^\\n]*"))


def lines_starting(col: Column, pattern: str) -> Column:
    """Lines whose stripped text starts with ``pattern``."""
    return F.regexp_count(col, F.lit(f"(?dm)^{BLANK_RUN}*(?:{rx(pattern)})[^\\n]*"))


def clamp(col: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col)).cast("int")


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """``num / den * scale`` as double, 0 when ``den`` is 0."""
    return F.when(den > 0, num.cast("double") / den * F.lit(float(scale))).otherwise(F.lit(0.0))


def has_any(col: Column, words: list[str]) -> Column:
    """True when the text holds any of the literal words."""
    found = F.lit(False)
    for w in words:
        found = found | col.contains(w)
    return found


def first_match(cases: list[tuple[Column, Column | str]], default: Column | str | None) -> Column:
    """CASE chain: the first true condition decides."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def stable_bucket(key: Column, buckets: int, salt: str = "0") -> Column:
    """Uniform bucket in [0, buckets) from an md5 prefix: stable across engines, versions and partitionings."""
    digest = F.md5(F.concat_ws(":", F.lit(salt), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def file_extension(path: Column) -> Column:
    """Lower-cased suffix of the file name including the dot; '' for none or for a leading-dot name."""
    return F.regexp_extract(F.lower(path), r"(?s)[^/.][^/]*(\.[^./]*)$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
