"""Building blocks for oracle SQL."""

from __future__ import annotations


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count_of(x: str, needle: str) -> str:
    return f"CAST((strlen({x}) - strlen(replace({x}, {q(needle)}, ''))) / {len(needle.encode())} AS INT)"


def count_any(x: str, needles: list[str]) -> str:
    return "(" + " + ".join(count_of(x, n) for n in needles) + ")"


def count_re(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def line_total(x: str) -> str:
    return f"len({lines(x)})"


def lines_where(x: str, cond: str) -> str:
    """Number of lines ``s`` for which ``cond`` holds."""
    return f"len(list_filter({lines(x)}, lambda s: {cond}))"


def nonblank(x: str) -> str:
    return lines_where(x, r"regexp_matches(s, '\S')")


def clamp(x: str, lo: int, hi: int) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def pct(a: str, b: str, scale: str = "100e0") -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} * {scale} ELSE 0e0 END"


def has_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def values(pairs: list[tuple], names: str) -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, p)) + ")" for p in pairs) + f") {names}"


def stable_bucket(x: str, n: int, salt: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({q(salt)} || ':' || CAST({x} AS VARCHAR)), 1, 12) AS BIGINT) % {n} AS INT)"


# Non-ASCII letters and digits as an ASCII word character, so RE2's ASCII \b and \w act like Unicode ones.
def ascii_words(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[^\P{{L}}\x00-\x7F]', 'Z', 'g'), '[^\P{{N}}\x00-\x7F]', '9', 'g')"


EXT = r"regexp_extract(lower({x}), '[^/.][^/]*(\.[^./]*)$', 1)"


def ext(x: str) -> str:
    return EXT.replace("{x}", x)


SCORE_COLUMNS = {
    "complexity": "complexity_score", "readability": "readability_score", "maintainability": "maintainability_score",
    "overall": "overall_quality_score",
}


def python_skeletons(names: list[str]) -> str:
    """The derived Python files that parse, known by their making: depth ``d`` of the nested conditionals, which begin on line 8, and the filled-in name ``v``."""
    cases = " ".join(f"WHEN {i} THEN {q(n)}" for i, n in enumerate(names))
    return f"(SELECT doc_id AS file_id, CAST(3 + doc_id % 6 AS INT) AS d, CASE doc_id % 16 {cases} END AS v FROM documents WHERE doc_id % 4 = 0 AND doc_id % 28 <> 0)"


#: Those that do not parse: a broken header follows the last function.
BROKEN_SKELETONS = "(SELECT doc_id AS file_id, CAST(3 + doc_id % 6 AS INT) AS d FROM documents WHERE doc_id % 28 = 0)"
