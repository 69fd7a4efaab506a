"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how far each is right,
and the posterior probability of good quality decides.

Everything is a column expression. Facts are computed inside the row; the only aggregate counts documents by vote pattern
(at most 3^8 patterns, whatever the input), and expectation-maximisation runs on those counts.

Defined results: a null text counts as empty; an empty text has only zeros, fails the base rule and is not kept; rows with a
null or repeated id are judged like others; an empty table gives no rows. Extra columns stay untouched in :func:`votes`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.common import WORD, let, stored, table, words

#: Frequent function words of the corpus languages.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "de", "la", "que", "el", "en", "y", "los", "le", "et",
    "les", "des", "un", "une", "der", "die", "und", "das", "ist", "von", "zu", "mit",
]
RULES = ["length", "word_length", "symbols", "heavy_symbols", "dup_lines", "repeats", "stop_words", "digits"]
MIN_WORDS = 50
#: Starting point: share of good documents, and how often a rule votes bad, abstains or votes good on good and on bad documents.
START_GOOD, START_ON_GOOD, START_ON_BAD = 0.8, (0.05, 0.25, 0.7), (0.4, 0.25, 0.35)
#: Votes that every estimate starts with, rounds, and the most that one vote may say (log odds).
PRIOR_VOTES, ROUNDS, STRONGEST = 2.0, 50, 4.0


def repeat_words(ws: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words that occurs twice or more in the text, each counted once.

    Windows are compared by a 64-bit hash within one text. Sorted (hash, place) pairs put equal windows side by side, so
    the cost is n log n for any text; texts without equal windows skip the sort."""
    n = F.size(ws)
    ends = [F.slice(ws, k + 1, F.greatest(n - size + 1, F.lit(0))) for k in range(size)]
    hashes = F.transform(F.arrays_zip(*[e.alias(f"w{k}") for k, e in enumerate(ends)]), lambda s: F.xxhash64(*[s[f"w{k}"] for k in range(size)]))

    def covered(hs: Column) -> Column:
        places = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        last = F.size(hs) - 1

        def equal_beside(ps: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(ps["h"], 1, last))
            after = F.concat(F.slice(ps["h"], 2, last), F.array(F.lit(None).cast("bigint")))
            zipped = F.arrays_zip(ps.alias("p"), before.alias("b"), after.alias("a"))
            hit = F.filter(zipped, lambda z: F.coalesce((z["p"]["h"] == z["b"]) | (z["p"]["h"] == z["a"]), z["p"]["h"] == z["b"], z["p"]["h"] == z["a"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda z: F.array(*[z["p"]["i"] + k for k in range(size)])))))

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(let(places, equal_beside))

    return F.when(n < size, 0).otherwise(let(hashes, covered))


def facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``facts`` of what the rules look at."""
    body = F.coalesce(F.col(text), F.lit(""))

    def of(ws: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
        counted = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
        stop = F.array(*[F.lit(w) for w in STOP_WORDS])
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            counted.alias("lines"),
            repeat_words(ws).cast("bigint").alias("n_repeat_words"),
            F.size(F.array_intersect(ws, stop)).alias("n_stop"),
            F.length(F.regexp_replace(body, r"[^0-9]+", "")).cast("bigint").alias("n_digits"),
        )

    return docs.withColumn("facts", let(words(F.col(text)), of))


def votes(docs: DataFrame) -> DataFrame:
    """1 (good), -1 (bad) or 0 (abstains) for each rule, in the array ``votes``; needs ``facts``."""
    f, n = F.col("facts"), F.greatest(F.col("facts.n_words"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")

    mean, symbols, repeats = f["word_chars"] / n, f["n_symbols"] / n, f["n_repeat_words"] / n
    dup = f["lines"]["dup"] / F.greatest(f["lines"]["n"], F.lit(1))
    digits = f["n_digits"] / F.greatest(f["word_chars"], F.lit(1))
    ballots = {
        "length": vote(f["n_words"] >= 80, f["n_words"] < MIN_WORDS),
        "word_length": vote(mean.between(3, 10), (mean < 2.5) | (mean > 14)),
        "symbols": vote(symbols < 0.02, symbols > 0.1),
        "heavy_symbols": vote(F.lit(False), symbols > 0.5),
        "dup_lines": vote(dup < 0.1, dup > 0.3),
        "repeats": vote(repeats < 0.2, repeats > 0.5),
        "stop_words": vote(f["n_stop"] >= 2, (f["n_stop"] == 0) & (f["n_words"] >= MIN_WORDS)),
        "digits": vote(digits < 0.1, digits > 0.3),
    }
    return docs.withColumn("votes", F.array(*[ballots[r] for r in RULES]))


Model = tuple[float, list[dict[int, float]]]


def estimate(patterns: list[tuple[list[int], int]]) -> Model:
    """Log odds of a good document and of each vote of each rule, from counted vote patterns.

    Two-class latent model: how accurate a rule is, is the chance of each of its votes given the class, estimated by
    expectation-maximisation. What keeps the classes from changing places: a good vote never speaks against a document, a
    bad one never for it, and an abstention says nothing."""
    total = sum(n for _, n in patterns)
    good = START_GOOD
    chances = [(list(START_ON_GOOD), list(START_ON_BAD)) for _ in RULES]
    for _ in range(ROUNDS if total else 0):
        model = weights(good, chances)
        kept = 0.0
        counts = [([PRIOR_VOTES * c for c in START_ON_GOOD], [PRIOR_VOTES * c for c in START_ON_BAD]) for _ in RULES]
        for ballot, n in patterns:
            p = 1 / (1 + math.exp(-log_odds(ballot, model)))
            kept += n * p
            for k, v in enumerate(ballot):
                counts[k][0][v + 1] += n * p
                counts[k][1][v + 1] += n * (1 - p)
        good = min(max((kept + 1) / (total + 2), 0.05), 0.95)
        chances = [tuple([x / sum(side) for x in side] for side in c) for c in counts]
    return weights(good, chances)


def weights(good: float, chances: list) -> Model:
    out = []
    for on_good, on_bad in chances:
        says = [math.log(a / b) for a, b in zip(on_good, on_bad)]
        out.append({-1: max(min(says[0], 0.0), -STRONGEST), 0: 0.0, 1: min(max(says[2], 0.0), STRONGEST)})
    return math.log(good / (1 - good)), out


def log_odds(ballot: list[int], model: Model) -> float:
    return model[0] + sum(w[v] for v, w in zip(ballot, model[1]))


def judge(voted: DataFrame, model: Model) -> DataFrame:
    """``voted`` with ``p_good``, the posterior probability of good quality."""
    score = F.lit(model[0])
    for k, w in enumerate(model[1]):
        score = score + F.when(F.col("votes")[k] < 0, w[-1]).when(F.col("votes")[k] > 0, w[1]).otherwise(0.0)
    return voted.withColumn("p_good", 1 / (1 + F.exp(-score)))


RESULTS = {"facts", "votes", "p_good", "base_failed", "kept"}


def quality(docs: DataFrame, keep: list[str], threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with facts, votes, ``p_good``, ``base_failed`` and ``kept``, which replace kept columns of these names.
    Facts are written once, since both the counts and the verdict read them."""
    keep = [c for c in keep if c.lower() not in RESULTS]
    voted = stored(votes(facts(docs, text)).select(*keep, "facts", "votes"))
    patterns = [(r["votes"], r["n"]) for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()]
    f = F.col("facts")
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    return judge(voted, estimate(patterns)).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("facts")
    return quality(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", f["n_words"].alias("n_words"), f["word_chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"),
        f["lines"]["dup"].cast("bigint").alias("n_dup_lines"), f["n_repeat_words"].alias("n_repeat_words"), "base_failed", "kept", "p_good",
    )
