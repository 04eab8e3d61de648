"""Quality rules (operator 1): weak supervision in place of a filter that asks for all rules to be met.

Each rule votes good (1), bad (0) or abstains (null). Expectation-maximisation over the counts of vote
patterns estimates how often each rule votes which way on good and on bad documents, and a document's
posterior probability of being good decides. It is fitted on the documents that the base rules let through,
since those are the ones that it decides on. Abstaining says nothing of a document. Three votes and len(RULES)
rules bound the number of patterns, so what reaches the driver doesn't grow with the input. Only DataFrame
functions touch the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SPACE, let

REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
ROUNDS = 200
#: Weak priors: (votes, bad votes) that each rule is taken to have cast already on good and on bad documents. They tell the two classes apart at the start and count for less the more documents there are.
PRIOR_ON_GOOD, PRIOR_ON_BAD, PRIOR_SHARE_GOOD = (1.0, 0.02), (20.0, 10.0), 0.9
#: Rates stay this far from 0 and 1, so that their logarithms exist.
LEAST_RATE = 1e-6
KEEP_FROM = 0.5
#: The rules in the order of their votes.
RULES = ["length", "word_width", "symbols", "digits", "repeated_words", "repeated_lines", "fresh_words", "marked_words", "lone_symbols"]

#: A symbol right after a letter, and a word of nothing but symbols.
MARKED, LONE = rf"\p{{L}}[{SYMBOLS}]", rf"(?<![^{SPACE}])[{SYMBOLS}]+(?![^{SPACE}])"

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_marked_words", "n_lone_symbols"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(ws: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words within windows that stand twice or more among ws. Windows are compared by a 64-bit hash; n log n in the number of words."""

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            again = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def covered(at: Column) -> Column:
            spans = F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window))))
            return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, places), covered))

    # one array of word hashes, then each window's hash from eight of them
    windows = let(
        F.transform(ws, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])),
    )
    return F.when(F.size(ws) <= window, F.lit(0).cast("long")).otherwise(let(windows, of))


def features(text: Column) -> Column:
    """A struct of FEATURES; a null text has no words."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    n = lambda c, name: c.cast("long").alias(name)
    where_symbols = lambda c: F.when(whole.rlike(f"[{SYMBOLS}]"), c).otherwise(0)

    def of(ws: Column) -> Column:
        return F.struct(
            n(F.size(ws), "n_words"),
            n(F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")), "word_chars"),
            n(F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")), "n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(ws).alias("n_repeat_words"),
            n(F.size(lines), "n_lines"),
            n(F.size(F.array_distinct(ws)), "n_distinct_words"),
            n(F.length(whole) - F.length(F.translate(whole, "0123456789", "")), "n_digits"),
            n(where_symbols(F.regexp_count(whole, F.lit(MARKED))), "n_marked_words"),
            n(where_symbols(F.regexp_count(whole, F.lit(LONE))), "n_lone_symbols"),
        )

    return let(words(whole), of)


def _vote(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), None).when(bad, 0).when(good, 1)


def rules(f) -> dict[str, Column]:
    """Votes on the features f(name)."""
    n = F.nullif(f("n_words"), F.lit(0)).cast("double")
    lines = F.nullif(f("n_lines"), F.lit(0)).cast("double")
    width, symbols, digits = f("word_chars") / n, f("n_symbols") / n, f("n_digits") / F.nullif(f("word_chars"), F.lit(0))
    marked, lone = f("n_marked_words") / n, f("n_lone_symbols") / n
    repeats, doubled, fresh = f("n_repeat_words") / n, f("n_dup_lines") / lines, f("n_distinct_words") / n
    return {
        "length": _vote(f("n_words"), f("n_words") < MIN_WORDS, f("n_words") >= 50),
        "word_width": _vote(width, (width < 2.5) | (width > 15), (width >= 3.5) & (width <= 11)),
        "symbols": _vote(symbols, symbols > 0.1, symbols < 0.02),
        "digits": _vote(digits, digits > 0.15, digits < 0.05),
        "repeated_words": _vote(repeats, 100 * f("n_repeat_words") > MAX_REPEAT_PERCENT * f("n_words"), repeats < 0.1),
        "repeated_lines": _vote(doubled, doubled > 0.3, (doubled < 0.1) & (lines >= 3)),
        "fresh_words": _vote(fresh, (f("n_words") >= 50) & (f("n_words") <= 2000) & (fresh < 0.2), fresh > 0.35),
        "marked_words": _vote(marked, marked > 0.1, marked < 0.02),
        "lone_symbols": _vote(lone, lone > 0.1, lone < 0.02),
    }


def estimate(patterns: list[tuple[tuple, int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, for each rule the rates of a bad vote on good and on bad documents), by expectation-maximisation.

    A rule is no worse than chance: its rate on bad documents is at least that on good ones.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    inside = lambda x: min(max(x, LEAST_RATE), 1 - LEAST_RATE)
    good, rates = PRIOR_SHARE_GOOD, [(PRIOR_ON_GOOD[1] / PRIOR_ON_GOOD[0], PRIOR_ON_BAD[1] / PRIOR_ON_BAD[0])] * n_rules
    for _ in range(rounds if patterns else 0):
        sums = [[list(PRIOR_ON_GOOD), list(PRIOR_ON_BAD)] for _ in range(n_rules)]
        total = total_good = 0.0
        for votes, count in patterns:
            p = posterior(votes, good, rates)
            total, total_good = total + count, total_good + count * p
            for s, v in zip(sums, votes, strict=True):
                if v is not None:
                    for side, share in ((0, p), (1, 1 - p)):
                        s[side][0] += count * share
                        s[side][1] += count * share * (1 - v)
        good = inside(total_good / total)
        found = [(inside(g[1] / g[0]), inside(b[1] / b[0])) for g, b in sums]
        rates = [(g, max(g, b)) for g, b in found]
    return good, rates


def log_odds(good: float, rates: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of being good: before any vote, and added by each rule's bad and good vote."""
    return math.log(good / (1 - good)), [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in rates]


def posterior(votes: tuple, good: float, rates: list[tuple[float, float]]) -> float:
    start, steps = log_odds(good, rates)
    odds = start + sum(step[v] for step, v in zip(steps, votes, strict=True) if v is not None)
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def _failed(q) -> Column:
    return (q("n_words") < MIN_WORDS) | (100 * q("n_repeat_words") > MAX_REPEAT_PERCENT * q("n_words"))


def _fit(known: DataFrame, name: str) -> tuple[float, list[tuple[float, float]]]:
    """Estimates from the votes on the documents of a table with the features in the column `name`."""
    q = lambda feature: F.col(name)[feature]
    votes = rules(q)
    counted = known.filter(~_failed(q)).groupBy(*[v.alias(rule) for rule, v in votes.items()]).agg(F.count(F.lit(1)).alias("n"))
    patterns = sorted((([r[rule] for rule in votes], r["n"]) for r in counted.collect()), key=str)  # 3 ** len(votes) at most
    return estimate(patterns)


def _judged(known: DataFrame, name: str, good: float, rates: list[tuple[float, float]], keep_from: float) -> DataFrame:
    q = lambda feature: F.col(name)[feature]
    votes = rules(q)
    start, steps = log_odds(good, rates) if rates else (0.0, [(0.0, 0.0)] * len(votes))
    odds = F.lit(start)
    for v, (bad_step, good_step) in zip(votes.values(), steps, strict=True):
        odds = odds + F.when(v == 0, bad_step).when(v == 1, good_step).otherwise(0.0)
    failed, p_good = _failed(q), 1 / (1 + F.exp(-odds))
    return known.withColumn(name, F.struct(*[q(feature).alias(feature) for feature in FEATURES], failed.alias("base_failed"), p_good.alias("p_good"), (~failed & (p_good >= keep_from)).alias("kept")))


def judge(docs: DataFrame, keep: list[str], keep_from: float = KEEP_FROM, name: str = "_quality") -> DataFrame:
    """The columns `keep` of docs with the struct `name`: FEATURES, base_failed, p_good, kept.

    Features are worked out once, into a staged table with the columns to keep, from which votes are counted and
    then judged. Each row is judged alone, so repeated rows and null ids do no harm; a null or empty text fails
    the base rules. An empty table gives an empty result. The name must be free among the columns to keep.
    """
    known = common.stage(docs.withColumn(name, features(F.col("text"))).select(*keep, name), "quality")
    return _judged(known, name, *_fit(known, name), keep_from)


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs; null and empty texts have no words and fail the base rules, an empty table gives no rows."""
    out = judge(docs, ["doc_id"])
    return out.select("doc_id", *[F.col(f"_quality.{name}").alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept")])


def kept(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that the rules keep, with the columns of docs, whatever their names.

    Features are worked out once: one copy of the rows goes to the staged table with them. Null, empty and
    repeated texts are judged as by `judge`.
    """
    name = common.free_name(docs, "quality")
    judged = judge(docs, docs.columns, keep_from, name)
    return judged.filter(F.col(name)["kept"]).select(*docs.columns)
