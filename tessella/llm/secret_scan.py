"""Secret scans (operator 7): three fixed patterns, and character Markov models for what they don't name.

The models give the probability of each character after the one before it, one trained on random strings, one
on ordinary identifiers and words. A long token whose log-likelihood ratio is high enough is a secret.
Training counts come from labelled samples (a DataFrame of token and secret) by DataFrame functions; a table
of character pairs is all that reaches the driver. Documents see DataFrame functions only.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_FROM, ACCESS_FROM = 6, 20

#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET)
#: Log-likelihood ratio a character from which a token is a secret, whatever characters it is made of.
RATIO_FROM = 0.35
#: Matches whose places are added up one by one; whole groups of so many are added up first.
GROUP = 256

SAMPLE_SEED, SAMPLE_EACH = 7, 3000
# Parts of ordinary identifiers for the built-in training sample.
PARTS = (
    "get set is has make build read write open close load save parse format print user name file path list map key value index count total "
    "size length width height left right first last next prev node tree graph edge data table column row field type class object method "
    "function test error message event handler manager service client server request response config option default input output buffer "
    "stream token string number float double integer boolean array result status state start stop begin end time date hour minute second "
    "the and that with from this have will which there their would about other into more some could them only over also after most under "
    "tion ment able ness ing er ous ive al ly pre pro con dis inter trans auf ung heit keit schaft lich ver ent que cion miento mente eau aux oir"
).split()


def sample(spark: SparkSession, seed: int = SAMPLE_SEED, each: int = SAMPLE_EACH) -> DataFrame:
    """The built-in labelled sample: (token, secret). Random strings over three alphabets; identifiers joined in four ways."""
    rng = random.Random(seed)
    secrets = ["".join(rng.choice(a) for _ in range(rng.randint(20, 48))) for a in ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64]) for _ in range(each // 3)]

    def identifier(k: int) -> str:
        parts = [rng.choice(PARTS) for _ in range(rng.randint(3, 7))]
        glue = ("_", "-", "", "/")[k % 4]
        parts = [p.capitalize() if k % 8 == 2 or k % 8 == 6 and i else p for i, p in enumerate(parts)]
        return glue.join(parts) + (str(rng.randint(0, 2100)) if k % 5 == 0 else "")

    return spark.createDataFrame([(s, True) for s in secrets] + [(identifier(k), False) for k in range(each)], "token string, secret boolean")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of secret to ordinary for each pair of characters, row by row in the order of ALPHABET; add-one smoothed."""
    chars = F.filter(F.split("token", ""), lambda c: (c != "") & (F.instr(F.lit(ALPHABET), c) > 0))
    pairs = samples.select("secret", chars.alias("c")).select("secret", F.explode(F.filter(F.transform("c", lambda x, i: F.concat(x, F.get("c", i + 1))), lambda p: p.isNotNull())).alias("pair"))
    counts = {(r["secret"], r["pair"]): r["n"] for r in pairs.groupBy("secret", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 * SIDE ** 2 at most
    out = []
    for a in ALPHABET:
        rows = {s: [counts.get((s, a + b), 0) + 1 for b in ALPHABET] for s in (True, False)}
        totals = {s: sum(row) for s, row in rows.items()}
        out += [math.log(x / totals[True]) - math.log(y / totals[False]) for x, y in zip(rows[True], rows[False], strict=True)]
    return out


def spans(text: Column, pattern: str, kind: str, rank: int, passes=None) -> Column:
    """Array of structs (start, rank, end, kind, word): leftmost non-overlapping matches in code points.

    A match starts where the pieces and matches before it end. Lengths are added up by groups, so that a text
    of very many matches doesn't take time with the square of their number.
    """
    kind_of = "array<struct<start: int, rank: int, end: int, kind: string, word: string>>"

    def of(both: Column) -> Column:
        def at(totals: Column) -> Column:
            def with_groups(groups: Column) -> Column:
                def place(m: Column, i: Column) -> Column:
                    whole = F.floor(i / GROUP).cast("int")
                    before = F.aggregate(F.slice(groups, 1, whole), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(totals, whole * GROUP + 1, i - whole * GROUP), F.lit(0), lambda a, x: a + x)
                    return let(before + F.length(F.get(both["pieces"], i)), lambda s: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("word")))

                return F.transform(both["matches"], place)

            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(totals) - 1) / GROUP).cast("int")), lambda g: F.aggregate(F.slice(totals, g * GROUP + 1, F.lit(GROUP)), F.lit(0), lambda a, x: a + x))
            return let(sums, with_groups)

        return let(F.transform(both["matches"], lambda m, i: F.length(m) + F.length(F.get(both["pieces"], i))), at)

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    found = F.when(text.rlike(pattern), let(both, of)).otherwise(F.array().cast(kind_of)).cast(kind_of)
    return F.filter(found, lambda s: passes(s["word"])) if passes else found


def log_ratio(word: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio of a token's pairs of characters."""
    code = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = let(F.filter(code, lambda c: c > 0), lambda c: F.transform(c, lambda x, i: F.when(i > 0, F.get(ratios, (F.get(c, i - 1) - 1) * SIDE + x - 1)).otherwise(0.0)))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.length(word) - 1, F.lit(1))


def scan(text: Column, ratios: Column, ratio_from: float = RATIO_FROM) -> Column:
    """Struct (base, found): the spans of the base patterns by start then kind, and those of the models that touch none of them."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    base = F.concat(
        spans(whole, ASSIGN, "assign", 0, lambda w: F.length(F.regexp_extract(w, ASSIGN, 2)) >= ASSIGN_FROM),
        spans(whole, ACCESS, "access", 1, lambda w: F.length(w) >= ACCESS_FROM),
        spans(whole, HEX, "hex", 2),
    )
    tokens = spans(whole, TOKEN, "model", 3, lambda w: log_ratio(w, ratios) >= ratio_from)
    return let(F.sort_array(base), lambda b: F.struct(b.alias("base"), F.filter(tokens, lambda t: ~F.exists(b, lambda x: (x["start"] < t["end"]) & (t["start"] < x["end"]))).alias("found")))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, samples: DataFrame | None = None, ratio_from: float = RATIO_FROM) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans.

    A null text is empty. Rows are judged alone: repeated rows, null ids and other columns do no harm. An empty
    table gives no rows; an empty sample gives models that call nothing a secret.
    """
    spark = docs.sparkSession
    ratios = train(sample(spark) if samples is None else samples)
    known = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded into one literal of SIDE ** 2 numbers
    seen = docs.select("doc_id", scan(F.col("text").cast("string"), known).alias("_s"))
    n = lambda kind: F.size(F.filter("_s.base", lambda x: x["kind"] == kind)).cast("long")
    return seen.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.size("_s.found").cast("long").alias("n_model"),
        F.sha2(as_text(F.col("_s.base")), 256).alias("base_sha256"),
        as_text(F.sort_array(F.concat("_s.base", "_s.found"))).alias("spans"),
    )
