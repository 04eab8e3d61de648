"""Quality classifier (operator 4): importance resampling with hashed n-gram models and Gumbel top-k.

Two generative models give the probability of each hashed word and word pair: one counted over target texts
(labelled good), one over all raw texts. A document's weight is the product of their ratios over its n-grams;
adding Gumbel noise to the log weights and taking the k largest draws k documents without replacement in
proportion to weight. Raw counts cover every document; target rows are a bounded sample of the labels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .texthash import FOLD, NOT_SPACE, U, chunks, span_hashes, window_hashes, words

#: Hash buckets of the models.
BUCKETS = 1 << 18
#: Labelled good documents that the target model is counted over, at most: those of smallest hash.
TARGET_ROWS = 20_000
#: Occurrences at the target's overall share that are added to each bucket, so that rare n-grams of the sample say little.
SMOOTHING = 30.0
SEED = 11


def gram_buckets(texts: pa.Array):
    """For runs of texts: (bucket of each word and word pair, first bucket of each text)."""
    for lo, hi, raw, offsets in chunks(texts):
        buf = FOLD[raw]
        starts, ends, first = words(buf, offsets, NOT_SPACE)
        h = span_hashes(buf, starts, ends) if len(starts) else np.zeros(0, U)
        pairs = window_hashes(h, 2)
        inner = first[(first > 0) & (first < len(h))]
        within = np.ones(len(pairs), dtype=bool)
        within[inner - 1] = False
        doc = np.searchsorted(first, np.arange(len(h)), side="right") - 1
        grams = np.concatenate([h, pairs[within]])
        of = np.concatenate([doc, doc[:-1][within] if len(h) else doc])
        order = np.argsort(of, kind="stable")
        yield lo, hi, (grams[order] % U(BUCKETS)).astype(np.int64), np.searchsorted(of[order], np.arange(hi - lo + 1))


def target_ids(labels: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of the target's to the raw model's probability of each bucket; zeros without labels."""
    target = F.broadcast(target_ids(labels).withColumn("_target", F.lit(True)))  # TARGET_ROWS at most
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(target, "doc_id", "left").select("text", F.coalesce("_target", F.lit(False)).alias("target"))

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            is_target = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buckets, first in gram_buckets(batch.column(0)):
                raw += np.bincount(buckets, minlength=BUCKETS)
                good += np.bincount(buckets[np.repeat(is_target[lo:hi], np.diff(first))], minlength=BUCKETS)
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(raw[there]), pa.array(good[there])], names=["bucket", "raw", "good"])

    counts = marked.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:  # BUCKETS rows at most
        raw[r["bucket"]] = r["raw"]
        good[r["bucket"]] = r["good"]
    if not good.sum():
        return np.zeros(BUCKETS)
    share = good.sum() / raw.sum()
    return np.log((good + SMOOTHING * share) / (raw + SMOOTHING) / share)


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, t, n_grams, log_weight) for each row; t is a hash of the text."""
    known = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in batches:
            n, weight = [], []
            for _, _, buckets, first in gram_buckets(batch.column(2)):
                total = np.concatenate([[0.0], np.cumsum(known.value[buckets])])
                n.append(np.diff(first))
                weight.append(total[first[1:]] - total[first[:-1]])
            whole = [np.concatenate(x) if x else np.zeros(0) for x in (n, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole[0].astype(np.int64)), pa.array(whole[1])], names=["doc_id", "t", "n_grams", "log_weight"])

    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(run, "doc_id long, t long, n_grams long, log_weight double")


def gumbel(seed: int, *key: str) -> Column:
    """Gumbel noise fixed by seed and key."""
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 12).cast("double") + 0.5) / float(2**52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column, exactly: values are counted in 4096 bins, then those of the bin that holds it, and so on."""
    if k <= 0:
        return None
    ordered = df.select(F.col(column).alias("_v"))
    low, high = ordered.agg(F.min("_v"), F.max("_v")).first()
    if low is None:
        return None
    while low < high:
        step = (high - low) / 4096
        if step == 0 or low + step == low:
            break
        bin_of = F.least(F.floor((F.col("_v") - low) / step), F.lit(4095))
        inside = ordered.filter((F.col("_v") >= low) & (F.col("_v") <= high))
        rows = sorted(((r["b"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()), reverse=True)
        for _, n, lo, hi in rows:
            if k <= n:
                low, high = lo, hi
                break
            k -= n
        else:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, full_length: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, kept.

    k is `share` of the documents; by default the share of quality 1 among the labels. The log weight is the sum
    over all n-grams; with full_length, the weight that is sampled by is scaled down to that of so many n-grams.
    Noise is fixed by id and text, so that documents of one id, or of none, are drawn apart; repeated rows, which
    have both in common, are kept alike. Null and empty texts have weight 1. Without labels everything is kept.
    Columns other than doc_id and text are not read; an empty table gives no rows.
    """
    scored = common.stage(weigh(docs, fit(docs, labels)), "weights")
    if share is None:
        n, good = labels.agg(F.count("quality"), F.sum("quality")).first()
        share = good / n if n and good else 1.0
    weight = F.col("log_weight") * F.least(F.lit(1.0), F.lit(float(full_length)) / F.greatest("n_grams", F.lit(1))) if full_length else F.col("log_weight")
    keyed = scored.withColumn("_key", weight + gumbel(seed, "doc_id", "t"))
    least = kth_largest(keyed, "_key", math.ceil(share * scored.count()))
    return keyed.select("doc_id", "n_grams", "log_weight", (F.col("_key") >= F.lit(least if least is not None else math.inf)).alias("kept"))


report = resample
