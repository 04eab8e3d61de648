"""A corpus pipeline of five stages; counted as part of tessella.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs,
whatever other columns are called. A stage's result is written to the cluster's shared folder and read again as
the next one's docs. An empty table gives no rows at any stage; repeated rows fare alike, and so stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from tessella.llm.common import free_name, scratch, stage, table, unstage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts have too few words and go."""
    return quality_rules.kept(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand earlier, n_chars with them; documents of which no word is left go. Null and empty texts lose nothing and stay; a null id comes after all others."""
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    out, dropped = line_dedup.dedup(docs, n_lines, n_dropped), F.col(n_dropped) > 0
    left = ~dropped | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    n_chars = F.when(dropped, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.filter(left).withColumn("n_chars", n_chars).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more, the smallest id, with every row of it. Null and empty texts are near nothing and stay; rows of a null id go only where they are near a document with one."""
    return ngram_join.one_of_each(docs, 5, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts have none, and an empty benchmark none for anyone."""
    name = free_name(docs, "found")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"), name=name)
    return found.filter(F.size(F.col(name)["hits"]) == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left and their places in sequences of 2048 tokens; null and empty texts are one piece of the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: Tokenizing and expectation-maximisation can't be put in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before kept; a stage's own tables go once its result is written, and its docs once the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        with scratch():
            out = stage(f(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
        if hasattr(docs, "staged_at"):
            unstage(docs)
        docs = out
    return docs
