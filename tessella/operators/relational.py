"""Operators of the dialects as DataFrame functions, for use without SQL text."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def with_ties(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows and those that tie with the last; Spark cuts ranks beyond n before the shuffle."""
    ranked = df.withColumn("_rank", F.rank().over(W.orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def fetch_percent(df: DataFrame, percent: float, order: list[Column]) -> DataFrame:
    """The first percent of the rows by order: their number is counted, and the rest is a top-n."""
    return df.orderBy(*order).limit(-int(-df.count() * percent // 100))


def groups_frame(df: DataFrame, by: list[str], order: str, low: int, high: int, aggregates: dict[str, Column]) -> DataFrame:
    """A GROUPS frame: peers get a dense rank, and the frame is a range over the ranks."""
    ranked = df.withColumn("_peer", F.dense_rank().over(W.partitionBy(*by).orderBy(order)))
    frame = W.partitionBy(*by).orderBy("_peer").rangeBetween(low, high)
    return ranked.select("*", *[a.over(frame).alias(name) for name, a in aggregates.items()]).drop("_peer")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them, joined by key: a range of any width takes two cells at most.

    Cells of level n are width * 2 ** n wide; a range goes by the level whose cells are about its size, and points
    have one cell on each level that ranges have. Ranges that are null or empty hold nothing.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(high) - F.col(low)) / F.lit(width)))).cast("int")
    leveled = ranges.filter(F.col(low) < F.col(high)).withColumn("_level", level)
    levels = sorted(r[0] for r in leveled.select("_level").distinct().collect())  # numbers of doublings, so few
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    cut = leveled.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    spread = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", cell(at))
    return spread.join(cut, ["_level", "_cell"]).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_level", "_cell")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, value: list[str]) -> DataFrame:
    """Each left row with the latest right row of the same key at or before it: one union and one window, no range join."""
    a = left.select("*", F.lit(None).cast(right.select(F.struct(on, *value).alias("r")).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in by or c == on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.struct(on, *value).alias("_r"), F.lit(0).alias("_side"))
    latest = F.last("_r", ignorenulls=True).over(W.partitionBy(*by).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0))
    return a.unionByName(b).withColumn("_r", latest).filter("_side = 1").select(*left.columns, F.col(f"_r.{on}").alias(f"{on}_right"), *[F.col(f"_r.{v}").alias(v) for v in value])


def partitioned_outer_join(facts: DataFrame, dimension: DataFrame, partition: list[str], on: list[str]) -> DataFrame:
    """Each partition of facts with all rows of dimension. dimension is broadcast by Spark only while it is small."""
    parts = facts.select(*partition).distinct()
    return parts.join(dimension, how="cross").join(facts, [*partition, *on], "left")


def multiset(a: Column, b: Column, op: str, all_: bool = True) -> Column:
    """MULTISET UNION, INTERSECT and EXCEPT of two arrays; with ALL, an element's number of times counts."""
    if op == "UNION":
        return F.concat(a, b) if all_ else F.array_union(a, b)
    if not all_:
        return F.array_intersect(a, b) if op == "INTERSECT" else F.array_except(a, b)
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    nth = lambda x, i: F.size(F.filter(F.slice(a, 1, i + 1), lambda y: y == x))
    return F.filter(a, lambda x, i: (nth(x, i) <= times(b, x)) if op == "INTERSECT" else (nth(x, i) > times(b, x)))


#: Queries and vectors in one cell of a search.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 16_384


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, id_: str, vector: str, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """For each query the k vectors of largest cosine similarity, ties by id: (q, v, sim, rank), a stated set of queries against all rows.

    Both sides are dealt to blocks by id, and each pair of blocks is a cell: a matrix product in one task, of which
    only the best k for each query go on. The plan is the same for any number of blocks. A query isn't its own
    neighbour; null vectors take no part; a vector of zeros has similarity 0 to all.
    """
    q = queries.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("x")).filter("x IS NOT NULL")
    v = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("x")).filter("x IS NOT NULL")
    n_q, n_v = max(1, -(-q.count() // query_block)), max(1, -(-v.count() // vector_block))
    dealt = lambda df, n, own, other, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    kind = queries.schema[id_].dataType.simpleString()

    def best(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": left.column("id").slice(0, 0), "v": right.column("id").slice(0, 0), "sim": pa.array([], pa.float64())})
        a, b = (np.array(t.column("x").to_pylist(), dtype=float) for t in (left, right))
        size = lambda m: np.sqrt(np.add.accumulate(m * m, axis=1)[:, -1])  # noqa: E731  in the order of the cells, so that equal vectors are equal here too
        size_a, size_b = size(a), size(b)
        near = (a / np.where(size_a > 0, size_a, 1)[:, None]) @ (b / np.where(size_b > 0, size_b, 1)[:, None]).T
        cut = min(k + 1, near.shape[1])  # one more, as a query may be among its own
        least = np.partition(near, near.shape[1] - cut, axis=1)[:, near.shape[1] - cut]
        at_a, at_b = np.nonzero(near >= least[:, None] - 1e-9)
        dot = np.add.accumulate(a[at_a] * b[at_b], axis=1)[:, -1] if len(at_a) else np.zeros(0)
        both = size_a[at_a] * size_b[at_b]
        sim = np.where(both > 0, dot / np.where(both > 0, both, 1), 0.0)
        return pa.table({"q": left.column("id").take(pa.array(at_a)), "v": right.column("id").take(pa.array(at_b)), "sim": pa.array(sim)})

    cells = dealt(q, n_q, "qb", "vb", n_v).groupBy("qb", "vb").cogroup(dealt(v, n_v, "vb", "qb", n_q).groupBy("qb", "vb"))
    found = cells.applyInArrow(best, f"q {kind}, v {kind}, sim double").filter("q != v")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "v"))).filter(F.col("rank") <= k)


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], delete: Column | None = None) -> DataFrame:
    """MERGE: matched rows take the source's values (or go, where delete holds), others of source are added."""
    t, s = target.withColumn("_t", F.lit(True)), source.withColumn("_s", F.lit(True))
    joined = t.alias("t").join(s.alias("s"), keys, "full")
    if delete is not None:
        joined = joined.filter(~F.coalesce(F.col("_s") & delete, F.lit(False)))
    rest = [c for c in target.columns if c not in keys]
    return joined.select(*keys, *[F.when(F.col("_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in rest])


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE as a new table; all values are taken from the old one."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def best_per_key(df: DataFrame, key: list[str], score: list[Column]) -> DataFrame:
    return distinct_on(df, key, score)


def greedy_set_cover(pairs: DataFrame, item: str, element: str) -> list:
    """Items, most newly covered elements first, until all elements are covered; ties by the smaller item.

    Each round is one aggregation and takes one row to the driver.
    """
    chosen, left = [], pairs.select(item, element).distinct()
    while True:
        best = left.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), item).limit(1).collect()
        if not best:
            return chosen
        chosen.append(best[0][item])
        covered = pairs.filter(F.col(item).isin(chosen)).select(element).distinct()
        left = pairs.select(item, element).distinct().join(covered, element, "left_anti")



def aggregate(df: DataFrame, by: list[str], column: str, first: Callable, merge: Callable, last: Callable, name: str) -> DataFrame:
    """A user's aggregate of doubles: first(series) makes a state of the rows at hand, merge(a, b) joins two, last(state) is the result.

    States are made batch by batch where the rows are, so a group of any size meets as states and not as rows. Nulls don't count.
    """
    keys = df.select(*by).schema

    def states(frames):
        for frame in frames:
            some = frame.dropna(subset=[column])
            rows = [(*(k if isinstance(k, tuple) else (k,)), pickle.dumps(first(g[column]))) for k, g in some.groupby(by, dropna=False)]
            yield pd.DataFrame(rows, columns=[*by, "_state"])

    def joined(frame):
        state = reduce(merge, map(pickle.loads, frame["_state"]))
        return pd.DataFrame([(*frame[by].iloc[0], last(state))], columns=[*by, name])

    partial = df.select(*by, F.col(column).cast("double").alias(column)).mapInPandas(states, keys.add("_state", "binary"))
    return partial.groupBy(*by).applyInPandas(joined, df.select(*by).schema.add(name, "double"))
