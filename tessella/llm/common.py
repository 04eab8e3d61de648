"""What the operators share: the shared folder, staged tables, let-bindings and slot numbers.

Everything that outlives one stage goes to the folder that the cluster names in
``spark.checkpoint.dir``; executors can be lost at any time and a staged table is still there.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staged import scratch, shared_dir, stage, unstage  # noqa: F401  the operators use them from here

#: The white space that every contract here names: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A null id sorts after every other id.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df has not, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    name = f"_{wish}"
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are out of use, before the next plan writes its own."""
    gc.collect()
    spark._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it (lambdas would repeat it for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: A key that holds more than one in so many of all rows is hot; there are at most so many of them.
HOT_ONE_IN = 2000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row for each key and in `times` how many of the `total` rows have it.

    Hot keys, HOT_ONE_IN of them at most, are broadcast, so their rows stay where they are; the others meet by
    merge. Both should be cheap to read twice. The column `times` goes.
    """
    hot = F.broadcast(keyed.filter(F.col(times) * HOT_ONE_IN > total).drop(times))
    rest = rows.join(hot.select(*on), on, "left_anti").join(keyed.filter(F.col(times) * HOT_ONE_IN <= total).drop(times).hint("merge"), on)
    return rows.join(hot, on).unionByName(rest)


def number_slots(df: DataFrame, key: str, order: list[str], out: str, rows_a_slice: int = 50_000, least_slices: int = 16) -> DataFrame:
    """Add out: gapless numbers from 0 within each key, with no task that sees all rows of a key.

    Rows of a key are cut into slices by a hash of the order columns; a slice's numbers start where the
    counts of the slices before it end. df should be a staged table, since it is read three times; order should end
    with a column that tells equal rows apart, or all rows of one kind are one slice.
    """
    rows = df.count()
    slices = max(least_slices, -(-rows // rows_a_slice))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = cut.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = W.partitionBy(key, "_slice").orderBy(*order)
    return (
        cut.withColumn("_at", F.row_number().over(within) - 1)
        .join(starts, [key, "_slice"])
        .withColumn(out, (F.col("_from") + F.col("_at")).cast("long"))
        .drop("_slice", "_at", "_from")
    )
