"""Types found from data, and data held against types and constraints; one aggregation a table, however many columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import Table

#: Types tried in this order when the declared one doesn't fit; text fits always.
CASCADE = ["int", "double", "date", "timestamp_ntz", "string"]
TRUE, FALSE = ("1", "true"), ("0", "false")


def readable(c: Column, t: str, values: list[str] = ()) -> Column:
    """Whether a text can be read as t; an empty text is null and fits everything."""
    c = F.nullif(c, F.lit(""))
    if t == "string":
        ok = c.isin(*values) if values else F.lit(True)
    elif t == "boolean":
        ok = F.lower(c).isin(*TRUE, *FALSE)
    elif t in ("int", "bigint"):
        ok = c.rlike(r"^\s*[+-]?[0-9]+\s*$") & c.try_cast(t).isNotNull()
    elif t == "date":
        ok = c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & c.try_cast("date").isNotNull()
    else:
        ok = c.try_cast(t).isNotNull()
    return c.isNull() | F.coalesce(ok, F.lit(False))


def revise(df: DataFrame, declared: dict[str, str], enums: dict[str, list[str]] | None = None) -> dict[str, str]:
    """The type of each column of text: the declared one if all values fit, else the first of the cascade that does."""
    enums = enums or {}
    tries = {c: list(dict.fromkeys([t, *CASCADE])) for c, t in declared.items()}
    counts = df.agg(*[F.count_if(~readable(F.col(c), t, enums.get(c, []) if t == declared[c] else [])).alias(f"{c}|{t}") for c, ts in tries.items() for t in ts]).first().asDict()
    return {c: next(t for t in ts if counts[f"{c}|{t}"] == 0) for c, ts in tries.items()}


def value_errors(df: DataFrame, declared: dict[str, str], enums: dict[str, list[str]] | None = None, lengths: dict[str, int] | None = None) -> DataFrame:
    """(column, bad, longest): values that can't be read, and the longest text."""
    enums, lengths = enums or {}, lengths or {}
    stats = df.agg(*[x for c, t in declared.items() for x in (F.count_if(~readable(F.col(c), t, enums.get(c, [])) | (F.length(c) > lengths.get(c, 2**31 - 1))).alias(f"{c}|bad"), F.max(F.length(c)).alias(f"{c}|longest"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}|bad`").alias("bad"), F.col(f"`{c}|longest`").alias("longest")) for c in declared])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns of text as these types; an empty text is null; 1, 0, true and false are truth values."""

    def one(c: str, t: str) -> Column:
        x = F.nullif(F.col(c), F.lit(""))
        return F.when(F.lower(x).isin(*TRUE), True).when(F.lower(x).isin(*FALSE), False).alias(c) if t == "boolean" else x.try_cast(t).alias(c)

    return df.select(*[one(c, types[c]) if c in types else F.col(c) for c in df.columns])


def primary_key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once or hold a null, with their number of rows."""
    has_null = F.lit(False)
    for c in key:
        has_null = has_null | F.col(c).isNull()
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | has_null)


def foreign_key_violations(df: DataFrame, cols: list[str], other: DataFrame, ref: list[str]) -> DataFrame:
    """Rows whose key, if it holds no null, isn't in the other table."""
    there = other.select(*[F.col(r).alias(f"_r{k}") for k, r in enumerate(ref)]).distinct()
    on = [F.col(c) == F.col(f"_r{k}") for k, c in enumerate(cols)]
    return df.dropna(subset=cols).join(there, on, "left_anti")


def enum_violations(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def shorten(name: str, most: int = 30) -> str:
    """An identifier cut to a length, each of its parts in proportion."""
    if len(name) <= most:
        return name
    parts = name.split("_")
    room = most - (len(parts) - 1)
    total = sum(map(len, parts))
    sizes = [max(1, len(p) * room // total) for p in parts]
    return "_".join(p[:n] for p, n in zip(parts, sizes, strict=True))[:most]


def catalog_frame(spark: SparkSession, tables: list[Table]) -> DataFrame:
    """(table, column, type, nullable) of declared tables."""
    return spark.createDataFrame([(t.name.lower(), c.name.lower(), c.type, c.nullable) for t in tables for c in t.columns], "table string, column string, type string, nullable boolean")


def schema_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that only one catalog has, or that differ in type."""
    x = a.select("table", "column", F.col("type").alias("left"))
    y = b.select("table", "column", F.col("type").alias("right"))
    return x.join(y, ["table", "column"], "full").filter(~F.col("left").eqNullSafe(F.col("right")))


def type_census(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def neighbours(spark: SparkSession, tables: list[Table]) -> DataFrame:
    """(table, other) for tables that refer to each other, both ways."""
    edges = spark.createDataFrame([(t.name, to) for t in tables for _, to, _ in t.foreign_keys], "table string, other string")
    return edges.union(edges.select("other", "table")).distinct()
