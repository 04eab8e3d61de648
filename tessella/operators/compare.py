"""Whether two results are equal: as bags or in order, exactly or within a tolerance; no rows come to the driver.

Exact bags: rows of one side count +1, of the other -1, and one aggregation by all columns finds what is left.
Order: a side is sorted once, into a staged table that holds each row's place, and the sides meet by place. Rows
that tie under the ORDER BY keys, where both sides name the same output columns, are peers: they share the place
of the first of them and are compared as bags, since neither side promises an order among them.
Tolerance: exact matches go first; what is left is ranked within groups of equal non-numeric cells and compared
rank by rank; what that leaves is matched greedily among the rows whose numbers are near.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.errors import AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, ParseException, SparkRuntimeException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..plans.ast import Node
from ..plans.engine import Engine
from ..plans.lexer import SqlError
from ..plans.parser import parse
from ..plans.spark_sql import Printer
from .staged import scratch, stage

# Tolerance of numeric comparisons.
REL, ABS = 1e-6, 1e-9
# Functions that are pinned to literals before two results are compared.
VOLATILE = {
    "now", "current_timestamp", "localtimestamp", "sysdate", "systimestamp", "utc_timestamp", "clock_timestamp", "statement_timestamp", "transaction_timestamp", "curdate", "current_date", "utc_date", "localtime",
}
PINNED_DATE, PINNED_TIME = "2024-01-15", "2024-01-15 12:00:00"
#: What a query itself can be at fault for. Anything else, such as a lost executor, is no finding about the query.
QUERY_FAULTS = (SqlError, AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, ParseException, SparkRuntimeException)


@dataclass
class Record:
    """What a comparison found."""

    execution: bool | None
    error: str
    ori_execution: bool | None
    ori_execution_reason: str
    formal: str
    manual: str = ""


def canonical(df: DataFrame, sort_arrays: bool = False) -> DataFrame:
    """Columns by position, cells that differ only in form made equal: maps as sorted entries, decimals as doubles; on request, arrays in order."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).select(*[_canonical(F.col(f"c{k}"), f.dataType, sort_arrays).alias(f"c{k}") for k, f in enumerate(df.schema.fields)])


def _canonical(c: Column, t: T.DataType, sort_arrays: bool = False) -> Column:
    inside = lambda x, of: _canonical(x, of, sort_arrays)
    if isinstance(t, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(inside(e["key"], t.keyType).alias("key"), inside(e["value"], t.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(t, T.ArrayType):
        cells = F.transform(c, lambda x: inside(x, t.elementType))
        return F.array_sort(cells) if sort_arrays else cells
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[inside(c[f.name], f.dataType).alias(f.name) for f in t.fields])) if t.fields else c
    if isinstance(t, (T.DecimalType, T.FloatType)):
        return c.cast("double")
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("long")
    if isinstance(t, (T.YearMonthIntervalType, T.DayTimeIntervalType, T.CalendarIntervalType, T.VariantType, T.NullType)):
        return c.cast("string")
    return c


def aligned(a: DataFrame, b: DataFrame, sort_arrays: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """Both in canonical form with common types; None if their columns don't pair up."""
    untyped = [isinstance(x.dataType, T.NullType) or isinstance(y.dataType, T.NullType) for x, y in zip(a.schema.fields, b.schema.fields, strict=False)]
    a, b = canonical(a, sort_arrays), canonical(b, sort_arrays)
    if len(a.columns) != len(b.columns):
        return None
    casts = []
    for x, y, no_type in zip(a.schema.fields, b.schema.fields, untyped, strict=True):
        if x.dataType == y.dataType:
            casts.append(None)
        elif no_type:
            casts.append("string")
        elif isinstance(x.dataType, T.NumericType) and isinstance(y.dataType, T.NumericType):
            casts.append("double")
        elif {type(x.dataType), type(y.dataType)} <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
            casts.append("timestamp_ntz")
        else:
            return None
    fit = lambda df: df.select(*[F.col(c).cast(t).alias(c) if t else F.col(c) for c, t in zip(df.columns, casts, strict=True)])
    return fit(a), fit(b)


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the surplus of a in _n (below 0 where b has more)."""
    both = a.withColumn("_n", F.lit(1)).unionAll(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).filter("_n != 0")


def placed(df: DataFrame, peers: list[str] | None = None) -> DataFrame:
    """df, in its own order, with _at from 0; rows of equal `peers` cells, which must be what df is sorted by, have the place of the first.

    The sort runs once, into a staged table with each row's number within its partition; where partitions start
    is counted from that same table.
    """
    numbered = stage(df.withColumn("_id", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_id", 33))
    starts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_from", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a partition
    out = numbered.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_from") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_from")
    if not peers:
        return out
    first = out.groupBy(*[F.col(c).alias(f"_{c}") for c in peers]).agg(F.min("_at").alias("_first"))
    key = lambda names: F.struct(*[F.col(n).alias(c) for n, c in zip(names, peers, strict=True)])
    return out.join(first, key(peers).eqNullSafe(key([f"_{c}" for c in peers]))).select(*df.columns, F.col("_first").alias("_at"))


def close(a: Column, b: Column, t: T.DataType, rel: float = REL, abs_: float = ABS) -> Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        near = F.abs(a - b) <= F.greatest(F.lit(abs_), F.greatest(F.abs(a), F.abs(b)) * rel)
        return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))
    if isinstance(t, T.ArrayType):
        inside = F.forall(F.zip_with(a, b, lambda x, y: close(x, y, t.elementType, rel, abs_)), lambda x: x)
        return a.eqNullSafe(b) | F.coalesce((F.size(a) == F.size(b)) & inside, F.lit(False))
    if isinstance(t, T.StructType):
        both = F.lit(True)
        for f in t.fields:
            both = both & close(a[f.name], b[f.name], f.dataType, rel, abs_)
        return a.eqNullSafe(b) | F.coalesce(both, F.lit(False))
    return a.eqNullSafe(b)


def sequence_mismatches(a: DataFrame, b: DataFrame, tolerant: bool) -> DataFrame:
    """Places where the sides differ, one of them may be missing."""
    x = placed(a).select("_at", F.struct(*a.columns).alias("x"))
    y = placed(b).select("_at", F.struct(*b.columns).alias("y"))
    return x.join(y, "_at", "full").filter(F.col("x").isNull() | F.col("y").isNull() | ~_alike(a, tolerant))


def _alike(a: DataFrame, tolerant: bool) -> Column:
    """Whether x and y, structs of the columns of a, are equal."""
    same = F.lit(True)
    for f in a.schema.fields:
        p, q = F.col(f"x.{f.name}"), F.col(f"y.{f.name}")
        same = same & (close(p, q, f.dataType) if tolerant else p.eqNullSafe(q))
    return same


def grid(value: Column) -> Column:
    """A cell number; values within the tolerance of each other are in the same cell or in neighbouring ones."""
    return F.floor(F.asinh(value / F.lit(ABS / REL)) / F.lit(2 * REL)).cast("long")


def tolerant_bag_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is left of two bags after exact matches, matches rank by rank, and a greedy matching of near rows: (x, y), one of them null."""
    left = stage(bag_difference(a, b), "bag-difference")
    rows = left.withColumn("_k", F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))))
    inexact = [f.name for f in a.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    exact = [c for c in a.columns if c not in inexact]
    sides = []
    for sign in (1, -1):
        side = rows.filter(F.col("_n") * sign > 0).select(*a.columns)
        if exact:
            side = side.withColumn("_at", F.row_number().over(W.partitionBy(*exact).orderBy(*inexact or exact)))
        else:
            side = placed(side.orderBy(*inexact))
        sides.append(side)
    x, y = sides
    x = x.select(F.struct(*[F.col(c) for c in [*exact, "_at"]]).alias("_key"), F.struct(*a.columns).alias("x"))
    y = y.select(F.struct(*[F.col(c) for c in [*exact, "_at"]]).alias("_key"), F.struct(*a.columns).alias("y"))
    joined = x.join(y, x["_key"].eqNullSafe(y["_key"]), "full")
    rest = stage(joined.filter(F.col("x").isNull() | F.col("y").isNull() | ~_alike(a, True)).select("x", "y"), "unmatched")
    return greedy_rest(a, rest, exact, inexact)


def greedy_rest(a: DataFrame, rest: DataFrame, exact: list[str], inexact: list[str]) -> DataFrame:
    """(x, y) of the rows in rest that no greedy matching pairs: in each round rows of x ask for their first near row of y, and those grant it to the first that asks.

    Candidates meet by their exact cells and by cells of a grid over up to three numbers, so only near rows do.
    """
    x = stage(rest.filter("x IS NOT NULL").select(F.monotonically_increasing_id().alias("i"), "x"), "unmatched-x")
    y = stage(rest.filter("y IS NOT NULL").select(F.monotonically_increasing_id().alias("j"), "y"), "unmatched-y")
    by = inexact[:3]
    if by and not x.isEmpty() and not y.isEmpty():
        key = lambda side, shift: F.struct(*[F.col(f"{side}.{c}") for c in exact], *[(grid(F.col(f"{side}.{c}")) + s).alias(f"_g{c}") for c, s in zip(by, shift, strict=True)])
        shifts = [[]]
        for _ in by:
            shifts = [[*s, d] for s in shifts for d in (-1, 0, 1)]
        asked = x.withColumn("_key", F.explode(F.array_distinct(F.array(*[key("x", s) for s in shifts]))))
        offered = y.withColumn("_key", key("y", [0] * len(by)))
        edges = stage(asked.join(offered, asked["_key"].eqNullSafe(offered["_key"])).filter(_alike(a, True)).select("i", "j").distinct(), "near-rows")
        while not edges.isEmpty():
            asks = edges.groupBy("i").agg(F.min("j").alias("j"))
            pairs = stage(asks.groupBy("j").agg(F.min("i").alias("i")), "granted")
            x, y = x.join(pairs.select("i"), "i", "left_anti"), y.join(pairs.select("j"), "j", "left_anti")
            edges = stage(edges.join(pairs.select("i"), "i", "left_anti").join(pairs.select("j"), "j", "left_anti"), "near-rows")
        x, y = stage(x, "unmatched-x"), stage(y, "unmatched-y")
    none = lambda name: F.lit(None).cast(rest.schema[name].dataType).alias(name)
    return x.select("x", none("y")).unionByName(y.select(none("x"), "y"))


def mismatches(a: DataFrame, b: DataFrame, ordered: bool = False, tolerant: bool = True, peers: list[int] | None = None) -> int | None:
    """The number of rows or places that differ; None if the columns don't pair up.

    Ordered results are compared place by place; with peers, positions of the columns that both are sorted by,
    rows that tie under them are compared as bags. Unordered tolerant comparison takes arrays within cells as bags.
    """
    both = aligned(a, b, sort_arrays=tolerant and not ordered)
    if both is None:
        return None
    with scratch():
        if ordered and not peers:
            return sequence_mismatches(*both, tolerant).count()
        if ordered:
            both = tuple(placed(d, [d.columns[p] for p in peers]).withColumnRenamed("_at", "place") for d in both)
        if tolerant:
            left = tolerant_bag_mismatches(*both).agg(F.count("x").alias("x"), F.count("y").alias("y")).first()
            return max(left["x"], left["y"])  # a changed row is one mismatch, not two
        return bag_difference(*both).agg(F.coalesce(F.sum(F.abs("_n")), F.lit(0))).first()[0]


def pin_volatile(sql: str, dialect: str) -> Node:
    """The query with functions of the current time as literals."""

    def pin(n: Node) -> Node:
        name = n.name if n.kind == "call" else n.parts["parts"][-1].text if n.kind == "column" and len(n.parts["parts"]) == 1 and not n.parts["parts"][-1].quoted else None
        if isinstance(name, str) and name.lower() in VOLATILE and not n.get("args"):
            dated = name.lower() in ("curdate", "current_date", "utc_date")
            return Node("typed", type="DATE" if dated else "TIMESTAMP", text=PINNED_DATE if dated else PINNED_TIME)
        return n

    return parse(sql, dialect).map(pin)


def has_outer_order(q: Node) -> bool:
    """Whether the final result has an order."""
    while q.kind == "query":
        if q.order:
            return True
        q = q.body
    return False


def order_positions(q: Node) -> list[int] | None:
    """Positions of the result's columns that the final ORDER BY names, by number or by output name; None if it names anything else."""
    while not q.order:
        q = q.body
    top = q.body
    while top.kind in ("query", "setop"):
        top = top.left if top.kind == "setop" else top.body
    if top.kind != "select" or any(i.kind != "item" for i in top.items):
        return None
    names = [i.alias.text.lower() if i.get("alias") is not None else i.expr.parts["parts"][-1].text.lower() if i.expr.kind == "column" else None for i in top.items]
    out = []
    for o in q.order:
        e = o.expr
        if e.kind == "number" and e.text.isdigit() and 1 <= int(e.text) <= len(names):
            out.append(int(e.text) - 1)
        elif e.kind == "column" and len(e.parts["parts"]) == 1 and names.count(e.parts["parts"][0].text.lower()) == 1:
            out.append(names.index(e.parts["parts"][0].text.lower()))
        else:
            same = [k for k, i in enumerate(top.items) if i.expr == e]
            if len(same) != 1:
                return None
            out += same
    return out


def verify(engine: Engine, sql1: str, dialect1: str, sql2: str, dialect2: str) -> Record:
    """Run both and compare: exactly and within the tolerance, in order if both results have one; equal plans are a proof.

    A query that can't be read, planned or evaluated is a finding. Faults of the cluster are raised.
    """
    frames, trees = [], []
    for sql, dialect in ((sql1, dialect1), (sql2, dialect2)):
        try:
            tree = pin_volatile(sql, dialect)
            frames.append(engine.run_spark_sql(Printer(dialect, engine.catalog(sql, dialect)).query(tree)))
            trees.append(tree)
        except QUERY_FAULTS as e:
            return Record(None, f"{dialect}: {_first_line(e)}", None, "", "UNKNOWN")
    a, b = frames
    ordered = all(map(has_outer_order, trees))
    keys = [order_positions(t) for t in trees] if ordered else [None, None]
    peers = keys[0] if keys[0] is not None and set(keys[0]) == set(keys[1] or []) else None
    formal = "EQ" if a.sameSemantics(b) else "UNKNOWN"
    try:
        exact = mismatches(a, b, ordered, tolerant=False, peers=peers)
        loose = exact if exact == 0 else mismatches(a, b, ordered, tolerant=True, peers=peers)
        empty = exact == 0 and a.isEmpty()
    except QUERY_FAULTS as e:
        return Record(None, _first_line(e), None, "", formal)
    reason = "columns differ" if exact is None else "" if exact == 0 else f"{exact} rows differ"
    return Record(loose == 0, "", exact == 0, "No result" if empty else reason, formal)


def _first_line(e: Exception) -> str:
    return (str(e).splitlines() or [type(e).__name__])[0]


def verify_many(engine: Engine, pairs: list[tuple[str, str, str, str]]) -> list[str]:
    """For each pair (sql1, dialect1, sql2, dialect2): EQ where both have one plan, UNKNOWN where that can't be told, ERROR where one can't be planned. Nothing is executed."""
    out = []
    for sql1, dialect1, sql2, dialect2 in pairs:
        try:
            a, b = engine.run(sql1, dialect1), engine.run(sql2, dialect2)
            out.append("EQ" if a.sameSemantics(b) else "UNKNOWN")
        except QUERY_FAULTS:
            out.append("ERROR")
    return out


def verify_row(engine: Engine, *args: str) -> DataFrame:
    return engine.spark.createDataFrame([tuple(asdict(verify(engine, *args)).values())], "execution boolean, error string, ori_execution boolean, ori_execution_reason string, formal string, manual string")
