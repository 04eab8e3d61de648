"""Query composition: sampled values, aligned and merged queries, padding, pairs and covers; all seeded."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analysis import has_limit_or_order, token_count
from .engine import Engine
from .lexer import SqlError
from .parser import parse
from .rules import Rewriter, Rule

FILLERS = {"num": 0.0, "str": "", "date": "1970-01-01"}


def family(t: T.DataType) -> str:
    if isinstance(t, T.NumericType) or isinstance(t, T.BooleanType):
        return "num"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "str"


def modal_value(df: DataFrame, column: str):
    """The most common value, the smallest of equally common ones; None without values."""
    row = df.dropna(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(1).collect()
    return row[0][column] if row else None


def sample_values(df: DataFrame, column: str, k: int, seed: int) -> list:
    """k distinct values, the same for the same seed."""
    rows = df.select(column).distinct().orderBy(F.xxhash64(column, F.lit(seed)), column).limit(k).collect()
    return [r[0] for r in rows]


def align(first: DataFrame, second: DataFrame, drop_rest: bool = False) -> tuple[DataFrame, DataFrame]:
    """second with the columns of first in its order: of each type family in turn, typed nulls where none is left; what remains of second is added to first as nulls, or dropped."""
    left = [(c, family(second.schema[c].dataType)) for c in second.columns]
    picked, names = [], []
    for f in first.schema.fields:
        hit = next((x for x in left if x[1] == family(f.dataType)), None)
        if hit:
            left.remove(hit)
        picked.append((F.col(hit[0]).cast(f.dataType) if hit else F.lit(None).cast(f.dataType)).alias(f.name))
        names.append(f.name)
    if drop_rest or not left:
        return first, second.select(*picked)
    more = [(c, f"{c}_2" if c in names else c) for c, _ in left]
    return first.select("*", *[F.lit(None).cast(second.schema[c].dataType).alias(n) for c, n in more]), second.select(*picked, *[F.col(c).alias(n) for c, n in more])


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """UNION ALL of two results of any columns."""
    a, b = align(first, second)
    return a.unionAll(b)


def merge_sql(sql1: str, sql2: str, dialect: str) -> str:
    """UNION ALL of two texts of as many columns; bodies with an order or limit go into derived tables."""
    parts = []
    for k, sql in enumerate((sql1, sql2)):
        wrap = has_limit_or_order(parse(sql, dialect)) or bool(parse(sql, dialect).ctes)
        parts.append(f"SELECT * FROM ({sql}) cte{k}" if wrap else sql)
    return " UNION ALL ".join(parts)


def pad(sql: str, fillers: list[str], dialect: str, more: int, slack: int = 10) -> str:
    """sql with fillers united until it has `more` tokens above its own, give or take the slack; the nearest that can be had."""
    base, out = token_count(sql, dialect), sql
    for filler in sorted(fillers, key=lambda f: -token_count(f, dialect)):
        while token_count(merged := merge_sql(out, filler, dialect), dialect) <= base + more + slack:
            out = merged
    return out


def pairs(engine: Engine, corpus: list[str], rules: list[Rule], source: str, target: str, n: int, seed: int, catalog=None) -> list[dict]:
    """n query pairs: texts of the corpus that some rule changes and that both compile, with the rules applied."""
    rng = random.Random(seed)
    out: list[dict] = []
    texts = list(corpus)
    rng.shuffle(texts)
    for sql in texts:
        if len(out) == n:
            break
        r = Rewriter(rules, source, target, catalog or engine.catalog(sql, source))
        try:
            new = r.rewrite(sql)
        except SqlError:
            continue
        if r.applied and engine.compiles(sql, source)[0] and engine.compiles(new, target)[0]:
            out.append({source: sql, target: new, "points": [{"point": p, "num": k} for p, k in r.applied.items()], "tokens": token_count(sql, source), "rewrite_tokens": r.rewritten})
    return out


def minimal_cover(rows: list[tuple[str, set]]) -> list[str]:
    """Names whose sets cover all elements, most newly covered first; ties by name."""
    left = set().union(*[s for _, s in rows]) if rows else set()
    chosen = []
    while left:
        name, s = min(rows, key=lambda r: (-len(r[1] & left), r[0]))
        chosen.append(name)
        left -= s
    return chosen


def retry(f: Callable[[random.Random], object], ok: Callable[[object], bool], seed: int, times: int = 20):
    """The first of f's results that is ok, by a seeded generator; None after so many tries."""
    rng = random.Random(seed)
    return next((x for x in (f(rng) for _ in range(times)) if ok(x)), None)
