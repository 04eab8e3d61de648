"""Every query of the function and library modules against DuckDB."""

import duckdb
import pytest

import __spark_entry__
from tessella.plans import function_queries, library_queries, operator_queries
from tessella.plans.engine import TABLES

LIBRARY = [n for n, f in vars(library_queries).items() if n in operator_queries.QUERIES and getattr(f, "__module__", "") == library_queries.__name__]


def plain(v):
    """Values as the driver compares them, but for the last digits of numbers."""
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [*function_queries.Q, *LIBRARY, "verify_ordered_large", "cosine_topk", "range_join", "fetch_percent", "with_ties"])
def test_against_duckdb(spark, sf, duck, name):
    df = __spark_entry__.queries()[name](spark, sf)
    ref = duck.execute(__spark_entry__.oracle_sql()[name])
    names, want = [d[0] for d in ref.description], ref.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want), key=str)
