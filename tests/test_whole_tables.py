"""Queries that once read only small ids, against brute force on rows of all ids."""

import datetime
import json
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tessella.plans.engine import Engine

N = 900
PRIORITIES, STATES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], ["F", "O", "P"]
CUSTOMERS = [(k, f"c{k}", k % 7 if k < 400 else k % 11, float(k)) for k in range(N)]
SUPPLIERS = [(k if k < 60 else 5000 + k, k % 13) for k in range(90)]
ORDERS = [(k, k * 7 % (N - 50), STATES[k % 5 % 3], PRIORITIES[k % 7 % 4], 200_000.0 + k * 613 % 300_000, datetime.date(1995 + k % 3, 1 + k % 12, 1 + k % 28)) for k in range(2 * N)]
ORDERS += [(2 * N + k, 860, STATES[k % 3], PRIORITIES[k % 4], 250_000.0, datetime.date(1996, 1, 1)) for k in range(8)]  # a late customer covers most
ITEMS = [(k // 2, k % 2, k * 3 % 50, k % 11 / 100, k % 9 / 100) for k in range(2 * N)]
NATIONS = [(k, f"n{k}") for k in range(5)]
PARTS = [(k, f"b{k % 5}") for k in range(N)]
EVENTS = [(k, json.dumps({"k": k * 31 % 100})) for k in range(N)]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    con = duckdb.connect()
    for name, ddl, rows in (
        ("customer", "c_custkey BIGINT, c_name VARCHAR, c_nationkey INT, c_acctbal DOUBLE", CUSTOMERS),
        ("supplier", "s_suppkey BIGINT, s_nationkey INT", SUPPLIERS),
        ("orders", "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_orderpriority VARCHAR, o_totalprice DOUBLE, o_orderdate DATE", ORDERS),
        ("lineitem", "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_discount DOUBLE, l_tax DOUBLE", ITEMS),
        ("nation", "n_nationkey INT, n_name VARCHAR", NATIONS),
        ("part", "p_partkey BIGINT, p_brand VARCHAR", PARTS),
        ("events", "event_id BIGINT, props VARCHAR", EVENTS),
    ):
        con.execute(f"CREATE TABLE {name} ({ddl})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{d}/{name}.parquet'")
    return str(d)


def got(spark, small, name):
    return [tuple(r) for r in __spark_entry__.queries()[name](spark, small).collect()]


def test_filters_and_joins(spark, small):
    assert Counter(got(spark, small, "is_distinct")) == Counter((k,) for k, _, _, p, *_ in ORDERS if p != "2-HIGH")
    c, s = {x[0] for x in CUSTOMERS}, {x[0] for x in SUPPLIERS}
    assert s - c and c - s
    assert Counter(got(spark, small, "join_full")) == Counter((k if k in c else None, k if k in s else None) for k in c | s)
    high = {k: [o for o, x, _, _, p, _ in ORDERS if x == k and p > 300_000] for k in c}
    assert Counter(got(spark, small, "outer_join_sign")) == Counter((k, o) for k in c for o in high[k] or [None])


def test_pivots(spark, small):
    n = Counter((k, s) for _, k, s, *_ in ORDERS)
    assert Counter(got(spark, small, "pivot_status")) == Counter((k, *(n[k, s] or None for s in STATES)) for k in {o[1] for o in ORDERS})
    want = [(*i[:3], what, v) for i in ITEMS for what, v in (("discount", i[3]), ("tax", i[4]))]
    assert Counter(got(spark, small, "unpivot_prices")) == Counter(want)


def test_set_operations(spark, small):
    a, b = Counter((x[2],) for x in CUSTOMERS), Counter((x[1],) for x in SUPPLIERS)
    want = {"union_distinct": set(a) | set(b), "union_all": a + b, "intersect_distinct": set(a) & set(b), "intersect_all": a & b, "except_distinct": set(a) - set(b), "except_all": a - b}
    for name, rows in want.items():
        assert Counter(got(spark, small, name)) == Counter(rows), name


def test_json_changes(spark, small):
    want = {k: ({"k": 1, "z": "y"}, {}, json.loads(p) | {"q": [1, 2]}, 2) for k, p in EVENTS}
    assert {k: (*map(json.loads, x[:3]), x[3]) for k, *x in got(spark, small, "json_mutation")} == want


def test_trees(spark, small):
    below = {k: [c for c in range(N) if c // 3 == k and c > 0] for k in range(N)}

    def walk(k, lvl, up, path):
        path = f"{path}/{k}"
        yield k, lvl, path, up, not below[k]
        for c in below[k]:
            yield from walk(c, lvl + 1, k, path)

    want = list(walk(0, 1, None, ""))
    assert len(want) == N
    assert Counter((int(i), lvl, int(root), path, None if up is None else int(up), bool(leaf)) for i, lvl, root, path, up, leaf in got(spark, small, "connect_by")) == Counter((k, lvl, 0, path, up, leaf) for k, lvl, path, up, leaf in want)
    assert dict(got(spark, small, "cte_tree")) == Counter(lvl for _, lvl, *_ in want)
    assert [(int(i), lvl) for i, lvl in got(spark, small, "siblings_order")] == [(k, lvl) for k, lvl, *_ in walk(1, 1, None, "")]


def test_set_cover_of_all_customers(spark, small):
    points, left, want = {}, {f"{o[3]}|{o[2]}" for o in ORDERS}, []
    for o in ORDERS:
        points.setdefault(o[1], set()).add(f"{o[3]}|{o[2]}")
    while left:
        want.append(min(points, key=lambda k: (-len(points[k] & left), k)))
        left -= points[want[-1]]
    assert len(want) > 1 and max(want) >= 200
    assert sorted(got(spark, small, "setcover_greedy")) == list(enumerate(want))


def test_rewritten_query_and_merge(spark, small):
    assert Counter(got(spark, small, "rewritten_query")) == Counter((o[1], "none" if o[3] == "5-LOW" else o[3], f"{o[5]:%Y-%m}") for o in ORDERS)
    assert Counter(got(spark, small, "merge_align")) == Counter([(*n, None) for n in NATIONS] + [(c[0], c[1], c[3]) for c in CUSTOMERS])


@pytest.fixture
def short_recursion(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    yield
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_connect_by_over_more_rows_than_spark_allows_a_recursion(spark, small, short_recursion):
    assert sorted(int(r[0]) for r in got(spark, small, "connect_by")) == list(range(N))


def test_recursive_cte_over_more_rows_than_spark_allows_a_recursion(spark, small, short_recursion):
    assert sum(n for _, n in got(spark, small, "cte_tree")) == N


def test_stream_of_unique_rows_stays_out_of_the_driver(spark, sf):
    assert got(spark, sf, "stream_unique") == [(spark.read.parquet(f"{sf}/events.parquet").count(),)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("unique_")]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o.o_orderkey LIMIT 1) t",
        "SELECT c.c_custkey, (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o.o_orderkey LIMIT 1) AS o_orderkey FROM customer c",
    ],
)
def test_correlated_limit_ranks_by_its_order(spark, small, text):
    """A sort key that isn't selected must reach the window by which Spark takes the first rows of each outer row."""
    df = Engine(spark, small).run(text, "pg")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(o_custkey#\d+L?, _o0#\d+ DESC", plan), plan
    first = {}
    for o in sorted(ORDERS, key=lambda o: (-o[4], o[0])):
        first.setdefault(o[1], o[0])
    assert {r[0]: r[1] for r in df.collect() if r[1] is not None} == {k: v for k, v in first.items() if k < N}
