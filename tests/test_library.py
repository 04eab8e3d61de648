"""Verifier, readers, revision, rules, generation, analysis and streams on small data."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions.formats import interval_parts, java_pattern
from tessella.operators import compare, relational, vectors
from tessella.plans import analysis, compose, generate, rule_functions, rules, segments
from tessella.plans.engine import Engine
from tessella.plans.lexer import SqlError
from tessella.plans.parser import parse
from tessella.sources import readers, revision
from tessella.streaming import windows


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# verifier


@pytest.mark.parametrize(
    ("a", "b", "exact", "loose"),
    [
        ([(1, 1.0), (2, 2.0)], [(2, 2.0), (1, 1.0)], 0, 0),
        ([(1, 1.0)], [(1, 1.0 + 1e-8)], 2, 0),
        ([(1, 1.0)], [(1, 1.1)], 2, 1),
        ([(1, 1.0), (1, 1.0)], [(1, 1.0)], 1, 1),
        ([(1, None)], [(1, None)], 0, 0),
        ([(1, float("nan"))], [(1, float("nan"))], 0, 0),
        ([(1, 0.0)], [(1, -0.0)], 0, 0),
        ([], [], 0, 0),
        ([(1, 1.0), (1, 2.0)], [(1, 2.0 + 1e-9), (1, 1.0 - 1e-9)], 4, 0),
    ],
)
def test_bags(spark, a, b, exact, loose):
    x, y = frame(spark, a, "k int, v double"), frame(spark, b, "k long, v double")
    assert compare.mismatches(x, y, tolerant=False) == exact
    assert compare.mismatches(x, y, tolerant=True) == loose


def test_sequences(spark):
    x = frame(spark, [(k, float(k)) for k in range(100)], "k int, v double")
    assert compare.mismatches(x.orderBy("k"), x.orderBy("v"), ordered=True, tolerant=False) == 0
    assert compare.mismatches(x.orderBy("k"), x.orderBy(F.desc("k")), ordered=True, tolerant=False) == 100
    assert compare.mismatches(x.orderBy("k"), x.filter("k < 99").orderBy("k"), ordered=True) == 1
    assert compare.mismatches(x, x.select("k")) is None


def test_nested_cells(spark):
    x = spark.sql("SELECT map('a', 1, 'b', 2) AS m, array(1.0D, 2.0D) AS a")
    y = spark.sql("SELECT map('b', 2, 'a', 1) AS m, array(1.0D, 2.0D) AS a")
    assert compare.mismatches(x, y, tolerant=False) == 0


@pytest.mark.parametrize("partitions", [2, 8, 200])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ordered_comparison_over_partitions(spark, partitions, adaptive):
    """Places hold whatever the number of partitions; a change that only one row has is one place, and two swapped rows are two."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        e = Engine(spark, "/root/testdata/sf0.01")
        plain = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey"
        r = compare.verify(e, plain, "pg", plain.replace("ORDER", "WHERE o_totalprice >= 0 ORDER"), "mysql")
        assert (r.execution, r.ori_execution, r.ori_execution_reason) == (True, True, "")
        one = plain.replace("o_totalprice FROM", "CASE WHEN o_orderkey = 777 THEN -1 ELSE o_totalprice END AS o_totalprice FROM")
        assert compare.mismatches(e.run(plain, "pg"), e.run(one, "pg"), ordered=True, tolerant=False) == 1
        swapped = plain.replace("ORDER BY o_orderkey", "ORDER BY CASE o_orderkey WHEN 10 THEN 11 WHEN 11 THEN 10 ELSE o_orderkey END")
        assert compare.mismatches(e.run(plain, "pg"), e.run(swapped, "pg"), ordered=True, tolerant=False) == 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_peers(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "e"), (None, "d")], "k int, v string")
    c = spark.createDataFrame([(1, "b"), (1, "c"), (2, "a"), (None, "e"), (None, "d")], "k int, v string")
    a, b, c = (x.orderBy("k") for x in (a, b, c))
    assert compare.mismatches(a, b, ordered=True, tolerant=False, peers=[0]) == 0
    assert compare.mismatches(a, c, ordered=True, tolerant=False, peers=[0]) == 4
    assert compare.mismatches(a, c, ordered=True, tolerant=True, peers=[0]) == 2
    assert compare.mismatches(a, b.orderBy(F.desc("k")), ordered=True, peers=[0]) > 0


def test_tolerance_over_several_numbers(spark):
    """A difference within the tolerance in the first number mustn't pair rows by it alone."""
    a = spark.createDataFrame([("k", 1.0, 5.0), ("k", 1.0000000001, 9.0), ("k", 7.0, 1.0)], "k string, x double, y double")
    b = spark.createDataFrame([("k", 1.0000000001, 5.0), ("k", 1.0, 9.0), ("k", 7.0, 1.0)], "k string, x double, y double")
    assert compare.mismatches(a, b, tolerant=False) == 4
    assert compare.mismatches(a, b) == 0
    assert compare.mismatches(a, b.withColumn("y", F.when(F.col("y") == 9.0, 9.1).otherwise(F.col("y")))) == 1
    many = spark.range(500).select(F.lit("k").alias("k"), (1 + F.col("id") * 1e-10).alias("x"), F.col("id").cast("double").alias("y"))
    back = spark.range(500).select(F.lit("k").alias("k"), (1 + (499 - F.col("id")) * 1e-10).alias("x"), F.col("id").cast("double").alias("y"))
    assert compare.mismatches(many, back) == 0


def test_cells_of_arrays(spark):
    a = spark.createDataFrame([([1, 2, 3],)], "x array<int>")
    b = spark.createDataFrame([([3, 2, 1],)], "x array<long>")
    assert compare.mismatches(a, b, tolerant=False) == 2
    assert compare.mismatches(a, b) == 0


def test_faults_of_queries_and_of_the_cluster(spark, sf, monkeypatch):
    e = Engine(spark, sf)
    assert "ZERO" in compare.verify(e, "SELECT 1 / (n_nationkey - n_nationkey) AS x FROM nation", "pg", "SELECT 1 AS x", "pg").error.upper()
    assert compare.verify_many(e, [("SELECT 1 AS x", "pg", "SELECT 1 AS x", "mysql"), ("SELECT n_name FROM nation", "pg", "SELECT r_name FROM region", "pg"), ("SELECT", "pg", "SELECT 1", "pg")]) == ["EQ", "UNKNOWN", "ERROR"]

    def lost(*_, **__):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(compare, "mismatches", lost)
    with pytest.raises(RuntimeError):
        compare.verify(e, "SELECT 1 AS x", "pg", "SELECT 2 AS x", "pg")


def test_verify(spark, sf):
    e = Engine(spark, sf)
    r = compare.verify(e, "SELECT now() AS t, 1 AS x", "pg", "SELECT now() AS t, 1 AS x", "mysql")
    assert r.execution and r.ori_execution
    assert compare.verify(e, "SELECT 1 AS x WHERE false", "pg", "SELECT 2 AS x WHERE false", "pg").ori_execution_reason == "No result"
    assert compare.verify(e, "SELECT broken(", "pg", "SELECT 1", "pg").error.startswith("pg:")
    assert compare.verify(e, "SELECT n_name FROM nation", "pg", "SELECT n_name FROM nation", "pg").formal == "EQ"


# relational operators


def test_fetch_percent_and_ties(spark):
    df = frame(spark, [(k, k // 3) for k in range(10)], "k int, g int")
    assert relational.fetch_percent(df, 25, [F.col("k")]).count() == 3
    assert sorted(r["k"] for r in relational.with_ties(df, 2, [F.col("g")]).collect()) == [0, 1, 2]


def test_partitioned_outer_join(spark):
    facts = frame(spark, [("a", 1, 5), ("b", 2, 6)], "p string, d int, v int")
    out = relational.partitioned_outer_join(facts, frame(spark, [(1,), (2,)], "d int"), ["p"], ["d"])
    assert sorted((r["p"], r["d"], r["v"]) for r in out.collect()) == sorted([("a", 1, 5), ("a", 2, None), ("b", 1, None), ("b", 2, 6)], key=str) or out.count() == 4


def test_set_cover(spark):
    pairs = frame(spark, [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "d"), (3, "a")], "i int, e string")
    assert relational.greedy_set_cover(pairs, "i", "e") == [2, 1]
    assert generate.minimal_cover([("x", {1, 2}), ("y", {2, 3, 4}), ("z", {1})]) == ["y", "x"]


def test_range_join_with_ranges_of_any_width(spark):
    ranges = frame(spark, [(0, 0.0, 1e9), (1, -5.0, 5.0), (2, 3.0, 3.5), (3, 7.0, 7.0), (4, None, 2.0), (5, 2.9, 3.1)], "r int, lo double, hi double")
    points = frame(spark, [(k, float(x)) for k, x in enumerate((-6, -5, 0, 3, 3.4, 5, 1e8))] + [(9, None)], "p int, x double")
    got = sorted((r["p"], r["r"]) for r in relational.range_join(points, ranges, "x", "lo", "hi", 1.0).collect())
    assert got == [(1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (3, 5), (4, 0), (4, 1), (4, 2), (5, 0), (6, 0)]


@pytest.mark.parametrize(("query_block", "vector_block"), [(1024, 16_384), (3, 5)])
def test_cosine_topk_in_blocks(spark, query_block, vector_block):
    import random

    import numpy as np

    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for k in range(40)] + [(40, [0.0] * 4), (41, None), (42, [1.0, 1.0, 1.0, 1.0]), (43, [1.0, 1.0, 1.0, 1.0])]
    df = frame(spark, rows, "id long, v array<double>")
    got = sorted((r["q"], r["rank"], r["v"]) for r in relational.cosine_topk(df.filter("id % 4 = 2"), df, 3, "id", "v", query_block, vector_block).collect())
    size = lambda x: np.sqrt(np.add.accumulate(np.array(x) ** 2)[-1])
    sim = lambda x, y: float(np.add.accumulate(np.array(x) * np.array(y))[-1] / (size(x) * size(y))) if size(x) and size(y) else 0.0
    want = []
    for i, x in rows:
        if i % 4 == 2 and x is not None:
            near = sorted((-sim(x, y), j) for j, y in rows if j != i and y is not None)[:3]
            want += [(i, n + 1, j) for n, (_, j) in enumerate(near)]
    assert got == sorted(want)


# readers


SCHEMA = readers.Table("t", [readers.Column("a", "int", False), readers.Column("b", "string"), readers.Column("d", "date")], ["a"])


def test_json_table(spark, tmp_path):
    (tmp_path / "t.json").write_text('[["B", "a", "d"], ["x", 1, {"value": "2024-01-02", "format": "yyyy-MM-dd"}], [null, 2, ""]]')
    rows = readers.read_json_table(spark, str(tmp_path / "t.json"), SCHEMA.schema()).collect()
    assert [tuple(r) for r in rows] == [(1, "x", datetime.date(2024, 1, 2)), (2, None, None)]


def test_pipe(spark, tmp_path):
    (tmp_path / "t.tbl").write_bytes("1|caf\xe9|2024-01-02|\n2||\n".encode("latin-1"))
    rows = readers.read_pipe(spark, str(tmp_path / "t.tbl"), SCHEMA.schema()).collect()
    assert [tuple(r) for r in rows] == [(1, "café", datetime.date(2024, 1, 2)), (2, None, None)]
    (tmp_path / "bad.tbl").write_text("1|x\n")
    with pytest.raises(Exception, match="fields"):
        readers.read_pipe(spark, str(tmp_path / "bad.tbl"), SCHEMA.schema()).collect()


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,d\n1,"x, ""y""",2024-01-02\n2,,\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "t.csv"), SCHEMA.schema()).collect()] == [(1, 'x, "y"', datetime.date(2024, 1, 2)), (2, None, None)]


def test_inserts(spark):
    script = "CREATE TABLE t (a INT); INSERT INTO t (b, a, d) VALUES ('x;y', 1, DATE '2024-01-02'), (NULL, -2, NULL); INSERT INTO t VALUES (3, 'z', TO_DATE('2024-05-06', 'YYYY-MM-DD'));"
    rows = readers.read_inserts(spark, script, "oracle", {"t": SCHEMA.schema()})["t"].collect()
    assert [tuple(r) for r in rows] == [(1, "x;y", datetime.date(2024, 1, 2)), (-2, None, None), (3, "z", datetime.date(2024, 5, 6))]
    out = readers.insert_statements("t", [(k, "v" * 100) for k in range(100)], "mysql")
    assert len(out) > 1 and all(len(x) <= readers.BATCH_BYTES["mysql"] for x in out)
    assert sum(len(readers.parse_insert(x, "mysql")[2]) for x in out) == 100


@pytest.mark.parametrize(
    ("dialect", "ddl"),
    [
        ("mysql", "CREATE TABLE `t` (`a` INT NOT NULL AUTO_INCREMENT, b ENUM('x','y') DEFAULT 'x', c DECIMAL(8,2), PRIMARY KEY (`a`), CONSTRAINT f FOREIGN KEY (c) REFERENCES u (k) ON DELETE CASCADE) ENGINE=InnoDB"),
        ("pg", 'CREATE TABLE IF NOT EXISTS public."t" ("a" INT NOT NULL PRIMARY KEY, b VARCHAR(3) CHECK (b IN (\'x\', \'y\')), c NUMERIC(8,2) REFERENCES u (k))'),
        ("oracle", 'CREATE TABLE "t" ("a" INT NOT NULL, b VARCHAR2(3), c NUMBER(8,2), PRIMARY KEY ("a"), FOREIGN KEY (c) REFERENCES u (k))'),
    ],
)
def test_ddl(dialect, ddl):
    t = readers.parse_ddl(ddl, dialect)
    assert (t.name, [c.name for c in t.columns], t.columns[0].type, t.columns[2].type, t.primary_key, t.foreign_keys) == ("t", ["a", "b", "c"], "int", "decimal(8,2)", ["a"], [(["c"], "u", ["k"])])
    assert not t.columns[0].nullable
    again = readers.Table.from_json(t.to_json())
    assert again.primary_key == ["a"] and again.foreign_keys == t.foreign_keys
    assert t.renamed("u", "w").foreign_keys[0][1] == "w" and t.with_column_renamed("c", "z").foreign_keys[0][0] == ["z"]
    assert readers.parse_ddl(t.ddl(dialect), dialect).primary_key == ["a"]
    assert "REFERENCES" in t.foreign_key_ddl(dialect)[0]


# revision


def test_revision(spark):
    df = frame(spark, [("1", "1.5", "2024-01-02", "true", "x"), ("", "2", "2024-02-30", "0", "y"), (None, "-3e2", "2024-03-01", "1", "")], "a string, b string, c string, d string, e string")
    assert revision.revise(df, {"a": "date", "b": "int", "c": "date", "d": "boolean", "e": "int"}) == {"a": "int", "b": "double", "c": "string", "d": "boolean", "e": "string"}
    errors = {r["column"]: (r["bad"], r["longest"]) for r in revision.value_errors(df, {"c": "date", "e": "string"}, {"e": ["x"]}).collect()}
    assert errors == {"c": (1, 10), "e": (1, 1)}
    assert [tuple(r) for r in revision.coerce(df, {"a": "int", "d": "boolean"}).select("a", "d").collect()] == [(1, True), (None, False), (None, True)]
    assert revision.shorten("a_very_long_identifier_that_goes_on_and_on", 30) and len(revision.shorten("a_very_long_identifier_that_goes_on_and_on", 30)) <= 30


# intervals and formats


@pytest.mark.parametrize(
    ("text", "unit", "want"),
    [
        ("1 year 2 mons 3 days 04:05:06", None, (14, 273906000000)), ("1 day ago", None, (0, -86400000000)), ("P1Y2M3DT4H5M6S", None, (14, 273906000000)), ("-1-6", "YEAR TO MONTH", (-18, 0)), ("3", "DAY", (0, 259200000000)),
        ("1 12:30", "DAY_MINUTE", (0, 131400000000)), ("2:30", "MINUTE_SECOND", (0, 150000000)), ("1.5", "HOUR", (0, 5400000000)), ("2 weeks", None, (0, 1209600000000)), ("4 05:06:07.5", "DAY TO SECOND", (0, 363967500000)),
    ],
)
def test_intervals(text, unit, want):
    assert interval_parts(text, unit) == want


def test_formats():
    assert java_pattern("%Y-%m-%d %H:%i:%s.%f", "mysql") == "yyyy-MM-dd HH:mm:ss.SSSSSS"
    assert java_pattern('YYYY"y"MM', "pg") == "yyyy'y'MM"
    assert java_pattern("DD-MON-RR HH24MISS", "oracle") == "dd-MMM-yy HHmmss"


# analysis


def test_analysis():
    q = parse("WITH a AS (SELECT * FROM t), b AS (SELECT * FROM a JOIN u ON true) SELECT x, sum(y), count(*) OVER () FROM b, (SELECT * FROM v) w WHERE EXISTS (SELECT 1 FROM s.z) GROUP BY ROLLUP (x, k) ORDER BY 1", "pg")
    assert analysis.base_tables(q) == {"t", "u", "v", "z"}
    assert [n.name for n in analysis.aggregated(q.body)] == ["sum"]
    assert [g.parts["parts"][0].text for g in analysis.grouping_columns(q.body)] == ["x", "k"]
    assert analysis.has_limit_or_order(q) and compare.has_outer_order(q)
    assert analysis.select_blocks(q) == 5
    assert analysis.components("WITH a AS (SELECT 1) SELECT * FROM a", "pg") is None
    assert analysis.token_count("SELECT 'a b c', x", "pg") == 6
    assert analysis.unique_names(["a", None, "A", "a"]) == ["a", "col_1", "A_1", "a_2"]


# rules and generation


CATALOG = {"t": {"a": "int", "s": "string", "d": "date", "ts": "timestamp"}}


@pytest.mark.parametrize(
    ("source", "target", "sql", "want"),
    [
        ("mysql", "pg", "SELECT IFNULL(IFNULL(a, 1), b) FROM t", "SELECT COALESCE(COALESCE(a, 1), b) FROM t"),
        ("mysql", "pg", "SELECT DATE_FORMAT(d, '%Y/%m') FROM t LIMIT 2, 5", "SELECT TO_CHAR(d, 'YYYY/MM') FROM t LIMIT 5 OFFSET 2"),
        ("mysql", "pg", "SELECT CONCAT(s, ', ', f(a, b)) FROM t", "SELECT (s || ', ' || f(a, b)) FROM t"),
        ("mysql", "pg", "SELECT a DIV 2, s DIV 2, a <=> b FROM t", "SELECT a / 2, s DIV 2, a IS NOT DISTINCT FROM b FROM t"),
        ("pg", "mysql", "SELECT to_char(d, 'YYYY-MM-DD') FROM t", "SELECT DATE_FORMAT(d, '%Y-%m-%d') FROM t"),
        ("oracle", "pg", "SELECT NVL(a, 0) FROM t MINUS SELECT 1 FROM dual", "SELECT COALESCE(a, 0) FROM t EXCEPT SELECT 1 FROM dual"),
    ],
)
def test_rules(source, target, sql, want):
    assert rules.Rewriter(rules.builtin_rules(), source, target, CATALOG).rewrite(sql) == want


def test_rule_records():
    r = rules.Rule.from_json('{"Desc": "x", "Dialect": {"Src": "pg", "Tgt": "mysql"}, "Type": "FUNCTION", "SrcPattern": "F(<a: NUMBER, COLUMN>, <b: LIST[STRING]>)", "TgtPattern": "G(<a>)", "Tag": {"DB PARAMETER": {"pg": {"k": "v"}}}}')
    assert r.parameters == {"pg": {"k": "v"}} and rules.parse_pattern(r.source)[1] == rules.Hole("a", "NUMBER", ("COLUMN",))
    with pytest.raises(SqlError):
        rules.parse_hole("x", "NOTHING")
    assert rules.merge_parameters({"a": "1"}, {"a": "2"}) is None and rules.merge_parameters({"a": "1"}, {"b": "2"}) == {"a": "1", "b": "2"}


def test_generation(spark, sf):
    e = Engine(spark, sf)
    found = generate.pairs(e, ["SELECT IFNULL(n_name, 'x') AS n FROM nation", "SELECT 1", "SELECT o_orderkey FROM orders LIMIT 2, 3"], rules.builtin_rules(), "mysql", "pg", 5, seed=3)
    assert {p["points"][0]["point"] for p in found} == {"ifnull", "limit"}
    assert found == generate.pairs(e, ["SELECT IFNULL(n_name, 'x') AS n FROM nation", "SELECT 1", "SELECT o_orderkey FROM orders LIMIT 2, 3"], rules.builtin_rules(), "mysql", "pg", 5, seed=3)
    padded = generate.pad("SELECT n_name FROM nation", ["SELECT r_name FROM region"], "pg", 30)
    assert 20 <= analysis.token_count(padded, "pg") - 4 <= 40
    assert e.run(padded, "pg").count() > 25
    a, b = generate.align(frame(spark, [("x", 1)], "s string, n int"), frame(spark, [(2.5, "y", 3)], "v double, t string, w int"))
    assert [tuple(r) for r in b.collect()] == [("y", 2, 3)] and a.columns == b.columns
    assert generate.modal_value(frame(spark, [(1,), (2,), (2,), (1,), (None,)], "x int"), "x") == 1
    assert generate.sample_values(e.table("nation"), "n_name", 3, 1) == generate.sample_values(e.table("nation"), "n_name", 3, 1)


def test_engine(spark, sf):
    e = Engine(spark, sf)
    assert e.compiles("SELECT n_name FROM nation", "pg")[0] and not e.compiles("SELECT nothing FROM nation", "pg")[0]
    assert e.result_types("SELECT n_nationkey AS K, n_name FROM nation", "oracle") == [("k", "int"), ("n_name", "string")]


# streams


def test_stream_gives_what_the_batch_gives(spark, sf):
    path = f"{sf}/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parquet*")
    for name, f in (("tumbling", lambda d: windows.tumbling(d, "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"))), ("sliding", lambda d: windows.sliding(d, "ts", "1 hour", "30 minutes", [], F.count(F.lit(1)).alias("n")))):
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(f"out_{name}").start()
        try:
            q.processAllAvailable()
            assert compare.mismatches(spark.table(f"out_{name}"), f(batch), tolerant=False) == 0
        finally:
            q.stop()


# changes


def test_changes(spark):
    from tessella.plans.changes import execute

    t = frame(spark, [(1, "a", 1.0), (2, "b", None), (3, None, 3.0)], "k int, s string, v double")
    e = Engine(spark, "/nowhere", []).add("t", t, key=["k"]).add("u", frame(spark, [(2, "B", 20.0), (9, "N", 90.0)], "k int, s string, v double"))
    rows = lambda: sorted(tuple(r) for r in e.table("t").collect())
    execute(e, "UPDATE t SET v = v + 1, s = 'x' WHERE v > 2", "pg")
    assert rows() == [(1, "a", 1.0), (2, "b", None), (3, "x", 4.0)]
    execute(e, "DELETE FROM t WHERE v = 1", "mysql")
    assert rows() == [(2, "b", None), (3, "x", 4.0)]
    execute(e, "INSERT INTO t (v, k) VALUES (5, 7), (NULL, 8)", "oracle")
    assert rows()[2:] == [(7, None, 5.0), (8, None, None)]
    execute(e, "MERGE INTO t d USING u n ON (d.k = n.k) WHEN MATCHED THEN UPDATE SET s = n.s, v = n.v WHEN NOT MATCHED THEN INSERT (k, s) VALUES (n.k, n.s)", "oracle")
    assert rows() == [(2, "B", 20.0), (3, "x", 4.0), (7, None, 5.0), (8, None, None), (9, "N", None)]
    execute(e, "MERGE INTO t USING (SELECT k FROM u) n ON t.k = n.k WHEN MATCHED AND t.v IS NULL THEN DELETE", "pg")
    assert [r[0] for r in rows()] == [2, 3, 7, 8]
    execute(e, "INSERT INTO t SELECT k, s, v FROM u ON DUPLICATE KEY UPDATE v = VALUES(v) + v", "mysql")
    assert rows() == [(2, "B", 40.0), (3, "x", 4.0), (7, None, 5.0), (8, None, None), (9, "N", 90.0)]


def test_insert_on_duplicate_key_goes_by_the_declared_key(spark):
    from tessella.plans.changes import execute

    t = frame(spark, [("x", 1, 1, 10), ("y", 1, 2, 20)], "s string, a int, b int, v int")
    u = frame(spark, [("z", 1, 2, 5), ("w", 2, 2, 7)], "s string, a int, b int, v int")
    with pytest.raises(SqlError):
        execute(Engine(spark, "/nowhere", []).add("t", t).add("u", u), "INSERT INTO t SELECT s, a, b, v FROM u ON DUPLICATE KEY UPDATE v = VALUES(v) + v", "mysql")
    e = Engine(spark, "/nowhere", []).add("t", t, key=["a", "b"]).add("u", u)
    execute(e, "INSERT INTO t SELECT s, a, b, v FROM u ON DUPLICATE KEY UPDATE v = VALUES(v) + v", "mysql")
    assert sorted(tuple(r) for r in e.table("t").collect()) == [("w", 2, 2, 7), ("x", 1, 1, 10), ("y", 1, 2, 25)]


def test_catalogs(spark):
    a = readers.parse_ddl("CREATE TABLE t (a INT, b TEXT, FOREIGN KEY (a) REFERENCES u (k))", "pg")
    b = readers.parse_ddl("CREATE TABLE T (A BIGINT, c TEXT)", "pg")
    x, y = (revision.catalog_frame(spark, [t]) for t in (a, b))
    assert sorted((r["column"], r["left"], r["right"]) for r in revision.schema_difference(x, y).collect()) == [("a", "int", "bigint"), ("b", "string", None), ("c", None, "string")]
    assert {r["type"]: r["n"] for r in revision.type_census(x).collect()} == {"int": 1, "string": 1}
    assert sorted(map(tuple, revision.neighbours(spark, [a]).collect())) == [("t", "u"), ("u", "t")]


# rule functions, against hand-worked cases


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [
        ("TranMySQLDateFormatToPG", ("'%Y-%m-%d %H:%i:%s.%f %p'",), "'YYYY-MM-DD HH24:MI:SS.FF AM'"),
        ("TranPgDateFormatToMySQL", ("'YYYY-MM-DD HH24:MI:SS'",), "'%Y-%m-%d %H:%i:%S'"),
        ("TranToStandardTimeFormat", ("'05-MAR-49'", "DD-MON-RR"), "'2049-03-05'"),
        ("TranToStandardTimeFormat", ("'05-MAR-50'", "DD-MON-RR"), "'1950-03-05'"),
        ("TranToStandardTimeFormat", ("'Mar 05, 2001, 14:07:09'", "Mon dd, YYYY, HH24:MI:SS"), "'2001-03-05 14:07:09.000000'"),
        ("TranToStandardTimeFormat", ("'05-MAR-01 02.07.09.250000 PM'", "DD-MON-RR HH.MI.SSXFF AM"), "'2001-03-05 14:07:09.250000'"),
        ("GenStandardDate", ("'03/07/2001'", "MDY"), "'2001-03-07'"),
        ("GenStandardDate", ("'03/07/2001'", "DMY"), "'2001-07-03'"),
        ("GenNumber", ("'1,234.50'", ".,"), "1234.50"),
        ("GenNumber", ("'-1.234,50'", ",."), "-1234.50"),
        ("GenMySQLOracleIntervalValue", ("5", "MICROSECOND"), "INTERVAL '0.000005' SECOND(6)"),
        ("GenMySQLOracleIntervalValue", ("2", "WEEK"), "INTERVAL '14' DAY"),
        ("GenMySQLOracleIntervalValue", ("3", "QUARTER"), "INTERVAL '9' MONTH"),
        ("GenMySQLOracleIntervalValue", ("'4:5.25'", "MINUTE_MICROSECOND"), "INTERVAL '4:5.250000' MINUTE TO SECOND(6)"),
        ("GenMySQLOracleIntervalValue", ("'1 2:3:4'", "DAY_SECOND"), "INTERVAL '1 2:3:4' DAY TO SECOND"),
        ("GenMySQLOracleIntervalValue", ("'-1-2'", "YEAR_MONTH"), "INTERVAL '-1-2' YEAR TO MONTH"),
        ("GenMySQLPGIntervalValue", ("7", "HOUR"), "INTERVAL '7 hours'"),
        ("GenMySQLPGIntervalValue", ("'1 2'", "DAY_HOUR"), "INTERVAL '1 days 2 hours'"),
        ("GenMySQLPGIntervalValue", ("'4:5.25'", "MINUTE_MICROSECOND"), "INTERVAL '4 minutes 5 seconds 250000 microseconds'"),
        ("GenOraclePGIntervalValue", ("'1 2:3:4'", "DAY TO SECOND(3)"), "INTERVAL '1 days 2 hours 3 minutes 4 seconds'"),
        ("GenOraclePGIntervalValue", ("'9'", "day"), "INTERVAL '9 days'"),
        ("GenOracleMySQLUnit", ("YEAR(3) TO MONTH",), "YEAR_MONTH"),
        ("GenOracleMySQLUnit", ("Day to Second",), "DAY_SECOND"),
        ("RepBackSlash", (r"'a\nb\\c\'d'",), "'a\nb\\c''d'"),
        ("AddQstrEscape", ("Q'<it's \\ here>'",), r"'it\'s \\ here'"),
        ("GenPGOracleInterval", ("'1-2 3 4:05:06'", "STANDARD"), "TO_YMINTERVAL('P1Y2M') + TO_DSINTERVAL('P3DT4H5M6S')"),
        ("GenPGOracleInterval", ("'-P1Y2M'", "ISO8601"), "TO_YMINTERVAL('-P1Y2M')"),
        ("GenPGOracleInterval", ("'@ 1 years 2 mons 3 days ago'", "PG"), "TO_YMINTERVAL('-P1Y2M') + TO_DSINTERVAL('-P3DT0H0M0S')"),
        ("GenPGMySQLInterval", ("'P3DT4H5M6S'", "ISO8601"), "INTERVAL '3 4:5:6' DAY_SECOND"),
        ("GenPGMySQLInterval", ("'2 hours -5 mins'", "PG"), "INTERVAL '0 1:55:0' DAY_SECOND"),
        ("RtrimReg", ("'a.b'",), r"'(a\.b)+$'"),
        ("LtrimReg", ("'a|b'",), r"'^(a\|b)+'"),
        ("EnumCube", ("a, b",), [["a", "b"], ["b"], ["a"]]),
        ("ReviseSelectList", ("a, sum(b), b + 1, t.a", "a", "a, b, t.a"), ["a", "sum(b)", "NULL + 1", "NULL"]),
        ("ReviseSelectListSets", ("a, max(c), c", "a", [["a"], ["c"]]), ["a", "max(c)", "NULL"]),
        ("OraMySQLOrderBy", ("a, b DESC, c NULLS FIRST, d DESC NULLS LAST",), ["a IS NULL, a", "b IS NULL DESC, b DESC", "c ASC", "d DESC"]),
        ("PgMySQLOrderBy", ("f(a, b) DESC",), ["f(a, b) IS NULL DESC, f(a, b) DESC"]),
        ("MySQLOrderBy", ("a, b DESC",), ["a ASC NULLS FIRST", "b DESC NULLS LAST"]),
        ("TranCountLiteralOra", ("'count( /a/b )'",), "'/a/b'"),
        ("GenCountXpath", ("'/a/b'",), "'count(/a/b)'"),
        ("MySQLGetValueFormat", ("YYYY/MM/DD",), "'%Y/%m/%d'"),
        ("OraPgGetFormat", ("DD Mon YYYY",), "'DD Mon YYYY'"),
        ("GenToCharFmt", ("3",), "'9999999999.000'"),
        ("GenToCharFmt", ("0",), "'9999999999'"),
    ],
)
def test_rule_functions(name, args, want):
    assert rule_functions.call(name, rule_functions.Context(), *args) == want


def test_refused_rule_functions():
    for name, args in (("MySQLGetValueFormat", ("DD-MON-RR",)), ("OraPgGetFormat", ("YY",)), ("GenPGOracleInterval", ("'soon'", "PG")), ("GenMySQLPGIntervalValue", ("'1:2'", "DAY_SECOND")), ("AddQstrEscape", ("'plain'",))):
        with pytest.raises(ValueError):
            rule_functions.call(name, rule_functions.Context(), *args)


def test_drawn_rule_functions_meet_their_conditions():
    import random
    import re

    for seed in range(200):
        c = rule_functions.Context(random.Random(seed))
        draw = lambda name, *args: rule_functions.call(name, c, *args)  # noqa: E731, B023
        for name in ("ContainBackSlash", "GenQstring", "GenPGSQLStandardLiteral", "GenPGOriIntervalLiteral"):
            assert rule_functions.fulfils(name, draw(name)), name
        for mode in ("YM", "DS", ""):
            text = draw("GenISOIntervalLiteral", mode)
            assert rule_functions.fulfils("GenISOIntervalLiteral", text)
            assert draw("GenPGMySQLInterval", text, "ISO8601").startswith("INTERVAL")
        assert "INTERVAL" in draw("GenPGOracleInterval", draw("GenPGSQLStandardLiteral"), "STANDARD")
        for unit in ("MICROSECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR"):
            assert draw("GenMySQLPGIntervalValue", draw("GenMySQLIntervalInt", unit), unit).startswith("INTERVAL '")
        for unit in ("MINUTE_MICROSECOND", "HOUR_SECOND", "HOUR_MINUTE", "DAY_SECOND", "DAY_MINUTE", "DAY_HOUR", "YEAR_MONTH"):
            assert draw("GenMySQLOracleIntervalValue", draw("GenMySQLIntervalString", unit), unit).startswith("INTERVAL '")
        assert draw("GenOraclePGIntervalValue", draw("GenOracleIntervalDouble"), "DAY TO SECOND").startswith("INTERVAL '")
        assert draw("GenOraclePGIntervalValue", draw("GenOracleIntervalSingle", "MONTH"), "MONTH").endswith("months'")
        for layout in rule_functions.LAYOUTS:
            assert re.match(r"'\d{4}-\d\d-\d\d", draw("TranToStandardTimeFormat", draw("GenTimestampOracleStr", layout), layout))
        for order in ("MDY", "DMY"):
            assert rule_functions.fulfils("SampleDate", draw("GenStandardDate", draw("GenPGDateParaStr", order), order))
        for marks in (".,", ",."):
            assert abs(float(draw("GenNumber", draw("GenOracleStrNumber", marks), marks))) <= 5000
        assert re.fullmatch(r"'(?:[0-9A-Fa-f]{2}){1,4}'", draw("GenDoubleHexString")) and re.fullmatch(r"(?:[0-9A-Fa-f]{2}){1,9}", draw("GenHexString"))
        assert rule_functions.bare(draw("GenMySQLTimeFormat")) in rule_functions.MYSQL_DATE_FORMATS and rule_functions.bare(draw("GenMySQLTimeFormat", "TIME")) in rule_functions.MYSQL_TIME_FORMATS
        assert rule_functions.bare(draw("GenOraPgTimeFormat")) in rule_functions.ORACLE_DATE_FORMATS


def test_sampled_rule_functions():
    import random

    values = {"d": datetime.date(2051, 3, 5), "t": datetime.datetime(2001, 3, 5, 6, 7, 8), "s": "\\cold widget", "x": "<a><b/><c/></a>", "one": "z"}
    c = rule_functions.Context(random.Random(1), values.get)
    run = lambda name, *args: rule_functions.call(name, c, *args)
    assert run("SampleDate", "d") == "'2051-03-05'" and run("SampleDateOra", "d", "DD-MON-RR") == "'05-Mar-51'" and run("SampleDateOra", "t", "Mon dd, YYYY") == "'Mar 05, 2001'"
    assert run("SampleTimeStamp", "t") == "'2001-03-05 06:07:08.000000'" and rule_functions.fulfils("SampleDate", run("SampleDate", "nothing"))
    assert run("GenDateLikePat", "t") in ("'%2001%'", "'%03%'")
    assert run("GenIlikePattern", "s") == "'%COLD WIDGET%'" and run("GenRegPattern", "s") == "'.*cold widget.*'"
    assert run("GenXmlPath", "x") in ("'/a/b'", "'/a/c'") and run("GenCountLiteral", "x") in ("'count(/a/b)'", "'count(/a/c)'")
    assert run("GenTrim", "s", "RIGHT") == "'et'" and run("GenTrim", "nothing", "BOTH") == "'<>=.'"
    assert run("GenSubString", "s", "1", "1").strip("'") in "cold widget"
    for name, args in (("GenTrim", ("one", "LEFT")), ("GenRegPattern", ("nothing",)), ("GenSubString", ("one", "1", "1"))):
        with pytest.raises(ValueError):
            run(name, *args)


def test_tree_rewriting():
    rows = [
        ("SELECT IFNULL((a), IFNULL(b, 1)) + (a) FROM t WHERE (IFNULL( (d) ,2)) = 3 LIMIT 2, 3", "SELECT COALESCE((a), COALESCE(b, 1)) + (a) FROM t WHERE COALESCE((d), 2) = 3 LIMIT 3 OFFSET 2"),
        ("SELECT x FROM (SELECT IF(a > 1, INSTR(s, 'b'), 2) AS x FROM t) u", "SELECT x FROM (SELECT CASE WHEN a > 1 THEN STRPOS(s, 'b') ELSE 2 END AS x FROM t) u"),
        ("SELECT CONCAT(s, CONCAT(s, 'x')) FROM t", "SELECT (s || (s || 'x')) FROM t"),
        ("SELECT a <=> (b) FROM t", "SELECT a IS NOT DISTINCT FROM (b) FROM t"),
    ]
    for sql, want in rows:
        w = rules.TreeRewriter(rules.builtin_rules(), "mysql", "pg", CATALOG)
        assert w.rewrite(sql) == want
        assert w.applied and w.rewritten
    r = rules.Rule("same", "NVL(<a: ANY_VALUE>, <b: ANY_VALUE>)", "COALESCE(<a>, <b>)", ("oracle", "oracle"))
    assert rules.identity_rewrite("SELECT NVL(a, 1) FROM t", [r], "oracle") == "SELECT COALESCE(a, 1) FROM t"


def test_composition():
    import random

    s = "SELECT a, b FROM t WHERE a = 1 OR b = 2 UNION SELECT c, d FROM u ORDER BY 1"
    assert compose.swap_columns(s, 0, 1, "pg").startswith("SELECT b, a FROM t") and "SELECT d, c FROM u" in compose.swap_columns(s, 0, 1, "pg")
    assert compose.drop_column(s, 1, "pg") == "SELECT a FROM t WHERE a = 1 OR b = 2 UNION SELECT c FROM u ORDER BY 1"
    assert compose.add_filler(s, 1, "num", "f", "pg") == "SELECT a, 0.0 AS f, b FROM t WHERE a = 1 OR b = 2 UNION SELECT c, 0.0 AS f, d FROM u ORDER BY 1"
    assert compose.add_projection(s, "1", "n", "pg") == "SELECT a, b, 1 AS n FROM t WHERE a = 1 OR b = 2 UNION SELECT c, d, 1 AS n FROM u ORDER BY 1"
    assert compose.add_predicate(s, "z > 1", "pg") == "SELECT a, b FROM t WHERE (a = 1 OR b = 2) AND (z > 1) UNION SELECT c, d FROM u WHERE (z > 1) ORDER BY 1"
    assert compose.inline_star("WITH x AS (SELECT a FROM t) SELECT 1 AS a UNION ALL SELECT * FROM x", "pg") == "WITH x AS (SELECT a FROM t) SELECT 1 AS a UNION ALL SELECT a FROM t"
    assert compose.unquoted_keywords('SELECT "rank", "from" FROM t', ["rank"], "pg") == 'SELECT rank, "from" FROM t'
    assert compose.keyword_uses("rank", {"rank": {"a": "int"}, "t": {"RANK": "int"}}) == [("rank", None), ("t", "RANK")]
    rng = random.Random(2)
    assert compose.augment("x", "num", "c", rng, grouped=False, aggregated=True) == "x * AVG(c)" and compose.augment("x", "str", "c", rng) == "CONCAT(x, c)"
    assert compose.augment("x", "date", "c", rng).startswith("EXTRACT(") and compose.use_interval("d", "INTERVAL '1' DAY") == "d + INTERVAL '1' DAY"
    rule = next(r for r in rules.builtin_rules() if r.description == "ifnull")
    made = compose.add_function_rule("SELECT n_name FROM nation", rule, [{"n_name": "str"}], rule_functions.Context(rng), "mysql")
    assert made == "SELECT n_name, IFNULL(n_name, n_name) AS point_1 FROM nation"
    limit = next(r for r in rules.builtin_rules() if r.description == "limit")
    assert compose.add_clause_rule("SELECT n_name FROM nation", limit, {}, rule_functions.Context(rng), "mysql").startswith("SELECT * FROM (SELECT n_name FROM nation) pointed LIMIT ")
    last = rules.Rule("o", "x", "y", ("pg", "mysql"), "ORDER_BY_CLAUSE")
    assert compose.choose_rule([last, rule], rng) is rule and compose.choose_rule([last, rule], rng, ["ifnull"]) is last and compose.choose_rule([], rng) is None


def test_segments(spark, sf):
    q = parse("SELECT a, count(*) FROM t WHERE b IN (SELECT max(c) FROM u) GROUP BY a", "pg")
    assert segments.holds(["SELECT", "CALL", "MAX"], ["select", "max"]) and not segments.holds(["MAX", "SELECT"], ["SELECT", "MAX"])
    assert [p.node.name for p in segments.matching(q, ["MAX"])] == ["max"]
    text, stands = segments.masked("SELECT a, 'x' FROM t WHERE a = 1", "pg", {"t": {"a": "int"}})
    assert text == "SELECT <column_1: int>, <text_2> FROM <table_3> WHERE <column_1: int> = <number_4>" and segments.unmasked(text, stands) == "SELECT a, 'x' FROM t WHERE a = 1"
    e = Engine(spark, sf)
    ok, error = e.compiles("SELECT upper(nothing_like_it(n_name)) FROM nation", "pg")
    assert not ok and segments.locate("SELECT upper(nothing_like_it(n_name)) FROM nation", "pg", error).node.name == "nothing_like_it"
    bad = rules.Rule("bad", "IFNULL(<a: ANY_VALUE>, <b: ANY_VALUE>)", "NO_SUCH_THING(<a>, <b>)", ("mysql", "pg"))
    out, tried = segments.translate(e, "SELECT IFNULL(n_name, 'x') AS n FROM nation", [bad, *rules.builtin_rules()], "mysql", "pg")
    assert out == "SELECT COALESCE(n_name, 'x') AS n FROM nation" and [t.rule for t in tried] == ["", "bad"]
    t = readers.parse_ddl("CREATE TABLE nation (n_nationkey INT)", "pg")
    assert len(segments.ddl_for([t], "SELECT 1 FROM nation", "mysql")) == 1 and segments.ddl_for([t], "SELECT 1 FROM region", "mysql") == []


def test_vector_store(spark, tmp_path):
    store = vectors.VectorStore(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.rows().count() == 0
    ddl = "id string, kind string, text string, metadata map<string, string>, vector array<float>"
    store.insert(frame(spark, [("a", "f", "one", {"l": "x"}, [1.0, 0.0]), ("b", "f", "two", {"l": "y"}, [0.0, 1.0]), ("c", "g", "one", {}, [1.0, 1.0])], ddl))
    store.insert(frame(spark, [("b", "f", "two again", {"l": "y"}, [-1.0, 0.0])], ddl))
    asked = frame(spark, [("a", [1.0, 0.0])], "id string, vector array<float>")
    found = sorted((r["kind"], r["id"], r["score"]) for r in store.search(asked, 2).collect())
    assert found == [("f", "a", 100.0), ("f", "b", 0.0), ("g", "c", 85.36)]
    assert [r["id"] for r in store.search(asked, 2, ["f"], F.col("metadata.l") == "y").collect()] == ["b"]
    assert sorted(r["id"] for r in store.search(asked, 2, contains="one").collect()) == ["a", "c"]
    store.delete(frame(spark, [("a",)], "id string"))
    assert sorted(r["id"] for r in store.rows().collect()) == ["b", "c"]
    store.delete(kind="g")
    assert store.rows().count() == 1 and store.version() == 4
    store.delete()
    assert store.rows().count() == 0


def test_counted_rules_and_folded_texts():
    a, b = [{"point": "x", "num": 1}, {"point": "y", "num": 2}], [{"point": "y", "num": 1}, {"point": "x", "num": 1}, {"point": "y", "num": 1}]
    assert analysis.points_equal(a, b) and not analysis.points_equal(a, a[:1])
    assert analysis.points_union(a, b) == [{"point": "x", "num": 2}, {"point": "y", "num": 4}] and analysis.add_point(a, "z")[-1] == {"point": "z", "num": 1}
    s = analysis.SpacelessSet(["A b", "ab", "c"])
    assert len(s) == 2 and " a B " in s and list(s | ["d"]) == ["A b", "c", "d"] and list(s & ["AB"]) == ["A b"] and list(s - ["C"]) == ["A b"]
    sql = "SELECT 'a b', x FROM t"
    assert analysis.span_tokens(sql, "pg", 0, len(sql)) == analysis.token_count(sql, "pg") and analysis.span_tokens(sql, "pg", 7, 12) == 2
    assert analysis.relations(parse("SELECT 1 FROM a x JOIN b ON true, (SELECT 1) d", "pg").body) == [("a", "x"), ("b", None), ("derived", "d")]


def test_sessions_of_their_own(spark, sf):
    e = Engine(spark, sf)
    other = e.isolated()
    other.spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert spark.conf.get("spark.sql.shuffle.partitions") != "3"
    assert other.run("SELECT count(*) AS n FROM nation", "pg").first()["n"] == 25
