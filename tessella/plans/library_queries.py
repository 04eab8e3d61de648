"""Queries over the library's readers, analysis, rules, composition and streams; results that no table gives are spelled out for DuckDB as constants."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, staged, vectors
from ..sources import readers, revision
from ..streaming import windows
from . import analysis, changes, compose, generate, rule_functions, rules, segments
from .engine import Engine
from .operator_queries import query
from .parser import parse, parse_expression


def values(columns: str, *rows: tuple) -> str:
    """SQL of a constant table."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({columns})"


def table(e: Engine, ddl: str, *rows: tuple) -> DataFrame:
    return e.spark.createDataFrame(list(rows), ddl)


def place(e: Engine) -> str:
    return f"{staged.shared_dir(e.spark)}/tessella/files-{uuid.uuid4().hex}"


# sources and sinks: whole tables written in a format and read again


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_json(e: Engine) -> DataFrame:
    t, path = e.table("nation"), place(e)
    cells = F.to_json(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string")))
    t.select(cells.alias("r")).agg(F.concat(F.lit('[["n_nationkey", "N_NAME", "n_regionkey"], '), F.array_join(F.collect_list("r"), ", "), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return readers.read_json_table(e.spark, path, t.schema)


@query("SELECT * FROM supplier")
def scan_pipe(e: Engine) -> DataFrame:
    t, path = e.table("supplier"), place(e)
    t.select(F.concat(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in t.columns]), F.lit("|")).alias("value")).write.option("encoding", "ISO-8859-1").text(path)
    return readers.read_pipe(e.spark, path, t.schema)


@query("SELECT * FROM customer")
def scan_csv(e: Engine) -> DataFrame:
    t, path = e.table("customer"), place(e)
    t.write.csv(path, header=True)
    return readers.read_csv(e.spark, path, t.schema)


@query("SELECT * FROM nation")
def scan_inserts(e: Engine) -> DataFrame:
    """A script as a database would dump it: CREATE TABLE and INSERT statements in batches."""
    t = e.table("nation")
    script = "CREATE TABLE nation (n_nationkey INT);\n" + ";\n".join(readers.insert_statements("nation", [tuple(r) for r in t.orderBy("n_nationkey").collect()], "mysql")) + ";"  # a script is a text on the driver
    return readers.read_inserts(e.spark, script, "mysql", {"nation": t.schema})["nation"]


@query(values("nth, a, b, n", (0, "x;y", "1", 2), (1, "it''s".replace("''", "'"), "-2", 2)))
def insert_rows(e: Engine) -> DataFrame:
    _, cols, rows = readers.parse_insert("INSERT INTO t (a, b) VALUES ('x;y', 1), ('it''s', -2)", "pg")
    return table(e, "nth int, a string, b string, n int", *[(k, *r, len(cols)) for k, r in enumerate(rows)])


@query(values("nth, piece", (0, "f(a, 'x,y')"), (1, "[1, 2]"), (2, "b")))
def split_arguments(e: Engine) -> DataFrame:
    return table(e, "nth int, piece string", *enumerate(readers.split_arguments("f(a, 'x,y'), [1, 2], b", "pg")))


DDL = {"mysql": "CREATE TABLE `t` (`a` INT NOT NULL, `b` VARCHAR(10), `c` DECIMAL(8,2), `d` DATETIME, e ENUM('x','y'), PRIMARY KEY (`a`), FOREIGN KEY (`a`) REFERENCES `u` (`k`))", "pg": 'CREATE TABLE t (a int NOT NULL, b text, c numeric(8,2), d timestamp, PRIMARY KEY (a), FOREIGN KEY (a) REFERENCES u (k))', "oracle": 'CREATE TABLE t ("A" NUMBER(9) NOT NULL, "B" VARCHAR2(10), c NUMBER(8,2), d TIMESTAMP, PRIMARY KEY ("A"))'}


@query(values("dialect, n, keys, fks, not_null", ("mysql", 5, "a", 1, "a"), ("oracle", 4, "a", 0, "a"), ("pg", 4, "a", 1, "a")))
def ddl_to_schema(e: Engine) -> DataFrame:
    out = []
    for dialect, sql in DDL.items():
        t = readers.parse_ddl(sql, dialect)
        out.append((dialect, len(t.schema()), ",".join(t.primary_key).lower(), len(t.foreign_keys), ",".join(c.name for c in t.columns if not c.nullable).lower()))
    return table(e, "dialect string, n int, keys string, fks int, not_null string", *out)


@query(values("dialect, same, fk", ("mysql", True, 1), ("oracle", True, 1), ("pg", True, 1)))
def ddl_round_trip(e: Engine) -> DataFrame:
    """CREATE TABLE and foreign keys as each dialect writes them, read again: names, keys and order of columns stay."""
    t = readers.parse_ddl(DDL["pg"], "pg")
    out = []
    for dialect in DDL:
        again = readers.parse_ddl(t.ddl(dialect), dialect)
        out.append((dialect, [c.name.lower() for c in again.columns] == ["a", "b", "c", "d"] and again.primary_key == t.primary_key, len(t.foreign_key_ddl(dialect))))
    return table(e, "dialect string, same boolean, fk int", *out)


@query(values("part, n", ("ddl", 1), ("fk", 1), ("idx", 1)))
def schema_dump(e: Engine) -> DataFrame:
    t = readers.parse_ddl(DDL["mysql"], "mysql")
    t.indexes = [["b", "c"]]
    return table(e, "part string, n int", *[(part, len(texts)) for part, texts in readers.dump_schema([t], "pg").items()])


@query("SELECT s_nationkey, 2 * count(*) AS n FROM supplier GROUP BY s_nationkey")
def bulk_insert(e: Engine) -> DataFrame:
    path = place(e)
    for _ in range(2):
        readers.append(e.table("supplier"), path)
    return e.spark.read.parquet(path).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def build_database(e: Engine) -> DataFrame:
    """A database made of two tables, read by name, and dropped again."""
    name = f"db_{uuid.uuid4().hex[:8]}"
    readers.build_database(e.spark, name, {t: e.table(t) for t in ("nation", "region")})
    found = [(t, e.spark.table(f"{name}.{t}").count()) for t in readers.catalog_tables(e.spark, name)]
    readers.drop_database(e.spark, name)
    return table(e, "name string, n long", *found)


@query(values("name, type", ("k", "int"), ("n", "bigint"), ("x", "double")))
def result_types(e: Engine) -> DataFrame:
    return table(e, "name string, type string", *e.result_types("SELECT s_nationkey AS k, count(*) AS n, max(s_acctbal) AS x FROM supplier GROUP BY s_nationkey", "pg"))


@query(values("sql, ok", ("SELECT n_name FROM nation", True), ("SELECT nothing FROM nation", False)))
def explain_probe(e: Engine) -> DataFrame:
    return table(e, "sql string, ok boolean", *[(q, e.compiles(q, "pg")[0]) for q in ("SELECT n_name FROM nation", "SELECT nothing FROM nation")])


@query(values("which, merged", ("agree", "a=1,b=2"), ("differ", None)))
def session_parameters(e: Engine) -> DataFrame:
    show = lambda d: None if d is None else ",".join(f"{k}={v}" for k, v in sorted(d.items()))
    return table(e, "which string, merged string", ("agree", show(rules.merge_parameters({"a": "1"}, {"a": "1", "b": "2"}))), ("differ", show(rules.merge_parameters({"a": "1"}, {"a": "2"}))))


@query(values("which, n", ("alone", 1), ("shared", 0)))
def isolated_session(e: Engine) -> DataFrame:
    """A view that is made in a session of its own is seen there and nowhere else."""
    name, other = f"seen_{uuid.uuid4().hex[:8]}", e.isolated()
    other.spark.range(1).createOrReplaceTempView(name)
    return table(e, "which string, n int", ("alone", int(other.spark.catalog.tableExists(name))), ("shared", int(e.spark.catalog.tableExists(name))))


# names and catalogs


@query(values("name, ref, cols", ("t2", "u2", "a,bb"), ("t2", "u2", "a,bb")).replace("VALUES ('t2', 'u2', 'a,bb'), ", "VALUES "))
def renamed_schema(e: Engine) -> DataFrame:
    t = readers.parse_ddl("CREATE TABLE t (a INT, b INT, FOREIGN KEY (a) REFERENCES u (k))", "pg").renamed("t", "t2").renamed("u", "u2").with_column_renamed("b", "bb")
    return table(e, "name string, ref string, cols string", (t.name, t.foreign_keys[0][1], ",".join(c.name for c in t.columns)))


@query(values("name, short", ("short", "short"), ("a_quite_long_identifier_of_many_parts", "a_qui_lon_identif_o_man_par")))
def shortened_names(e: Engine) -> DataFrame:
    return table(e, "name string, short string", *[(x, revision.shorten(x)) for x in ("short", "a_quite_long_identifier_of_many_parts")])


@query(values('"column", "left", "right"', ("a", "int", "bigint"), ("b", "string", None), ("c", None, "string")))
def schema_comparison(e: Engine) -> DataFrame:
    x, y = (revision.catalog_frame(e.spark, [readers.parse_ddl(s, "pg")]) for s in ("CREATE TABLE t (a INT, b TEXT)", "CREATE TABLE T (A BIGINT, c TEXT)"))
    return revision.schema_difference(x, y).select("column", "left", "right")


@query(values("type, n", ("int", 1), ("string", 2), ("timestamp_ntz", 1)))
def type_census(e: Engine) -> DataFrame:
    return revision.type_census(revision.catalog_frame(e.spark, [readers.parse_ddl("CREATE TABLE t (a INT, b TEXT, c TEXT, d TIMESTAMP)", "pg")])).select("type", F.col("n").cast("int").alias("n"))


@query(values('"table", "other"', ("t", "u"), ("u", "t")))
def foreign_key_neighbours(e: Engine) -> DataFrame:
    return revision.neighbours(e.spark, [readers.parse_ddl("CREATE TABLE t (a INT, FOREIGN KEY (a) REFERENCES u (k))", "pg")])


@query(values("name, dialect, quoted", ("plain", "pg", "plain"), ("order", "pg", '"order"'), ("Two words", "mysql", "`Two words`")))
def quoted_names(e: Engine) -> DataFrame:
    return table(e, "name string, dialect string, quoted string", *[(n, d, analysis.quoted_name(n, d)) for n, d in (("plain", "pg"), ("order", "pg"), ("Two words", "mysql"))])


# analysis of query texts

SAMPLE = "WITH a AS (SELECT * FROM t), b AS (SELECT * FROM a JOIN u ON true) SELECT x, sum(y) AS s, count(*) OVER () AS c FROM b, (SELECT * FROM v) w WHERE EXISTS (SELECT 1 FROM s.z) GROUP BY ROLLUP (x, k) ORDER BY 1"


@query(values("what, found", ("base tables", "t,u,v,z"), ("ctes", "a,b"), ("aggregates", "sum"), ("grouped", "x,k"), ("ordered", "true"), ("relations", "b,derived"), ("selects", "5"), ("all relations", "7"), ("names", "a,col_1,A_1,a_2"), ("clauses", "from_tables,group_by,having,select_list,where")))
def query_analysis(e: Engine) -> DataFrame:
    q = parse(SAMPLE, "pg")
    column = lambda n: n.parts["parts"][-1].text
    rows = [
        ("base tables", ",".join(sorted(analysis.base_tables(q)))),
        ("ctes", ",".join(name for name, _, _ in analysis.ctes(q)[1])),
        ("aggregates", ",".join(n.name for n in analysis.aggregated(q.body))),
        ("grouped", ",".join(map(column, analysis.grouping_columns(q.body)))),
        ("ordered", str(compare.has_outer_order(q) and analysis.has_limit_or_order(q)).lower()),
        ("relations", ",".join(name for name, _ in analysis.relations(q.body))),
        ("selects", str(analysis.select_blocks(q))),
        ("all relations", str(analysis.relation_count(q))),
        ("names", ",".join(analysis.unique_names(["a", None, "A", "a"]))),
        ("clauses", ",".join(sorted(analysis.components("SELECT a FROM t WHERE b GROUP BY a HAVING true", "pg")))),
    ]
    return table(e, "what string, found string", *rows)


@query(values("what, n", ("all", 7), ("span", 2)))
def token_spans(e: Engine) -> DataFrame:
    sql = "SELECT 'a b', x FROM t"
    return table(e, "what string, n int", ("all", analysis.token_count(sql, "pg")), ("span", analysis.span_tokens(sql, "pg", 7, 12)))


@query(values("text, kind", ("1 + 2", "int"), ("1.5", "num"), ("'x'", "str"), ("DATE '2020-01-01'", "date"), ("a AND b", "bool"), ("INTERVAL '1' DAY", "interval")))
def types_of_operands(e: Engine) -> DataFrame:
    from .spark_sql import Printer

    texts = ["1 + 2", "1.5", "'x'", "DATE '2020-01-01'", "a AND b", "INTERVAL '1' DAY"]
    return table(e, "text string, kind string", *[(t, Printer("pg", {}).type_of(parse_expression(t, "pg"))) for t in texts])


@query("SELECT o_orderpriority AS points, count(*) AS n, 2 * count(*) AS twice FROM orders GROUP BY 1")
def counted_rules(e: Engine) -> DataFrame:
    """Rules of all orders as counted multisets: each order's added up, and added to themselves."""
    counted = e.table("orders").groupBy("o_orderpriority").count().collect()  # a row a priority
    points: list[dict] = []
    for r in counted:
        points = analysis.points_union(points, [{"point": r[0], "num": r[1]}])
    twice = analysis.points_union(points, points)
    assert analysis.points_equal(twice, list(reversed(twice))) and not analysis.points_equal(points, twice)
    return table(e, "points string, n long, twice long", *[(a["point"], a["num"], b["num"]) for a, b in zip(points, twice, strict=True)])


@query("SELECT count(DISTINCT lower(regexp_replace(p_name, '\\s+', '', 'g'))) AS n FROM part")
def folded_names(e: Engine) -> DataFrame:
    return e.table("part").select(F.lower(F.regexp_replace("p_name", r"\s+", "")).alias("k")).agg(F.countDistinct("k").alias("n"))


# rewriting and composition, run on the data


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), coalesce(o_orderstatus, 'none')) AS p, CASE WHEN o_custkey > 10 THEN strpos(o_orderpriority, 'I') ELSE 0 END AS i FROM orders")
def tree_rewritten(e: Engine) -> DataFrame:
    sql = "SELECT o_orderkey, IFNULL((nullif(o_orderpriority, '5-LOW')), IFNULL(o_orderstatus, 'none')) AS p, IF(o_custkey > 10, INSTR( (o_orderpriority) , 'I'), 0) AS i FROM orders"
    return e.run(rules.TreeRewriter(rules.builtin_rules(), "mysql", "pg", e.catalog(sql, "mysql")).rewrite(sql), "pg")


@query(values("what, made", ("pattern", "F(,hole a NUMBER many,)"), ("kind", "STRING optional"), ("loop", "(x || y)"), ("function", "TO_CHAR(d, 'YYYY')"), ("pinned", "true")))
def rule_parts(e: Engine) -> DataFrame:
    parts = rules.parse_pattern("F(<a: LIST[NUMBER]>)")
    shown = ",".join(p if isinstance(p, str) else f"hole {p.name} {p.kind}{' many' if p.many else ''}" for p in parts)
    hole = rules.parse_hole("x", "OPTION[STRING]")
    rewrite = lambda sql: rules.Rewriter(rules.builtin_rules(), "mysql", "pg", {"t": {"d": "date"}}).rewrite(sql)
    pinned = "2024-01-15 12:00:00" in repr(compare.pin_volatile("SELECT NOW() AS t", "mysql"))
    rows = [("pattern", shown), ("kind", f"{hole.kind}{' optional' if hole.optional else ''}"), ("loop", rewrite("SELECT CONCAT(x, y)").removeprefix("SELECT ")), ("function", rewrite("SELECT DATE_FORMAT(d, '%Y')").removeprefix("SELECT ")), ("pinned", str(pinned).lower())]
    return table(e, "what string, made string", *rows)


@query("SELECT n_regionkey, n_name, n_nationkey, 0.0 AS f, n_nationkey * 2 AS twice FROM nation WHERE (n_regionkey = 1 OR n_regionkey = 2) AND n_nationkey > 3 UNION ALL SELECT r_regionkey, r_name, 0, 0.0, 0 FROM region WHERE r_regionkey > 1")
def composed_query(e: Engine) -> DataFrame:
    """Columns swapped, dropped, filled and added, and a condition added, in each branch of a query."""
    sql = "SELECT n_name, n_regionkey, n_nationkey, 'gone' AS g FROM nation WHERE n_regionkey = 1 OR n_regionkey = 2 UNION ALL SELECT r_name, r_regionkey, 0, 'gone' FROM region"
    sql = compose.drop_column(compose.swap_columns(sql, 0, 1, "pg"), 3, "pg")
    sql = compose.add_filler(sql, 3, "num", "f", "pg")
    sql = compose.add_projection(sql, ["n_nationkey * 2", "0"], "twice", "pg")
    return e.run(compose.add_predicate(sql, ["n_nationkey > 3", "r_regionkey > 1"], "pg"), "pg")


@query("SELECT n_name, coalesce(n_name, n_name) AS point_1 FROM nation UNION ALL SELECT r_name, coalesce(r_name, r_name) FROM region")
def function_rule(e: Engine) -> DataFrame:
    """A rule put into the select list of each branch, and rewritten for the other dialect."""
    rule = next(r for r in rules.builtin_rules() if r.description == "ifnull" and r.dialects == ("mysql", "pg"))
    sql = compose.add_function_rule("SELECT n_name FROM nation UNION ALL SELECT r_name FROM region", rule, [{"n_name": "str"}, {"r_name": "str"}], rule_functions.Context(), "mysql")
    return e.run(rules.TreeRewriter([rule], "mysql", "pg", e.catalog(sql, "mysql")).rewrite(sql), "pg")


@query("SELECT name FROM (VALUES ('a', true), ('c', true)) v(name, ok)")
def seed_queries(e: Engine) -> DataFrame:
    corpus = table(e, "name string, sql string", ("a", "SELECT x, count(*) FROM t WHERE y GROUP BY x"), ("b", "SELECT 'GROUP BY' FROM t WHERE y"), ("c", "select max(x) from t where y group by z order by 1"), ("d", "SELECT x FROM t GROUP BY x"))
    return compose.fulfilling(corpus, ["where", "group", "aggregate"]).select("name")


@query(values("word, found", ("n_name", "nation.n_name"), ("region", "region")))
def keyword_uses(e: Engine) -> DataFrame:
    catalog = e.catalog("SELECT * FROM nation, region", "pg")
    return table(e, "word string, found string", *[(w, ",".join(t if c is None else f"{t}.{c}" for t, c in compose.keyword_uses(w, catalog))) for w in ("n_name", "region")])


@query("SELECT * FROM (VALUES (20, 40)) v(low, high)")
def padded_query(e: Engine) -> DataFrame:
    """A query united with others until it is thirty tokens longer, ten more or less."""
    base = "SELECT n_name FROM nation"
    n = analysis.token_count(generate.pad(base, ["SELECT r_name FROM region"], "pg", 30), "pg") - analysis.token_count(base, "pg")
    return table(e, "low int, high int", (20 if n >= 20 else n, 40 if n <= 40 else n))


@query(values("point, num", ("ifnull", 1), ("limit", 1)))
def generated_pairs(e: Engine) -> DataFrame:
    found = generate.pairs(e, ["SELECT IFNULL(n_name, 'x') AS n FROM nation", "SELECT 1", "SELECT o_orderkey FROM orders LIMIT 2, 3"], rules.builtin_rules(), "mysql", "pg", 5, seed=3)
    return table(e, "point string, num int", *[(p["point"], p["num"]) for f in found for p in f["points"]])


@query("SELECT o_orderpriority AS v FROM orders GROUP BY 1")
def sampled_values(e: Engine) -> DataFrame:
    return table(e, "v string", *[(v,) for v in generate.sample_values(e.table("orders"), "o_orderpriority", 1000, 7)])


# segments and retrieval


@query("SELECT coalesce(o_orderpriority, 'x') AS p, count(*) AS n FROM orders GROUP BY 1")
def translated_by_segments(e: Engine) -> DataFrame:
    """A rule that makes what can't be planned is left out, and the next one is used."""
    bad = rules.Rule("bad", "IFNULL(<a: ANY_VALUE>, <b: ANY_VALUE>)", "NO_SUCH_THING(<a>, <b>)", ("mysql", "pg"))
    out, _ = segments.translate(e, "SELECT IFNULL(o_orderpriority, 'x') AS p, COUNT(*) AS n FROM orders GROUP BY IFNULL(o_orderpriority, 'x')", [bad, *rules.builtin_rules()], "mysql", "pg")
    return e.run(out, "pg")


@query(values("what, found", ("matching", "max"), ("masked", "SELECT <column_1: string> FROM <table_2> WHERE <column_3: int> = <number_4>"), ("located", "nothing_like_it"), ("ddl", "1")))
def query_pieces(e: Engine) -> DataFrame:
    sql = "SELECT n_name FROM nation WHERE n_nationkey = 3"
    wrong = "SELECT upper(nothing_like_it(n_name)) FROM nation"
    rows = [
        ("matching", segments.matching(parse("SELECT a FROM t WHERE b IN (SELECT max(c) FROM u)", "pg"), ["IN", "MAX"])[0].node.get("name") or "max"),
        ("masked", segments.masked(sql, "pg", e.catalog(sql, "pg"))[0]),
        ("located", segments.locate(wrong, "pg", e.compiles(wrong, "pg")[1]).node.name),
        ("ddl", str(len(segments.ddl_for([readers.parse_ddl("CREATE TABLE nation (n_nationkey INT)", "pg")], sql, "mysql")))),
    ]
    return table(e, "what string, found string", *rows)


STORED = "CAST(round(greatest(0, least(100, (1 - (1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / 2) * 100)), 2) AS DOUBLE)"


@query(f"SELECT q, kind, id, score FROM (SELECT CAST(a.vec_id AS VARCHAR) AS q, CAST(b.label AS VARCHAR) AS kind, CAST(b.vec_id AS VARCHAR) AS id, {STORED} AS score, row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, CAST(b.vec_id AS VARCHAR)) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 7 <> 3 AND b.label < 3) WHERE r <= 2")
def vector_store(e: Engine) -> DataFrame:
    """All embeddings inserted, some deleted, and the two best of each kind for every hundredth of them."""
    t = e.table("embeddings")
    store = vectors.VectorStore(e.spark, place(e))
    rows = t.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("kind"), F.lit("").alias("text"), F.create_map().cast("map<string,string>").alias("metadata"), F.col("embedding").alias("vector"), "vec_id")
    store.insert(rows)
    store.delete(rows.filter("vec_id % 7 = 3"))
    return store.search(rows.filter("vec_id % 100 = 0"), 2, ["0", "1", "2"]).select(F.col("query").alias("q"), "kind", "id", "score")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged(e: Engine) -> DataFrame:
    t = e.table("orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("k"))
    return segments.page(t, ["k", "o_orderkey"], 3, 20).select("o_orderkey", "o_totalprice")


# changes, rest of the dialects


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer")
def insert_on_duplicate(e: Engine) -> DataFrame:
    own = Engine(e.spark, e.directory).add("customer", e.table("customer"), key=["c_custkey"])
    own.add("changed", e.table("customer").filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(1.0)))
    return changes.execute(own, "INSERT INTO customer SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM changed ON DUPLICATE KEY UPDATE c_acctbal = VALUES(c_acctbal) + c_acctbal", "mysql")[1]


@query("SELECT * FROM supplier")
def load_data(e: Engine) -> DataFrame:
    """What LOAD DATA and COPY do: a delimited file into a table."""
    t, path = e.table("supplier"), place(e)
    t.write.csv(path, header=True)
    into = place(e)
    readers.append(readers.read_csv(e.spark, path, t.schema), into)
    return e.spark.read.parquet(into)


# streams


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def stream_state(e: Engine) -> DataFrame:
    """A stream with state of its own, run over all events."""
    source = e.table("events")
    stream = e.spark.readStream.schema(source.schema).parquet(f"{e.directory}/events.parquet*")
    name, path = f"state_{uuid.uuid4().hex[:8]}", place(e)
    q = windows.running(stream, "event_type", "event_id").writeStream.outputMode("update").option("checkpointLocation", f"{path}-checkpoint").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return e.spark.table(name).groupBy("event_type").agg(F.max("n").alias("n"), F.max("last").alias("last"))


@query("SELECT count(*) AS n FROM events")
def stream_unique(e: Engine) -> DataFrame:
    source = e.table("events")
    stream = e.spark.readStream.schema(source.schema).parquet(f"{e.directory}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = stream.union(stream)
    path = place(e)  # rows go to files; a memory sink keeps them all in the driver
    q = windows.unique(twice, ["event_id"], "ts", "100 days").select("event_id").writeStream.outputMode("append").option("checkpointLocation", f"{path}-checkpoint").format("parquet").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return e.spark.read.schema(source.select("event_id").schema).parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey")
def select_into(e: Engine) -> DataFrame:
    own = Engine(e.spark, e.directory)
    changes.execute(own, "SELECT s_nationkey AS k, count(*) AS n INTO counted FROM supplier GROUP BY s_nationkey", "pg")
    return own.run("SELECT k, n FROM counted", "pg")


@query("SELECT o_orderstatus AS k, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderstatus")
def own_aggregate(e: Engine) -> DataFrame:
    """An aggregate that a user defines, from partial results of any split of the rows."""
    from ..operators.relational import aggregate

    return aggregate(e.table("orders"), ["o_orderstatus"], "o_totalprice", lambda x: (x.min(), x.max()), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: s[1] - s[0], "spread").select(F.col("o_orderstatus").alias("k"), "spread")
