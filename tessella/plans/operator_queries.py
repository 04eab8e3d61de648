"""Queries over the DataFrame operators, with the same question in DuckDB's SQL where SQL can ask it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, relational
from ..sources import revision
from ..streaming import windows
from . import generate, rules
from .analysis import token_count
from .engine import Engine
from .workload import Q as WORKLOAD

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Engine(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# frames, joins and top-k

GROUPS = "PARTITION BY o_orderstatus ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW"


@query(f"SELECT o_orderkey, count(*) OVER ({GROUPS}) AS n, CAST(sum(o_custkey) OVER ({GROUPS}) AS BIGINT) AS s FROM orders")
def win_groups(e: Engine) -> DataFrame:
    return relational.groups_frame(e.table("orders"), ["o_orderstatus"], "o_orderpriority", -1, 0, {"n": F.count(F.lit(1)), "s": F.sum("o_custkey")}).select("o_orderkey", "n", "s")


@query("SELECT p_partkey, r.k AS band FROM part JOIN (SELECT CAST(range AS BIGINT) AS k, 900 + range * 7.5 AS lo, 905 + range * 7.5 AS hi FROM range(60)) r ON p_retailprice >= lo AND p_retailprice < hi")
def range_join(e: Engine) -> DataFrame:
    bands = e.spark.range(60).select(F.col("id").alias("k"), (900 + F.col("id") * 7.5).alias("lo"), (905 + F.col("id") * 7.5).alias("hi"))
    return relational.range_join(e.table("part"), bands, "p_retailprice", "lo", "hi", 10.0).select("p_partkey", F.col("k").alias("band"))


@query("SELECT c.event_id, p.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') p ON c.user_id = p.user_id AND c.ts >= p.ts")
def asof_join(e: Engine) -> DataFrame:
    ev = e.table("events").select("event_id", "user_id", "ts", "event_type")
    buys = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = ev.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("before"))
    return relational.asof_join(buys, clicks, ["user_id"], "ts", ["before"]).select("event_id", "before")


@query("SELECT 1 AS k, '1,1,2,3,1,3' AS u, '1,3' AS i, '1,2' AS x, '1,3' AS d")
def multiset_ops(e: Engine) -> DataFrame:
    a, b = F.array(*map(F.lit, (1, 1, 2, 3))), F.array(*map(F.lit, (1, 3)))
    text = lambda c: F.array_join(c, ",")
    return e.spark.range(1).select(F.lit(1).alias("k"), text(relational.multiset(a, b, "UNION")).alias("u"), text(relational.multiset(a, b, "INTERSECT")).alias("i"), text(relational.multiset(a, b, "EXCEPT")).alias("x"), text(relational.multiset(a, b, "INTERSECT", False)).alias("d"))


COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT q, v, CAST(r AS INT) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE r <= 5")
def cosine_topk(e: Engine) -> DataFrame:
    vectors = e.table("embeddings")
    return relational.cosine_topk(vectors.filter("vec_id % 20 = 0"), vectors, 5, "vec_id", "embedding").select("q", "v", "rank")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def dedup_best_per_key(e: Engine) -> DataFrame:
    return relational.best_per_key(e.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(None)
def tablesample(e: Engine) -> DataFrame:
    return e.run("SELECT l_orderkey, l_linenumber FROM lineitem TABLESAMPLE BERNOULLI (10) REPEATABLE (7)", "pg")


# changes to tables

NEW = "SELECT s_suppkey + 5 AS s_suppkey, 'new' AS s_name, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey >= 3"


@query("SELECT * FROM supplier UNION ALL SELECT s_suppkey + 100000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def insert_append(e: Engine) -> DataFrame:
    return e.table("supplier").unionAll(e.run("SELECT s_suppkey + 100000 AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0", "pg"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_nationkey END AS s_nationkey, CASE WHEN s_acctbal < 0 THEN -s_acctbal ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_overwrite(e: Engine) -> DataFrame:
    return relational.update(e.table("supplier"), F.col("s_acctbal") < 0, {"s_nationkey": F.lit(0), "s_acctbal": -F.col("s_acctbal")})


@query("SELECT * FROM supplier WHERE NOT (s_nationkey = 3)")
def delete_anti(e: Engine) -> DataFrame:
    return relational.delete(e.table("supplier"), F.col("s_nationkey") == 3)


@query(f"SELECT coalesce(t.s_suppkey, s.s_suppkey) AS s_suppkey, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_name ELSE t.s_name END AS s_name, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_nationkey ELSE t.s_nationkey END AS s_nationkey, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_acctbal ELSE t.s_acctbal END AS s_acctbal FROM supplier t FULL JOIN ({NEW}) s ON t.s_suppkey = s.s_suppkey WHERE NOT coalesce(s.s_nationkey = 7, false)")
def merge_upsert(e: Engine) -> DataFrame:
    return relational.merge_upsert(e.table("supplier"), e.run(NEW, "pg"), ["s_suppkey"], F.col("s.s_nationkey") == 7).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


# types and constraints


def _as_text(e: Engine) -> DataFrame:
    t = e.table("lineitem")
    return t.select(F.col("l_orderkey").cast("string").alias("k"), F.col("l_quantity").cast("string").alias("q"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), F.when(F.col("l_linenumber") == 3, "").otherwise(F.col("l_linenumber").cast("string")).alias("n"), F.col("l_returnflag").alias("f"))


@query("SELECT * FROM (VALUES ('k', 'int'), ('q', 'double'), ('d', 'date'), ('n', 'int'), ('f', 'string')) v(col, type)")
def type_revision(e: Engine) -> DataFrame:
    found = revision.revise(_as_text(e), {"k": "date", "q": "int", "d": "date", "n": "int", "f": "boolean"})
    return e.spark.createDataFrame(list(found.items()), "col string, type string")


@query("SELECT 'q' AS col, count(*) FILTER (l_quantity IS NOT NULL) AS bad FROM lineitem UNION ALL SELECT 'd', 0 UNION ALL SELECT 'n', 0 UNION ALL SELECT 'f', count(*) FILTER (l_returnflag = 'N') FROM lineitem")
def value_check(e: Engine) -> DataFrame:
    return revision.value_errors(_as_text(e), {"q": "int", "d": "date", "n": "int", "f": "string"}, {"f": ["A", "R"]}).select(F.col("column").alias("col"), "bad")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def fk_violations(e: Engine) -> DataFrame:
    return revision.foreign_key_violations(e.table("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], e.table("customer").filter("c_custkey % 10 != 0"), ["c_custkey"]).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_violations(e: Engine) -> DataFrame:
    return revision.primary_key_violations(e.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def enum_check(e: Engine) -> DataFrame:
    return revision.enum_violations(e.table("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


# verification

Q1, Q6 = WORKLOAD["tpch_q1"][1], WORKLOAD["tpch_q6"][1]
Q6_MYSQL = "SELECT round(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07 AND NOT l_quantity >= 24"


@query("SELECT true AS execution, true AS ori_execution, 0 AS differing")
def verify_exact(e: Engine) -> DataFrame:
    r = compare.verify(e, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", "pg", "SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t ON c_custkey = o_custkey", "mysql")
    return e.spark.createDataFrame([(r.execution, r.ori_execution, int(bool(r.ori_execution_reason)))], "execution boolean, ori_execution boolean, differing int")


@query("SELECT true AS execution, false AS ori_execution")
def verify_tolerant(e: Engine) -> DataFrame:
    r = compare.verify(e, "SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey", "pg", "SELECT o_custkey, SUM(o_totalprice * 1.00000001) AS s FROM orders GROUP BY o_custkey", "oracle")
    return e.spark.createDataFrame([(r.execution, r.ori_execution)], "execution boolean, ori_execution boolean")


@query("SELECT true AS execution, true AS ori_execution")
def verify_ordered(e: Engine) -> DataFrame:
    r = compare.verify(e, Q1, "pg", Q1.replace("ORDER BY l_returnflag, l_linestatus", "ORDER BY concat(l_returnflag, l_linestatus)"), "mysql")
    return e.spark.createDataFrame([(r.execution, r.ori_execution)], "execution boolean, ori_execution boolean")


BY_KEY = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 0 ORDER BY o_orderkey"


@query("SELECT 'equal' AS which, true AS execution, true AS ori_execution, '' AS reason UNION ALL SELECT 'ties', true, true, '' UNION ALL SELECT 'swapped', false, false, '2 rows differ'")
def verify_ordered_large(e: Engine) -> DataFrame:
    """All of orders in the order of its key, against the same with a condition that every row meets; by a key with many ties; and with the places of two rows exchanged."""
    plain = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey"
    ties = "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus"
    swapped = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN -1 WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN (SELECT max(o_orderkey) FROM orders) ELSE o_orderkey END"
    found = [
        (name, r.execution, r.ori_execution, r.ori_execution_reason)
        for name, r in (
            ("equal", compare.verify(e, plain, "pg", BY_KEY, "mysql")),
            ("ties", compare.verify(e, ties, "pg", ties.replace("ORDER BY o_orderstatus", "WHERE o_orderkey IS NOT NULL ORDER BY 1"), "mysql")),
            ("swapped", compare.verify(e, plain, "pg", swapped, "pg")),
        )
    ]
    return e.spark.createDataFrame(found, "which string, execution boolean, ori_execution boolean, reason string")


NEG = "SELECT o_orderkey, o_custkey FROM orders"


@query("SELECT count(*) AS differing FROM ((SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END FROM orders) UNION ALL (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders))")
def verify_negative(e: Engine) -> DataFrame:
    both = compare.aligned(e.run(NEG, "pg"), e.run("SELECT o_orderkey, CASE WHEN mod(o_orderkey, 50) = 0 THEN -1 ELSE o_custkey END AS o_custkey FROM orders", "mysql"))
    return compare.bag_difference(*both).agg(F.sum(F.abs("_n")).alias("differing"))


@query("SELECT true AS execution, 'UNKNOWN' AS formal")
def verify_q6(e: Engine) -> DataFrame:
    return compare.verify_row(e, Q6, "pg", Q6_MYSQL, "mysql").select("execution", "formal")


# composition and statistics


@query("SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS DOUBLE) AS c_acctbal FROM nation UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def merge_align(e: Engine) -> DataFrame:
    return generate.merge(e.run("SELECT n_nationkey AS k, n_name AS name FROM nation", "pg").withColumn("k", F.col("k").cast("long")), e.run("SELECT c_custkey, c_name, c_acctbal FROM customer", "pg"))


@query("SELECT n, m FROM (SELECT o_orderpriority AS m, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)")
def modal_sample(e: Engine) -> DataFrame:
    m = generate.modal_value(e.table("orders"), "o_orderpriority")
    return e.table("orders").filter(F.col("o_orderpriority") == m).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("m"))


@query(None)
def setcover_greedy(e: Engine) -> DataFrame:
    pairs = e.table("orders").select("o_custkey", F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("point"))
    return e.spark.createDataFrame([(k, x) for k, x in enumerate(relational.greedy_set_cover(pairs, "o_custkey", "point"))], "nth int, o_custkey long")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9A-Za-z]+|[^0-9A-Za-z\\s]')) AS INT) AS n FROM documents")
def tokens_per_doc(e: Engine) -> DataFrame:
    return e.table("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z]+|[^0-9A-Za-z\s]"), F.lit(0))).alias("n"))


@query("SELECT o_orderstatus AS pair, o_orderpriority AS category, o_custkey % 3 AS sub, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority, o_custkey % 3)")
def rule_census_rollup(e: Engine) -> DataFrame:
    return e.table("orders").select(F.col("o_orderstatus").alias("pair"), F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 3).alias("sub")).rollup("pair", "category", "sub").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS translator, round(100.0 * count(*) FILTER (o_orderstatus <> 'P') / count(*), 2) AS acc_ex, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) AS acc_res FROM orders GROUP BY 1")
def accuracy_matrix(e: Engine) -> DataFrame:
    share = lambda c, name: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 2).alias(name)
    return e.table("orders").groupBy(F.col("o_orderpriority").alias("translator")).agg(share(F.col("o_orderstatus") != "P", "acc_ex"), share(F.col("o_orderstatus") == "F", "acc_res"))


@query("SELECT l, count(*) AS n FROM (SELECT array_to_string(list_sort([o_orderstatus, o_orderpriority]), '+') AS l FROM orders) GROUP BY l")
def rule_combinations(e: Engine) -> DataFrame:
    return e.table("orders").select(F.array_join(F.array_sort(F.array("o_orderstatus", "o_orderpriority")), "+").alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def workload_tokens(e: Engine) -> DataFrame:
    return e.spark.createDataFrame([(name, d, token_count(t, d)) for name, (d, t, _) in WORKLOAD.items()], "name string, dialect string, tokens int")


@query("SELECT o_custkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS p, strftime(o_orderdate, '%Y-%m') AS m FROM orders")
def rewritten_query(e: Engine) -> DataFrame:
    sql = "SELECT o_custkey, IFNULL(nullif(o_orderpriority, '5-LOW'), 'none') AS p, DATE_FORMAT(o_orderdate, '%Y-%m') AS m FROM orders"
    return e.run(rules.Rewriter(rules.builtin_rules(), "mysql", "pg", e.catalog(sql, "mysql")).rewrite(sql), "pg")


# windows over time

@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def win_tumbling(e: Engine) -> DataFrame:
    return windows.tumbling(e.table("events"), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).drop("end")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(CAST(30 * i AS INTEGER)) AS start, count(*) AS n FROM events, range(2) t(i) GROUP BY 1")
def win_sliding(e: Engine) -> DataFrame:
    return windows.sliding(e.table("events"), "ts", "1 hour", "30 minutes", [], F.count(F.lit(1)).alias("n")).drop("end")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def win_session(e: Engine) -> DataFrame:
    return windows.sessions(e.table("events"), "ts", "2 hours", ["user_id"], F.count(F.lit(1)).alias("n")).drop("end")


def queries() -> dict:
    return dict(QUERIES)

