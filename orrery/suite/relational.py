"""The plan algebra over the trade tables: scans, joins, aggregates, windows, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates
from ..plans.vector_sql import Database, register, rewrite
from ..registry import query
from .common import query_vector, r6, t


@query("scan_project_filter", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS revenue FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R'")
def scan_project_filter(spark, d):
    x = t(spark, d, "lineitem").where("l_quantity < 5 AND l_returnflag = 'R'")
    return x.select("l_orderkey", "l_linenumber", r6(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    x = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


_JOIN = "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
for _hint in (None, "broadcast", "merge", "shuffle_hash"):

    def _joined(hint):
        def run(spark, d):
            c = t(spark, d, "customer")
            c = c.hint(hint) if hint else c
            j = t(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

        return run

    query(f"join_{_hint or 'default'}", _JOIN)(_joined(_hint))


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("join_full", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, count(c_custkey) AS customers, count(s_suppkey) AS suppliers FROM (SELECT * FROM customer WHERE c_acctbal < 0) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal < 0) ON c_nationkey = s_nationkey GROUP BY 1")
def join_full(spark, d):
    c, s = t(spark, d, "customer").where("c_acctbal < 0"), t(spark, d, "supplier").where("s_acctbal < 0")
    j = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full")
    return j.groupBy(F.coalesce("c_nationkey", "s_nationkey").alias("nation")).agg(F.count("c_custkey").alias("customers"), F.count("s_suppkey").alias("suppliers"))


@query("join_semi", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def join_semi(spark, d):
    return t(spark, d, "part").join(t(spark, d, "lineitem").where("l_quantity > 49"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def join_theta(spark, d):
    n = t(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_name") < F.col("b.n_name"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("join_cross", "SELECT count(*) AS n, count(DISTINCT r_name) AS regions FROM nation CROSS JOIN region")
def join_cross(spark, d):
    return t(spark, d, "nation").crossJoin(t(spark, d, "region")).agg(F.count("*").alias("n"), F.count_distinct("r_name").alias("regions"))


@query("agg_basic", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_basic(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), r6(F.avg("value")).alias("mean"), r6(F.min("value")).alias("least"), r6(F.max("value")).alias("most"), F.count_distinct("user_id").alias("users"))


@query("agg_spread", "SELECT event_type, round(stddev_samp(value), 6) AS samp, round(stddev_pop(value), 6) AS pop, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def agg_spread(spark, d):
    p = lambda q: r6(F.percentile("value", F.lit(q)))
    return t(spark, d, "events").groupBy("event_type").agg(r6(F.stddev_samp("value")).alias("samp"), r6(F.stddev_pop("value")).alias("pop"), p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("agg_latency_stats", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def agg_latency_stats(spark, d):
    return aggregates.latency_stats(t(spark, d, "events"), ["event_type"], "value").select("event_type", *[r6(c).alias(c) for c in ("p50", "p95", "p99", "mean", "std")])


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def agg_having(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("agg_collect", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg_collect(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("agg_weighted_quantile", "WITH c AS (SELECT l_returnflag, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS c FROM lineitem) SELECT l_returnflag, min(l_extendedprice) AS quantile FROM c WHERE c >= 0.5 GROUP BY 1")
def agg_weighted_quantile(spark, d):
    return aggregates.weighted_quantile(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 0.5)


@query("agg_evidence", "SELECT user_id, count(*) AS n, round(max(value), 6) AS confidence FROM events GROUP BY 1")
def agg_evidence(spark, d):
    return aggregates.group_evidence(t(spark, d, "events"), "user_id", "value").select("user_id", "n", r6("confidence").alias("confidence"))


@query("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def sort_limit_offset(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10)


@query("window_top_per_group", "SELECT * FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)::INTEGER AS rn FROM nation) WHERE rn <= 2")
def window_top_per_group(spark, d):
    w = W.partitionBy("n_regionkey").orderBy("n_name")
    return t(spark, d, "nation").select("n_regionkey", "n_name", F.row_number().over(w).alias("rn")).where("rn <= 2")


@query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return set_union_all(spark, d).distinct()


@query("set_minus", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def set_minus(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return t(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("case_when", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS class, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS building FROM customer")
def case_when(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high").alias("class"), F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("building"))


@query("string_functions", "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name)::INTEGER AS n, substring(p_name, 2, 3) AS part, replace(p_type, 'A', '_') AS rep, starts_with(p_name, 'p') AS s, contains(p_type, 'E') AS c, concat(p_brand, '-', p_size) AS joined, trim(concat('  ', p_brand, ' ')) AS trimmed FROM part")
def string_functions(spark, d):
    n = F.col("p_name")
    return t(spark, d, "part").select("p_partkey", F.upper(n).alias("up"), F.lower("p_brand").alias("low"), F.length(n).alias("n"), F.substring(n, 2, 3).alias("part"), F.replace("p_type", F.lit("A"), F.lit("_")).alias("rep"), n.startswith("p").alias("s"), F.col("p_type").contains("E").alias("c"), F.concat("p_brand", F.lit("-"), "p_size").alias("joined"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"))


@query("math_functions", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, c_custkey % 7 AS m, c_custkey // 7 AS dv FROM customer")
def math_functions(spark, d):
    b = F.col("c_acctbal")
    return t(spark, d, "customer").select("c_custkey", F.abs(b).alias("a"), F.ceil(b).alias("c"), F.floor(b).alias("f"), r6(F.sqrt(F.abs(b))).alias("s"), r6(F.log(F.abs(b) + 1)).alias("l"), (F.col("c_custkey") % 7).alias("m"), F.expr("c_custkey div 7").alias("dv"))


@query("date_functions", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS dd, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate)::INTEGER AS days FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' - INTERVAL 7 DAY")
def date_functions(spark, d):
    x = t(spark, d, "orders").where("o_orderdate >= TIMESTAMP '1995-01-01' - INTERVAL 7 DAYS")
    o = F.col("o_orderdate")
    return x.select("o_orderkey", F.year(o).alias("y"), F.month(o).alias("m"), F.day(o).alias("dd"), F.datediff(o, F.lit("1992-01-01")).alias("days"))


@query("hash_functions", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation")
def hash_functions(spark, d):
    b = F.col("n_name").cast("binary")
    return t(spark, d, "nation").select("n_nationkey", F.md5(b).alias("m"), F.sha1(b).alias("s1"), F.sha2(b, 256).alias("s2"))


@query("json_functions", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_functions(spark, d):
    return t(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("list_functions", "SELECT n_regionkey, len(l)::INTEGER AS n, l[1] AS head, l[len(l)] AS last, list_contains(l, 'nation_3') AS has FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1)")
def list_functions(spark, d):
    x = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return x.select("n_regionkey", F.size("l").alias("n"), F.get("l", F.lit(0)).alias("head"), F.element_at("l", -1).alias("last"), F.array_contains("l", "nation_3").alias("has"))


@query("recursive_levels", "WITH RECURSIVE r(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM r WHERE n < 10) SELECT n::INTEGER AS n, total::INTEGER AS total FROM r")
def recursive_levels(spark, d):
    return spark.sql("WITH RECURSIVE r(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM r WHERE n < 10) SELECT n, total FROM r")


@query("vector_sql", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_distance(embedding::DOUBLE[], v::DOUBLE[]), 6) AS distance FROM embeddings, q WHERE label = 2 ORDER BY list_distance(embedding::DOUBLE[], v::DOUBLE[]), vec_id LIMIT 5")
def vector_sql(spark, d):
    register(spark)
    t(spark, d, "embeddings").createOrReplaceTempView("orrery_embeddings")
    q = "[" + ", ".join(map(repr, query_vector(spark, d))) + "]"
    return spark.sql(rewrite(f"SELECT vec_id, round(embedding <-> {q}, 6) AS distance FROM orrery_embeddings WHERE label = 2 ORDER BY embedding <-> {q}, vec_id LIMIT 5"))


__all__ = ["Database"]
