"""Graph traversals, Cypher, SPARQL, message passing and kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import graph as G
from ..operators import search
from ..plans import cypher, sparql
from ..registry import query
from ..sources import readers, writers
from .common import r6, t

_EDGES = "SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'IN_REGION' AS type, NULL::DOUBLE AS weight FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION', NULL FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION', NULL FROM supplier UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'PLACED', o_totalprice FROM orders"
_NODES = "SELECT 'region:' || r_regionkey AS id, 'Region' AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier' FROM supplier UNION ALL SELECT 'orders:' || o_orderkey, 'Order' FROM orders"


@query("graph_stats", f"SELECT 'label' AS kind, label AS name, count(*) AS n FROM ({_NODES}) GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM ({_EDGES}) GROUP BY 2")
def graph_stats(spark, d):
    return G.star_schema(spark, d).stats()


@query("graph_degrees", f"WITH e AS ({_EDGES}), o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1) SELECT v.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM ({_NODES}) v LEFT JOIN o ON o.id = v.id LEFT JOIN i ON i.id = v.id")
def graph_degrees(spark, d):
    return G.star_schema(spark, d).degrees()


@query("graph_neighbours", f"SELECT DISTINCT src AS id, dst AS neighbour FROM ({_EDGES}) WHERE type = 'IN_NATION'")
def graph_neighbours(spark, d):
    return G.star_schema(spark, d).neighbours("out", ["IN_NATION"])


@query("graph_two_hops", f"WITH e AS ({_EDGES}) SELECT a.src AS start, b.dst AS \"end\" FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'supplier:%'")
def graph_two_hops(spark, d):
    g = G.star_schema(spark, d)
    return g.walks(g.by_label("Supplier").select("id"), 2, 2).select("start", "end")


@query("graph_walks_1_3", f"WITH e AS ({_EDGES}), h1 AS (SELECT src AS start, dst AS \"end\", 1 AS hops FROM e WHERE src LIKE 'customer:%' AND type <> 'PLACED'), h2 AS (SELECT start, e.dst AS \"end\", 2 AS hops FROM h1 JOIN e ON h1.\"end\" = e.src), h3 AS (SELECT start, e.dst AS \"end\", 3 AS hops FROM h2 JOIN e ON h2.\"end\" = e.src) SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3")
def graph_walks_1_3(spark, d):
    g = G.star_schema(spark, d)
    return g.walks(g.by_label("Customer").select("id"), 1, 3, "out", ["IN_NATION", "IN_REGION"]).select("start", "end", "hops")


@query("graph_bfs", f"WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src AS x, dst AS y FROM e WHERE type <> 'PLACED' UNION SELECT dst, src FROM e WHERE type <> 'PLACED'), r(id, hops) AS (SELECT 'region:0', 0 UNION SELECT b.y, hops + 1 FROM r JOIN b ON b.x = r.id WHERE hops < 3) SELECT id, min(hops)::INTEGER AS hops FROM r GROUP BY 1")
def graph_bfs(spark, d):
    return G.star_schema(spark, d).bfs("region:0", 3, "both", ["IN_NATION", "IN_REGION"])


def _users(spark, d):
    """Users as nodes; an edge from each event's user to that of the next event of its type on its day; weight is how far
    apart their numbers are."""
    from pyspark.sql import Window as W

    w = W.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("event_id")
    e = t(spark, d, "events").withColumn("next", F.lead("user_id").over(w)).where("next is not null")
    e = e.groupBy(F.col("user_id").alias("src"), F.col("next").alias("dst")).agg(F.min(F.abs(F.col("next") - F.col("user_id")) + 1).cast("double").alias("weight"))
    edges = e.select(F.concat_ws("-", "src", "dst").alias("id"), "src", "dst", F.lit("NEXT").alias("type"), "weight")
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    nodes = nodes.select("id", F.array(F.lit("User")).alias("labels"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("props"))
    return G.Graph(G.cut(nodes), G.cut(edges))


_U = "e AS (SELECT DISTINCT user_id AS src, nxt AS dst, (abs(nxt - user_id) + 1)::DOUBLE AS weight FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"


@query("graph_shortest_costs", f"WITH RECURSIVE {_U}, s AS (SELECT min(src) AS s FROM e), r(id, cost, hops) AS (SELECT s, 0.0::DOUBLE, 0 FROM s UNION SELECT dst, min(cost + weight), hops + 1 FROM r JOIN e ON e.src = r.id WHERE hops < 24 GROUP BY dst, hops) SELECT id, min(cost) AS cost FROM r GROUP BY 1")
def graph_shortest_costs(spark, d):
    g = _users(spark, d)
    start = g.edges.agg(F.min("src")).first()[0]
    return g.distances(start).select("id", "cost")


@query("graph_shortest_path", f"WITH RECURSIVE {_U}, s AS (SELECT min(src) AS s, max(dst) AS z FROM e), r(id, path, hops) AS (SELECT s, [s], 0 FROM s UNION SELECT dst, min(list_append(path, dst)), hops + 1 FROM r JOIN e ON e.src = r.id WHERE hops < 6 GROUP BY dst, hops) SELECT array_to_string(path, '>') AS path, hops::INTEGER AS hops FROM r, s WHERE id = z ORDER BY hops, path LIMIT 1")
def graph_shortest_path(spark, d):
    g = _users(spark, d)
    a, b = g.edges.agg(F.min("src"), F.max("dst")).first()
    return g.shortest_path(a, b).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops")


@query("graph_dfs")
def graph_dfs(spark, d):
    g = _users(spark, d)
    return g.dfs(g.edges.agg(F.min("src")).first()[0])


@query("graph_levels", "WITH RECURSIVE e AS (SELECT 'region:' || n_regionkey AS dst, 'nation:' || n_nationkey AS src FROM nation UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r(id, level) AS (SELECT id, 0 FROM v WHERE id NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM r JOIN e ON e.src = r.id) SELECT id, max(level)::INTEGER AS level FROM r GROUP BY 1")
def graph_levels(spark, d):
    g = G.star_schema(spark, d)
    edges = g.edges.where("src LIKE 'nation:%' OR src LIKE 'supplier:%'")
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return G.Graph(nodes, edges).topological_order()


@query("graph_simple_paths", f"WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src AS x, dst AS y FROM e), r(pos, path) AS (SELECT 'customer:1', ['customer:1'] UNION ALL SELECT b.y, list_append(path, b.y) FROM r JOIN b ON b.x = r.pos WHERE len(path) <= 3 AND NOT list_contains(path, b.y)) SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INTEGER AS hops FROM r WHERE pos LIKE 'region:%'")
def graph_simple_paths(spark, d):
    g = G.star_schema(spark, d)
    region = t(spark, d, "customer").where("c_custkey = 1").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    p = g.simple_paths("customer:1", f"region:{region}", 3)
    return p.select(F.array_join("path", ">").alias("path"), "hops")


_PR = f"WITH {_U}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v), o AS (SELECT src, sum(weight) AS total FROM e GROUP BY 1), w AS (SELECT e.src, e.dst, weight / total AS w FROM e JOIN o USING (src)), r0 AS (SELECT id, 1.0 / n AS rank FROM v, n)"
for _i in range(1, 6):
    _PR += f", l{_i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{_i - 1} WHERE id NOT IN (SELECT src FROM o)), r{_i} AS (SELECT v.id, (0.15 + 0.85 * lost) / n + 0.85 * coalesce((SELECT sum(r{_i - 1}.rank * w.w) FROM w JOIN r{_i - 1} ON r{_i - 1}.id = w.src WHERE w.dst = v.id), 0) AS rank FROM v, n, l{_i})"


@query("graph_pagerank", f"{_PR} SELECT id, round(rank, 6) AS rank FROM r5")
def graph_pagerank(spark, d):
    return _users(spark, d).pagerank(rounds=5, epsilon=None).select("id", r6("rank").alias("rank"))


@query("graph_components", f"WITH RECURSIVE {_U}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), r(id, c) AS (SELECT x, x FROM b UNION SELECT b.y, c FROM r JOIN b ON b.x = r.id) SELECT id, min(c) AS component FROM r GROUP BY 1")
def graph_components(spark, d):
    return _users(spark, d).components()


@query("graph_hyperedges", "SELECT l_orderkey || '/' || l_linenumber AS id FROM lineitem WHERE l_partkey < 20 AND l_suppkey < 5")
def graph_hyperedges(spark, d):
    x = t(spark, d, "lineitem")
    node = lambda kind, c: F.concat_ws(":", F.lit(kind), c)
    h = x.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), F.array(node("orders", "l_orderkey"), node("part", "l_partkey"), node("supplier", "l_suppkey")).alias("nodes"))
    parts = x.where("l_partkey < 20").select(node("part", "l_partkey").alias("id"))
    suppliers = x.where("l_suppkey < 5").select(node("supplier", "l_suppkey").alias("id"))
    return G.hyperedge_match(h, {1: parts, 2: suppliers}, arity=3).select("id")


# --- Cypher -------------------------------------------------------------------------------------------------------

_CY = {
    "match_one_hop": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE n.name = 'NATION_3' OR n.name = 'NATION_4' RETURN c.name AS name, n.name AS nation", "SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_4')"),
    "match_chain": ("MATCH (s:Supplier)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "match_incoming": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WHERE c.acctbal > 9000 RETURN n.name AS nation, count(c) AS n ORDER BY n DESC, nation LIMIT 5", "SELECT n_name AS nation, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 9000 GROUP BY 1 ORDER BY n DESC, nation LIMIT 5"),
    "match_with": ("MATCH (c:Customer)-[p:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 15 RETURN c.name AS name, n", "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15"),
    "match_optional": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS nation, count(s) AS n", "SELECT n_name AS nation, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "match_pattern_predicate": ("MATCH (n:Nation) WHERE NOT (n)<-[:IN_NATION]-(:Supplier) RETURN n.name AS nation", "SELECT n_name AS nation FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)"),
    "match_var_length": ("MATCH (s:Supplier)-[:IN_NATION|IN_REGION*1..2]->(x) RETURN s.name AS name, x.name AS x", "SELECT s_name AS name, n_name AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "match_open_length": ("MATCH (s:Supplier)-[:IN_NATION|IN_REGION*]->(x:Region) RETURN s.name AS name, x.name AS x", "SELECT s_name AS name, r_name AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "match_strings": ("MATCH (n:Nation) WHERE n.name STARTS WITH 'NATION' AND (n.name ENDS WITH '1' XOR n.name CONTAINS '_1') AND n.name =~ '.*_[0-9]+' RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_name LIKE 'NATION%' AND ((n_name LIKE '%1') <> contains(n_name, '_1')) AND regexp_full_match(n_name, '.*_[0-9]+')"),
    "match_distinct_case": ("MATCH (c:Customer) RETURN DISTINCT CASE WHEN c.acctbal < 0 THEN 'debt' ELSE toUpper(c.mktsegment) END AS class", "SELECT DISTINCT CASE WHEN c_acctbal < 0 THEN 'debt' ELSE upper(c_mktsegment) END AS class FROM customer"),
    "match_undirected": ("MATCH (a:Nation)-[:IN_REGION]-(r:Region)-[:IN_REGION]-(b:Nation) WHERE a.name < b.name RETURN a.name AS a, b.name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name"),
    "unwind": ("UNWIND [1, 2, 3] AS x RETURN x * 2 AS y", "SELECT unnest([2, 4, 6])::BIGINT AS y"),
}
for _n, (_q, _s) in _CY.items():

    def _cy(text):
        return lambda spark, d: cypher.Engine(G.star_schema(spark, d)).query(text)

    query(f"cypher_{_n}", _s)(_cy(_q))


@query("cypher_mutations", f"SELECT id, label FROM ({_NODES}) WHERE label <> 'Supplier' UNION ALL SELECT 'city:1', 'City'")
def cypher_mutations(spark, d):
    e = cypher.Engine(G.star_schema(spark, d))
    e.query("CREATE (x:City {id: 'city:1', name: 'Riverton'})")
    e.query("MATCH (s:Supplier) DETACH DELETE s")
    return e.graph.nodes.select("id", F.col("labels")[0].alias("label"))


# --- SPARQL -------------------------------------------------------------------------------------------------------


def _triples(spark, d):
    tr = readers.triples_from(t(spark, d, "region"), "region", "r_regionkey")
    tr = tr.unionByName(readers.triples_from(t(spark, d, "nation"), "nation", "n_nationkey", references={"n_regionkey": "region"}))
    return tr.unionByName(readers.triples_from(t(spark, d, "customer"), "customer", "c_custkey", references={"c_nationkey": "nation"}))


_P = "PREFIX : <http://example.org/> "
_Q = lambda c: f"'\"' || {c} || '\"'"
_INT = lambda c: f"'\"' || {c} || '\"^^<http://www.w3.org/2001/XMLSchema#integer>'"
_SQ = {
    "bgp": ("SELECT ?n ?r WHERE { ?x :regionkey ?y . ?x :name ?n . ?y :name ?r }", f"SELECT {_Q('n_name')} AS n, {_Q('r_name')} AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "filter_regex": ("SELECT ?n WHERE { ?x a :Nation ; :name ?n . FILTER(REGEX(?n, '^n.*1', 'i')) }", f"SELECT {_Q('n_name')} AS n FROM nation WHERE regexp_matches(lower(n_name), '^n.*1')"),
    "optional": ("SELECT ?n ?s WHERE { ?x a :Nation ; :name ?n . OPTIONAL { ?c :nationkey ?x ; :acctbal ?b . ?c :mktsegment ?s FILTER(?b > 9900) } }", f"SELECT {_Q('n_name')} AS n, {_Q('c_mktsegment')} AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900"),
    "union": ("SELECT ?n WHERE { { ?x a :Nation ; :name ?n } UNION { ?x a :Region ; :name ?n } }", f"SELECT {_Q('n_name')} AS n FROM nation UNION ALL SELECT {_Q('r_name')} FROM region"),
    "minus": ("SELECT ?n WHERE { ?x a :Nation ; :name ?n MINUS { ?c :nationkey ?x ; :acctbal ?b FILTER(?b < 0) } }", f"SELECT {_Q('n_name')} AS n FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)"),
    "not_exists": ("SELECT ?n WHERE { ?x a :Nation ; :name ?n FILTER NOT EXISTS { ?c :nationkey ?x } }", f"SELECT {_Q('n_name')} AS n FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)"),
    "group": ("SELECT ?s (COUNT(?c) AS ?n) WHERE { ?c :mktsegment ?s } GROUP BY ?s HAVING (COUNT(?c) > 5)", f"SELECT {_Q('c_mktsegment')} AS s, {_INT('count(*)')} AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 5"),
    "group_concat": ("SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=',') AS ?all) WHERE { ?x :regionkey ?y ; :name ?n . ?y :name ?r } GROUP BY ?r", f"SELECT {_Q('r_name')} AS r, '\"' || string_agg(n_name, ',' ORDER BY n_name) || '\"' AS \"all\" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "path_sequence": ("SELECT ?r (COUNT(*) AS ?n) WHERE { ?c :nationkey/:regionkey/:name ?r } GROUP BY ?r", f"SELECT {_Q('r_name')} AS r, {_INT('count(*)')} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "path_plus": ("SELECT ?c ?x WHERE { ?c a :Customer . ?c (:nationkey|:regionkey)+ ?x }", "SELECT '<http://example.org/customer/' || c_custkey || '>' AS c, '<http://example.org/nation/' || c_nationkey || '>' AS x FROM customer UNION ALL SELECT '<http://example.org/customer/' || c_custkey || '>', '<http://example.org/region/' || n_regionkey || '>' FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "path_inverse": ("SELECT ?n WHERE { <http://example.org/region/0> ^:regionkey/:name ?n }", f"SELECT {_Q('n_name')} AS n FROM nation WHERE n_regionkey = 0"),
    "values_bind": ("SELECT ?r ?u WHERE { VALUES ?k { <http://example.org/region/1> <http://example.org/region/2> } ?k :name ?r BIND(UCASE(?r) AS ?u) }", f"SELECT {_Q('r_name')} AS r, {_Q('upper(r_name)')} AS u FROM region WHERE r_regionkey IN (1, 2)"),
    "order_limit": ("SELECT ?n WHERE { ?c :acctbal ?b ; :name ?n } ORDER BY DESC(?b) ?n LIMIT 3", f"SELECT {_Q('c_name')} AS n FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 3"),
    "ask": ("ASK { ?x a :Nation ; :name ?n FILTER(STRLEN(?n) > 2) }", "SELECT count(*) > 0 AS ask FROM nation WHERE length(n_name) > 2"),
    "construct": ("CONSTRUCT { ?y :has ?x } WHERE { ?x :regionkey ?y }", "SELECT '<http://example.org/region/' || n_regionkey || '>' AS s, '<http://example.org/has>' AS p, '<http://example.org/nation/' || n_nationkey || '>' AS o FROM nation"),
    "describe": ("DESCRIBE <http://example.org/region/1>", "SELECT '<http://example.org/region/1>' AS s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, '<http://example.org/Region>' AS o UNION ALL SELECT '<http://example.org/region/1>', '<http://example.org/name>', '\"' || r_name || '\"' FROM region WHERE r_regionkey = 1"),
}
for _n, (_q, _s) in _SQ.items():

    def _sq(text):
        return lambda spark, d: sparql.Engine(_triples(spark, d)).query(_P + text)

    query(f"sparql_{_n}", _s)(_sq(_q))


@query("sparql_update", "SELECT '<http://example.org/region/' || r_regionkey || '>' AS s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, '<http://example.org/Region>' AS o FROM region UNION ALL SELECT '<http://example.org/region/' || r_regionkey || '>', '<http://example.org/name>', '\"' || r_name || '\"' FROM region UNION ALL SELECT '<http://example.org/x>', '<http://example.org/name>', '\"new\"'")
def sparql_update(spark, d):
    e = sparql.Engine(readers.triples_from(t(spark, d, "region"), "region", "r_regionkey"))
    e = e.update(_P + "INSERT DATA { :x :name 'new' . :y :name 'gone' } ; DELETE DATA { :y :name 'gone' }")
    return e.triples.select("s", "p", "o")


_TYPE = "'<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'"


@query("ntriples_round_trip", f"WITH r AS (SELECT '<http://example.org/region/' || r_regionkey || '>' AS s, * FROM region), n AS (SELECT '<http://example.org/nation/' || n_nationkey || '>' AS s, * FROM nation) SELECT s, {_TYPE} AS p, '<http://example.org/Region>' AS o FROM r UNION ALL SELECT s, '<http://example.org/name>', {_Q('r_name')} FROM r UNION ALL SELECT s, {_TYPE}, '<http://example.org/Nation>' FROM n UNION ALL SELECT s, '<http://example.org/name>', {_Q('n_name')} FROM n UNION ALL SELECT s, '<http://example.org/regionkey>', '<http://example.org/region/' || n_regionkey || '>' FROM n")
def ntriples_round_trip(spark, d):
    tr = readers.triples_from(t(spark, d, "region"), "region", "r_regionkey").unionByName(readers.triples_from(t(spark, d, "nation"), "nation", "n_nationkey", references={"n_regionkey": "region"}))
    lines = tr.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))
    return readers.parse_ntriples(lines).select("s", "p", "o")


@query("graphml_export", f"SELECT (SELECT count(*) FROM ({_NODES})) + (SELECT count(*) FROM ({_EDGES})) + 2 AS n")
def graphml_export(spark, d):
    return writers.graphml_lines(G.star_schema(spark, d)).agg(F.count("*").alias("n"))


# --- message passing and kernels ----------------------------------------------------------------------------------


def _features(spark, d):
    e = t(spark, d, "embeddings")
    near = search.knn_join(e, e, 5)
    edges = near.select(F.col("id").alias("src"), F.col("query_id").alias("dst"))
    return edges, e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_W = np.random.default_rng(1).normal(size=(64, 8)) / 8
_GCN = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS id, c.v, row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1]-p[2])*(p[1]-p[2])))), c.vec_id) AS rank FROM e q JOIN e c ON q.vec_id <> c.vec_id),
n AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS i FROM s WHERE rank <= 5), m AS (SELECT id, i, sum(x) / sqrt(count(*)) AS x FROM n GROUP BY 1, 2),
w(i, pos, w) AS (VALUES {", ".join(f"({i}, {j}, {float(_W[i, j])!r}::DOUBLE)" for i in range(64) for j in range(8))})
SELECT id, pos::INTEGER AS pos, round(greatest(sum(x * w), 0), 6) + 0.0 AS value FROM m JOIN w USING (i) GROUP BY 1, 2"""


@query("gcn_layer", _GCN)
def gcn_layer(spark, d):
    edges, f = _features(spark, d)
    return G.gcn_layer(edges, f, _W).select("id", F.posexplode("v").alias("pos", "x")).select("id", "pos", (F.round("x", 6) + 0.0).alias("value"))


@query("sage_layer")
def sage_layer(spark, d):
    edges, f = _features(spark, d)
    r = np.random.default_rng(2)
    return G.sage_layer(edges, f, r.normal(size=(64, 8)) / 8, r.normal(size=(64, 8)) / 8, samples=3).select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


def _by_label(kernel, schema):
    def run(spark, d):
        e = t(spark, d, "embeddings").select("label", "vec_id", "embedding")
        return e.groupBy("label").applyInPandas(lambda k, pdf: kernel(int(k[0]), np.array(pdf.sort_values("vec_id").embedding.tolist(), float)), schema)

    return run


_ATTENTION = """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.label, q.vec_id, list_sum(c.v) AS t, list_inner_product(q.v, c.v) / sqrt(len(q.v)) AS s FROM e q JOIN e c USING (label)),
m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS x FROM s), r AS (SELECT label, vec_id, sum(x * t) / sum(x) AS y FROM m GROUP BY 1, 2) SELECT label::INTEGER AS label, round(sum(y), 6) AS total FROM r GROUP BY 1"""
query("attention_by_label", _ATTENTION)(_by_label(lambda k, x: pd.DataFrame({"label": [k], "total": [round(float(kernels.tiled(x, x, x, 1024).sum()), 6)]}), "label int, total double"))
query("spectral_clusters")(_by_label(lambda k, x: pd.DataFrame({"label": k, "row": np.arange(len(x)), "cluster": kernels.spectral_points(x, min(2, len(x)))}), "label int, row int, cluster int"))
query("persistence_by_label")(_by_label(lambda k, x: pd.DataFrame([(k, *p) for p in kernels.persistence(x, 0) if np.isfinite(p[2])], columns=["label", "dimension", "birth", "death"]), "label int, dimension int, birth double, death double"))


@query("min_cut")
def min_cut(spark, d):
    """The least cut of each event type's graph of a day, an edge for each two users whose events follow each other."""
    from pyspark.sql import Window as W

    w = W.partitionBy("event_type", "day").orderBy("event_id")
    e = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts")).withColumn("dst", F.lead("user_id").over(w)).where("dst is not null and dst <> user_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = {x: i for i, x in enumerate(sorted(set(pdf.src) | set(pdf.dst)))}
        v, side = kernels.min_cut(len(ids), [(ids[a], ids[b], 1.0) for a, b in zip(pdf.src, pdf.dst, strict=True)])
        return pd.DataFrame({"event_type": pdf.event_type[:1], "day": pdf.day[:1], "value": [float(v)], "side": [len(side)]})

    return e.select("event_type", "day", F.col("user_id").alias("src"), "dst").groupBy("event_type", "day").applyInPandas(run, "event_type string, day timestamp, value double, side int")
