"""Graphs, query languages, filters, replication and streams on small fixtures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import filters, search
from orrery.operators import replication as R
from orrery.operators.graph import Graph, hyperedge_members
from orrery.plans import cypher, sparql
from orrery.plans.vector_sql import Database, rewrite
from orrery.sources import readers, writers
from orrery.streaming import stateful, windows


@pytest.fixture(scope="module")
def social(spark):
    nodes = spark.createDataFrame([("alice", ["Person"], {"name": "Alice", "age": "30"}), ("bob", ["Person"], {"name": "Bob", "age": "35"}), ("charlie", ["Person", "Boss"], {"name": "Charlie", "age": "28"})], "id string, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([("1", "alice", "bob", "KNOWS", 1.0), ("2", "bob", "charlie", "KNOWS", None), ("3", "alice", "charlie", "LIKES", 5.0)], "id string, src string, dst string, type string, weight double")
    return Graph(nodes, edges)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_graph(social):
    assert rows(social.bfs("alice", types=["KNOWS"])) == [("alice", 0), ("bob", 1), ("charlie", 2)]
    assert social.shortest_path("alice", "alice").first().path == ["alice"]
    assert {r.id: r.cost for r in social.distances("alice").collect()} == {"alice": 0.0, "bob": 1.0, "charlie": 2.0}
    assert rows(social.simple_paths("alice", "charlie", 3).select(F.array_join("path", ","))) == [("alice,bob,charlie",), ("alice,charlie",)]
    assert sum(r.rank for r in social.pagerank(rounds=10).collect()) == pytest.approx(1)
    assert {r.id: r.level for r in social.topological_order().collect()} == {"alice": 0, "bob": 1, "charlie": 2}
    assert {r.component for r in social.components().collect()} == {"alice"}
    assert {(r.src, r.dst): r.cost for r in social.all_pairs().collect()}["alice", "charlie"] == 2.0
    with pytest.raises(ValueError):
        social.delete_nodes(F.col("id") == "bob")
    assert social.delete_nodes(F.col("id") == "bob", detach=True).edges.count() == 1


def test_cypher(social):
    run = lambda q: rows(cypher.Engine(social).query(q))
    assert run("MATCH (p:Person) RETURN sum(p.age) AS s, avg(p.age) AS a, count(*) AS n") == [(93.0, 31.0, 3)]
    assert [r[0] for r in cypher.Engine(social).query("MATCH (p:Person) RETURN p.name AS name ORDER BY p.age").collect()] == ["Charlie", "Alice", "Bob"]
    assert run("MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN a.name, c.name") == [("Alice", "Charlie")]
    assert run("MATCH (a {name: 'Alice'})-[r]->(b) RETURN type(r) AS t, b.name AS n") == [("KNOWS", "Bob"), ("LIKES", "Charlie")]
    assert run("MATCH (a:Person) WHERE (a)-[:LIKES]->() RETURN a.name AS n") == [("Alice",)]
    assert run("MATCH p = (a {name: 'Alice'})-[:KNOWS*1..3]->(b) RETURN b.name AS n, length(p) AS l") == [("Bob", 1), ("Charlie", 2)]
    assert run("MATCH (a:Person) WHERE a.age > 29 AND a.name STARTS WITH 'B' RETURN toUpper(a.name) AS n") == [("BOB",)]
    assert run("MATCH (a:Person) WITH a WHERE a.age < 30 RETURN collect(a.name) AS n") == [(["Charlie"],)]
    e = cypher.Engine(social)
    e.query("MERGE (x:City {id: 'c1', name: 'Here'}) ON CREATE SET x.new = 'yes'")
    e.query("MATCH (a:Person {name: 'Bob'}) SET a.age = 36")
    e.query("MATCH (a:Boss) REMOVE a:Boss")
    assert rows(e.query("MATCH (a:Person) RETURN max(a.age) AS m")) == [(36.0,)]
    assert e.query("MATCH (c:City) RETURN c.new AS n").first()[0] == "yes" and e.query("MATCH (b:Boss) RETURN b").count() == 0


def test_sparql(spark):
    lines = spark.createDataFrame([("<a> <knows> <b> .",), ("<b> <knows> <c> .",), ('<a> <age> "30"^^<http://www.w3.org/2001/XMLSchema#integer> .',), ('<b> <name> "Bob"@en .',), ("# note",)], "value string")
    e = sparql.Engine(readers.parse_ntriples(lines))
    assert rows(e.query("SELECT ?x WHERE { <a> <knows>+ ?x }")) == [("<b>",), ("<c>",)]
    assert rows(e.query("SELECT ?x ?n WHERE { ?x <knows> ?y OPTIONAL { ?x <name> ?n } }").fillna("-")) == [("<a>", "-"), ("<b>", '"Bob"@en')]
    assert rows(e.query("SELECT (LANG(?n) AS ?l) (STR(?n) AS ?s) WHERE { ?x <name> ?n }")) == [('"en"', '"Bob"')]
    assert e.query("ASK { <a> <age> ?v FILTER(?v >= 30) }").first()[0] is True
    assert rows(e.query("SELECT ?x WHERE { ?x <knows> ?y MINUS { ?x <age> ?v } }")) == [("<b>",)]
    f = e.update("DELETE { ?x <knows> ?y } INSERT { ?y <knownBy> ?x } WHERE { ?x <knows> ?y }")
    assert rows(f.query("SELECT ?y WHERE { ?y <knownBy> <a> }")) == [("<b>",)] and f.triples.count() == 4
    assert "<uri>" in sparql.to_results(e.query("SELECT ?x WHERE { <a> <knows> ?x }"), "xml").first()[0]


def test_filters(spark):
    df = spark.createDataFrame([("v1", '{"status": "active", "age": 25}', "The Quick fox"), ("v2", '{"status": "active", "age": 30}', "slow"), ("v3", '{"status": "inactive"}', None)], "id string, payload string, d string")
    got = lambda tree, **k: [r.id for r in filters.where(df, tree, **k).orderBy("id").collect()]
    assert got(("eq", "status", "active"), json_column="payload") == ["v1", "v2"]
    assert got(("ne", "age", 25), json_column="payload") == ["v2", "v3"]
    assert got(("not", ("lt", "age", 100)), json_column="payload") == ["v3"]
    assert got(("range", "age", 25, None), json_column="payload") == ["v1", "v2"]
    assert got(("text", "d", "quick")) == ["v1"]
    assert got(("eq", "id", 1), strict=True) == []


def test_search(spark):
    v = np.random.default_rng(1).normal(size=(40, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    d = np.linalg.norm(v[:3, None] - v[None], axis=-1)
    np.fill_diagonal(d, np.inf)
    want = {(q, int(i)) for q in range(3) for i in np.argsort(d[q], kind="stable")[:4]}
    assert {(r.query_id, r.id) for r in search.knn_join(df.where("vec_id < 3"), df, 4).collect()} == want
    assert search.mmr_order(np.array([3.0, 2.0]), np.eye(2), 0.5, 5) == [0, 1]
    assert search.mmr_order(np.array([1.0, 0.99, 0.5]), np.array([[1, 0], [1, 0], [0, 1.0]]), 0.5, 2) == [0, 2]


def test_vector_sql(spark, tmp_path):
    assert "aggregate" in rewrite("SELECT * FROM t ORDER BY v <-> [1, 2] LIMIT 3")
    db = Database(spark)
    db.execute("DROP TABLE IF EXISTS orrery_docs")
    db.execute("CREATE TABLE orrery_docs (id TEXT, embedding VECTOR(3))")
    db.execute("INSERT INTO orrery_docs (id, embedding) VALUES ('a', [1, 0, 0]), ('b', [0, 1, 0])")
    assert db.execute("SELECT id FROM orrery_docs ORDER BY embedding <=> [0.9, 0.1, 0] LIMIT 1").first()[0] == "a"
    with pytest.raises(ValueError, match="dimension"):
        db.execute("INSERT INTO orrery_docs (id, embedding) VALUES ('c', [1, 0])")
    db.execute("DROP TABLE orrery_docs")


def test_replication(spark, tmp_path):
    clock = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])
    got = spark.range(1).select(R.clock_order(clock({"a": 1}), clock({"a": 1, "b": 1})).alias("x"), R.clock_order(clock({"a": 2}), clock({"b": 1})).alias("y")).first()
    assert tuple(got) == ("before", "concurrent")
    s = R.Snapshots(spark, str(tmp_path))
    s.create(spark.range(3), "t", "s1")
    s.create(spark.range(5), "t", "s2")
    assert s.list("t") == ["s1", "s2"] and s.restore("t", "s1").count() == 3 and s.cleanup("t", 1) == ["s1"]


def test_sources(spark, tmp_path, social):
    p = str(tmp_path)
    with open(f"{p}/v.csv", "w") as f:
        f.write("id,x0,x1\na,1,2\nb,3,4\n")
    assert rows(readers.read_csv_vectors(spark, f"{p}/v.csv")) == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    os.mkdir(f"{p}/npy")
    np.save(f"{p}/npy/m.npy", np.arange(6.0).reshape(3, 2))
    assert rows(readers.read_npy(spark, f"{p}/npy", 10))[2] == (12, [4.0, 5.0])
    assert writers.dot_lines(social).where("part = 2").count() == 3 and writers.graphml_lines(social, 2.0).where("part = 2").count() == 1
    h = spark.createDataFrame([("h", ["a", "b"])], "id string, nodes array<string>")
    assert [(r.pos, r.node) for r in hyperedge_members(h).collect()] == [(0, "a"), (1, "b")]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT 'k' AS key, id, timestamp_seconds(id) AS ts, CASE WHEN id % 2 = 0 THEN array(1D, 0D) ELSE array(0D, 1D + id) END AS vector, CAST(id AS DOUBLE) AS value FROM range(6)").write.parquet(src)
    schema = "key string, id bigint, ts timestamp, vector array<double>, value double"
    stream = spark.readStream.schema(schema).parquet(src)
    q = stateful.similarity_dedup(stream.select("key", "id", "ts", "vector"), 10, 0.99).writeStream.format("memory").queryName("dd").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch = stateful.similarity_dedup(spark.read.parquet(src).select("key", "id", "ts", "vector"), 10, 0.99)
    assert rows(spark.table("dd").select("id", "duplicate")) == rows(batch.select("id", "duplicate")) == [(0, False), (1, False), (2, True), (3, True), (4, True), (5, True)]
    w = windows.tumbling(stream, "ts", "3 seconds", ["key"], [F.count("*").alias("n")], "1 second")
    q = w.writeStream.outputMode("complete").format("memory").queryName("tw").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("tw").orderBy("window_start").collect()] == [3, 3]
    assert np.allclose(stateful.forecast(np.arange(50.0), 2, 0.5, 0.5), [50, 51], atol=0.5) and stateful.cusum(np.r_[np.zeros(40), np.ones(40) * 5])


def test_admin(spark):
    from orrery.operators import admin

    c = admin.Collections(spark)
    df = spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<double>")
    c.create(admin.Collection("orrery_c", 2), df)
    c.alias("now", "orrery_c")
    c.upsert("orrery_c", spark.createDataFrame([("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "id string, vector array<double>"))
    assert rows(c.get("now").select("id", F.element_at("vector", 1))) == [("a", 3.0), ("b", 5.0)] and c.stats().first().n == 2
    with pytest.raises(Exception, match="dimensions"):
        admin.Collection("x", 3).check(df).collect()
    assert admin.bottlenecks(df.groupBy("id").count(), 0.9).where("operator = 'Exchange'").count() == 1
    met = spark.range(1).select(admin.contract_met(F.lit(0.9), F.lit(5), F.lit(2.0), 0.95, 10, 1.0).alias("c")).first().c
    assert not met.valid and met.broken == ["recall"]


def test_load_and_malformed_triples(spark, tmp_path):
    from orrery.plans import sparql
    from orrery.sources import readers

    (tmp_path / "a.nt").write_text('# a comment\n\n<http://x/1> <http://x/p> "one" .\n<http://x/2> <http://x/p> "two"@en .\n')
    (tmp_path / "bad.nt").write_text('<http://x/1> <http://x/p> "one" .\n<http://x/1> no triple\n')
    e = sparql.Engine(spark.createDataFrame([(None, "<http://x/0>", "<http://x/p>", '"zero"')], "g string, s string, p string, o string"))
    here = e.update(f"LOAD <{tmp_path}/a.nt> INTO GRAPH <http://x/g> ; LOAD SILENT <{tmp_path}/none.nt>")
    assert {(r.g, r.o) for r in here.triples.collect()} == {(None, '"zero"'), ("<http://x/g>", '"one"'), ("<http://x/g>", '"two"@en')}
    assert [r.o for r in here.update("CLEAR NAMED").triples.collect()] == ['"zero"']
    assert e.update(f"LOAD <{tmp_path}/a.nt>").triples.where("g is null").count() == 3
    with pytest.raises(Exception, match="not a triple"):
        readers.read_ntriples(spark, f"{tmp_path}/bad.nt").collect()


def test_xbrl(spark):
    from orrery.sources import readers

    text = """<x:xbrl xmlns:x="http://x" xmlns:g="http://g">
      <x:context id="Y"><x:period><x:startDate>2023-01-01</x:startDate><x:endDate>2023-12-31</x:endDate></x:period></x:context>
      <x:context id="Q"><x:period><x:startDate>2023-10-01</x:startDate><x:endDate>2023-12-31</x:endDate></x:period></x:context>
      <x:context id="E"><x:period><x:instant>2023-12-31</x:instant></x:period></x:context>
      <g:Assets contextRef="E" unitRef="USD">1,000</g:Assets><g:Liabilities contextRef="E">400</g:Liabilities>
      <g:Revenue contextRef="Y">500</g:Revenue><g:Revenue contextRef="Q">900</g:Revenue><g:NetIncome contextRef="Y">50</g:NetIncome>
      <g:NetCashFlow contextRef="Y">7</g:NetCashFlow><g:Note contextRef="Y">words</g:Note></x:xbrl>"""
    facts = readers.xbrl_facts(spark.createDataFrame([(1, text), (2, None), (3, "")], "cik bigint, content string"), "cik")
    rows = {(r.name, r.context): (r.value, r.statement) for r in facts.collect()}
    assert rows[("Assets", "E")] == (1000.0, "balance_sheet") and rows[("NetIncome", "Y")] == (50.0, "income_statement") and len(rows) == 6
    (r,) = readers.statements(facts, "cik").collect()
    want = [0.4, 0.0, 0.001, 0.1, 0.0, 50.0, 0.05]
    n = sum(v * v for v in want) ** 0.5
    assert r.is_annual and str(r.period_end) == "2023-12-31" and len(r.embedding) == 64
    assert all(abs(a - b / n) < 1e-12 for a, b in zip(r.embedding, want, strict=False)) and not any(r.embedding[7:])


def test_clocks(spark):
    from pyspark.sql import functions as F

    from orrery.operators import replication as R

    clock = lambda p, n, name: F.struct(F.lit(p).alias("physical"), F.lit(n).alias("logical"), F.lit(name).alias("replica"))
    own = clock(10, 4, "a")
    cases = [R.hybrid_now(own, F.lit(12)), R.hybrid_now(own, F.lit(9)), *[R.hybrid_receive(own, clock(p, 7, "b"), F.lit(now)) for p, now in ((11, 12), (9, 10), (11, 5), (10, 10))]]
    got = [tuple(x) for x in spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cases)]).first()]
    assert got == [(12, 0, "a"), (10, 5, "a"), (12, 0, "a"), (10, 5, "a"), (11, 8, "a"), (10, 8, "a")]
    assert spark.range(1).select(R.lamport_receive(F.lit(3), F.lit(8))).first()[0] == 9
