"""Loops without caps, readers that lose nothing, filters, probes, gates and entities on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import text, vectors
from orrery.operators import aggregates, retrieval, search
from orrery.operators.graph import Graph
from orrery.plans import cypher, sparql
from orrery.sources import readers
from orrery.streaming import stateful


@pytest.fixture(scope="module")
def chain(spark):
    n = 20
    nodes = spark.createDataFrame([(i, ["N"], {"n": str(i)}) for i in range(n)], "id bigint, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([(i, i, i + 1, "NEXT", 1.0) for i in range(n - 1)], "id bigint, src bigint, dst bigint, type string, weight double")
    return Graph(nodes, edges)


def test_a_long_chain_is_whole(chain):
    assert chain.bfs(0).count() == 20 and chain.bfs(0, 3).count() == 4
    assert chain.shortest_path(0, 19).first().path == list(range(20)) and chain.shortest_path(0, 19, 5).count() == 0
    assert chain.topological_order().agg(F.max("level")).first()[0] == 19
    assert [r.id for r in chain.dfs(0).orderBy("position").collect()] == list(range(20))
    assert chain.dfs(0, F.col("id") == 4).count() == 5
    assert chain.distances(0).agg(F.max("cost")).first()[0] == 19.0


def test_open_cypher_paths(chain):
    got = cypher.Engine(chain).query("MATCH (a {n: '0'})-[:NEXT*2..]->(b) RETURN b.n AS n")
    assert sorted(int(r.n) for r in got.collect()) == list(range(2, 20))


def test_minus_over_several_variables(spark):
    t = spark.createDataFrame([(None, f"<{s}>", f"<{p}>", f'"{o}"') for s, p, o in (("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("c", "x", 3), ("c", "y", 2))], "g string, s string, p string, o string")
    got = sparql.Engine(t).query("SELECT ?s WHERE { ?s <x> ?v OPTIONAL { ?s <y> ?w } MINUS { ?s <x> ?v . ?s <y> ?w } }")
    assert [r.s for r in got.collect()] == ["<b>"]


def test_readers_lose_nothing(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"id": "a", "vector": [1, 2]}\n{"id": "b", "vector": [3]}\n{"id": "c", "vector": []}\n')
    (tmp_path / "array.json").write_text('[{"id": "a", "vector": [1, 2]},\n {"id": "b", "vector": [3], "metadata": {"x": 1}}]')
    assert readers.read_json_vectors(spark, str(tmp_path / "lines.json")).count() == 3
    assert [r.metadata and json.loads(r.metadata) for r in readers.read_json_vectors(spark, str(tmp_path / "array.json")).collect()] == [None, {"x": 1}]
    (tmp_path / "good.csv").write_text("id,x0,x1\na,1,2\nb,3,4\n\n")
    (tmp_path / "bad.csv").write_text("id,x0,x1\na,1,2\nb,3,oops\n")
    assert [tuple(r.vector) for r in readers.read_csv_vectors(spark, str(tmp_path / "good.csv")).collect()] == [(1, 2), (3, 4)]
    with pytest.raises(Exception, match="not a number: oops"):
        readers.read_csv_vectors(spark, str(tmp_path / "bad.csv")).collect()


def test_entities(spark):
    t = "I met John Smith at the World Trade Center, see https://example.com/page. The Cat sat. Mail <alice@example.com>; ask @bob-dev and @bob-dev."
    e = spark.createDataFrame([(t,), (None,)], "t string").select(text.entities(F.col("t")).alias("e")).select("e.*").collect()
    assert (e[0].urls, e[0].emails, e[0].mentions) == (["https://example.com/page"], ["alice@example.com"], ["@bob-dev"])
    assert e[0].persons == ["John Smith", "World Trade Center"] and e[1].persons == []


def test_terms(spark):
    got = spark.createDataFrame([("The classes, running-fast! a nations7 classless creation bodies",)], "t string").select(text.terms(F.col("t"))).first()[0]
    assert got == ["class", "runn", "fast", "nations7", "classless", "creat", "bodi"]


def test_route(spark):
    asked = ['what came Before that', "things related to x and y", '"exact words of it"', "two words", "three plain words", "x connected to today"]
    got = [r[0] for r in spark.createDataFrame([(q,) for q in asked], "q string").select(search.route(F.col("q"))).collect()]
    assert got == ["temporal", "graph", "keyword", "keyword", "hybrid", "temporal"]


def test_filters_and_probes(spark):
    df = spark.range(2000)
    bits, hashes = retrieval.filter_size(1000, 0.01)
    held = df.where("id < 1000")
    b = retrieval.bloom(held, "id", bits, hashes)
    maybe = {r.id for r in retrieval.maybe_in(df, "id", b, bits, hashes).collect()}
    assert set(range(1000)) <= maybe and len(maybe) < 1050
    assert retrieval.filter_count(b, bits, hashes).first().n == pytest.approx(1000, rel=0.1)
    assert retrieval.counting_bloom(held, "id", bits, hashes).agg(F.sum("n")).first()[0] == 1000 * hashes
    assert sorted(r.position for r in aggregates.bitmap_positions(aggregates.bitmap(spark.createDataFrame([(0,), (7,), (32768,), (70000,)], "p bigint"), "p")).collect()) == [0, 7, 32768, 70000]
    assert retrieval.adaptive_probes(4, np.full(100, 2.0)) == 10 and retrieval.adaptive_probes(4, np.arange(1, 101)) == 4
    assert [retrieval.drift_probes(4, d, 10) for d in (5, 6, 10, 11)] == [4, 5, 6, 8]


def test_gate_by_vector(spark):
    """Against the loop written out: only rows that go through move the prediction."""
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 3))
    df = spark.createDataFrame([("k", i, i, v.tolist()) for i, v in enumerate(x)], "key string, id bigint, ts bigint, value array<double>")
    state, want = np.zeros(3), []
    for i, v in enumerate(x):
        rms = np.sqrt(((v - state) ** 2).mean())
        if rms > 1.0:
            want.append((i, rms))
            state = 0.7 * state + 0.3 * v
    got = stateful.residual_gate(df, 1.0).orderBy("id").collect()
    assert [g.id for g in got] == [i for i, _ in want] and np.allclose([g.residual for g in got], [x for _, x in want])


def test_bundle(spark):
    r = np.random.default_rng(2)
    x = r.integers(-(2**63), 2**63 - 1, (3, 4), dtype=np.int64)
    df = spark.createDataFrame([tuple(v.tolist() for v in x)], "a array<bigint>, b array<bigint>, c array<bigint>")
    want = (x[0] & x[1]) | (x[1] & x[2]) | (x[0] & x[2])
    assert df.select(vectors.hv_bundle([F.col("a"), F.col("b"), F.col("c")])).first()[0] == want.tolist()


def test_knn_by_blocks_agrees(spark, monkeypatch):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(200, 4)))], "vec_id bigint, embedding array<double>")
    key = lambda out: sorted((x.query_id, x["rank"], x.id) for x in out.collect())
    whole = key(search.knn_join(df, df, 3))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(search, "BLOCK_ROWS", 60)
    assert key(search.knn_join(df, df, 3)) == whole


def test_reasoning_paths_and_prompt(spark, chain):
    scores = spark.createDataFrame([(i, 1.0 / (1 + i)) for i in range(3)], "id bigint, score double")
    best = retrieval.reasoning_paths(chain, scores, 0, 3, 2).collect()
    assert [r.path for r in best] == [[0, 1], [0, 1, 2]] and best[0].score == pytest.approx(0.75)
    found = spark.createDataFrame([(1, "one", 0.5), (2, "two", 0.9)], "id bigint, content string, score double")
    assert retrieval.prompt(found, "why?").first().prompt == "Context:\n[2] two\n[1] one\n\nQuestion: why?"
