"""Queries of the suite against equivalent SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from orrery import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each kind; all are compared outside the tests.
SOME = ["topk_l2", "topk_cosine", "knn_join_exact", "similarity_join", "filter_ne", "filter_and_or", "bm25_topk", "fusion_rrf", "sparse_distances", "sq8_codes", "poincare_distance", "agg_spread", "join_semi", "join_full", "graph_degrees", "cypher_match_optional", "sparql_optional", "sparql_group", "window_session", "crdt_lww", "vector_sql"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(v)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 100
