"""Whole jobs on tables that the first versions of these queries couldn't take."""

import itertools
import time
import tracemalloc

import numpy as np
import pytest

from orrery.functions import kernels
from orrery.llm import quality
from orrery.operators import graph, search


def test_min_cut_of_large_sparse_graphs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = int(rng.integers(2, 8)), int(rng.integers(0, 20))
        edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(1, 4, m), strict=True)]
        cut = lambda s: sum(c for a, b, c in edges if (a in s) != (b in s))  # noqa: B023, E731
        value, side = kernels.min_cut(n, edges)
        assert value == cut(side) == min(cut([i for i in range(n) if k >> i & 1]) for k in range(1, 2**n - 1))
    began = time.time()
    ring = [(i, (i + 1) % 4000, 1.0) for i in range(4000)]
    assert kernels.min_cut(4000, ring)[0] == 2.0
    assert kernels.min_cut(8000, ring + [(a + 4000, b + 4000, 1.0) for a, b, _ in ring] + [(0, 4000, 1.5)])[0] == 1.5
    assert time.time() - began < 60


def _points(n: int, seed: int = 1) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=(n, 8))
    x[n // 2 : n // 2 + 9] = x[:9]
    return x


def test_spectral_clusters_without_a_matrix_of_all_pairs():
    x = _points(900)
    dense = kernels.spectral_cluster(np.exp(-np.linalg.norm(x[:, None] - x[None], axis=-1)), 2)
    assert (kernels.spectral_points(x, 2) == dense).all()
    tracemalloc.start()
    kernels.spectral_points(_points(6000)[:, :4], 2)
    assert tracemalloc.get_traced_memory()[1] < 150e6  # the matrix alone has 288 MB
    tracemalloc.stop()


def test_persistence_of_components_without_listing_pairs():
    x = _points(120)
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    for radius in (np.inf, 2.0):
        # Kruskal: sorted edges that join two parts.
        part, deaths = list(range(len(x))), []
        for i, j in sorted(itertools.combinations(range(len(x)), 2), key=lambda p: d[p]):
            if d[i, j] <= radius and part[i] != part[j]:
                deaths += [d[i, j]] if d[i, j] > 0 else []
                part = [part[i] if p == part[j] else p for p in part]
        assert kernels.persistence(x, 0, radius) == [(0, 0.0, w) for w in deaths] + [(0, 0.0, np.inf)] * len(set(part))
    tracemalloc.start()
    assert len(kernels.persistence(_points(1500), 0)) == 1500 - 9
    assert tracemalloc.get_traced_memory()[1] < 20e6  # 1.1 million pairs before
    tracemalloc.stop()


def test_attention_of_many_queries_in_bounded_memory():
    x = _points(20_000)
    tracemalloc.start()
    y = kernels.tiled(x[:, :2], x[:300, :2], x[:300], 1024)
    assert tracemalloc.get_traced_memory()[1] < 40e6  # 20,000 x 300 scores, several times, before
    tracemalloc.stop()
    assert np.allclose(y, kernels.attention(x[:, :2], x[:300, :2], x[:300]), rtol=1e-12, atol=1e-14)


@pytest.fixture
def vecs(spark, monkeypatch):
    """Vectors in single precision with copies, dealt into many small blocks; and the table of all their distances."""
    monkeypatch.setattr(search, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(search, "SIDE_BYTES", 2000)
    x = _points(230, 5).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 8), (999, None)], "vec_id bigint, embedding array<float>")
    x = x.astype(float)
    return df, np.linalg.norm(x[:, None] - x[None], axis=-1)


def _copies_no_row(df) -> bool:
    return "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_knn_of_blocks_that_are_not_copied(vecs):
    df, d = vecs
    found = search.knn_join(df, df, 3)
    assert _copies_no_row(found)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1, int(j)) for i in range(230) for r, j in enumerate(np.lexsort((np.arange(230), d[i]))[:3])}
    assert {(r.query_id, r["rank"], r.id) for r in found.collect()} == want


def test_total_of_blocks_that_are_not_copied(vecs):
    df, d = vecs
    found = search.pairwise_total(df)
    assert _copies_no_row(found)
    got = found.first()
    assert got.n == 230 * 229 // 2 and got.total == pytest.approx(np.triu(d).sum(), rel=1e-12)


def _shuffle_files(spark) -> set[str]:
    """The files of shuffles that the session holds on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}


def _left_by(spark, run) -> int:
    """How many shuffle files are left when ``run`` has made a DataFrame, which isn't executed yet."""
    before = _shuffle_files(spark)
    held = run()
    for _ in range(50):  # files go in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert held.columns
    return len(left)


def test_total_leaves_its_rows_once_on_disk(spark, vecs):
    assert _left_by(spark, lambda: search.pairwise_total(vecs[0])) == 0


def test_similarity_leaves_its_rows_once_on_disk(spark, vecs):
    df = vecs[0]
    for other in (df, df.where("vec_id >= 0 or vec_id is null")):
        assert _left_by(spark, lambda: search.similarity_join(df, other, 0.5)) == 0  # noqa: B023


def test_similarity_of_blocks_that_are_not_copied(vecs):
    df, d = vecs
    for other in (df, df.where("vec_id >= 0 or vec_id is null")):
        found = search.similarity_join(df, other, 1.5, metric="l2")
        assert _copies_no_row(found)
        rows = found.collect()
        want = {(i, j): d[i, j] for i in range(230) for j in range(i + 1, 230) if d[i, j] < 1.5}
        assert len(rows) == len(want) > 9 and all(r.distance == pytest.approx(want[r.a, r.b], abs=1e-12) for r in rows)
    angle = {(r.a, r.b) for r in search.similarity_join(df, df, 1e-9).collect()}
    assert angle == {(i, 115 + i) for i in range(9)}


def _chain(spark):
    x = np.random.default_rng(4).normal(size=(40, 6))
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    edges = [(i, j) for i in range(40) for j in range(39) if (i * 7 + j * 3) % 5 == 0] + [(777, 1)]
    return x, feats, spark.createDataFrame(edges, "src bigint, dst bigint"), edges


def test_gcn_sums_mapped_features(spark):
    x, feats, df, edges = _chain(spark)
    w, b = np.random.default_rng(5).normal(size=(6, 3)), np.array([0.1, -0.2, 0.3])
    out = graph.gcn_layer(df, feats, w, b)
    assert _copies_no_row(out)
    for r in out.collect():
        near = [i for i, j in edges if j == r.id]
        m = sum((x[i] for i in near if i < 40), np.zeros(6)) / max(1, len(near)) ** 0.5
        assert np.allclose(r.v, np.maximum(m @ w + b, 0))


def _shuffled(plan) -> int:
    """Rows that the exchanges of a plan that has run wrote."""
    kind, rows = plan.getClass().getSimpleName(), 0
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    if kind == "ShuffleExchangeExec":
        rows = plan.metrics().get("shuffleRecordsWritten").get().value()
    return rows + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_sage_neighbours_shuffle_k_rows_a_query(spark, monkeypatch):
    """However many blocks there are, not k rows of each part of the table."""
    monkeypatch.setattr(search, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(search, "BLOCK_ROWS", 20)
    monkeypatch.setattr(search, "SIDE_BYTES", 2000)
    monkeypatch.setattr(search, "QUERY_BYTES", 2000, raising=False)
    x = _points(1500, 9).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    near = search.knn_join(df, df, 5)
    got = {(r.query_id, r["rank"]): r.id for r in near.collect()}
    d = np.linalg.norm(x[:, None].astype(float) - x[None], axis=-1)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, n + 1): int(j) for i in range(1500) for n, j in enumerate(np.lexsort((np.arange(1500), d[i]))[:5])}
    assert _shuffled(near._jdf.queryExecution().executedPlan()) == 5 * 1500


def test_sage_averages_mapped_features(spark):
    x, feats, df, edges = _chain(spark)
    a, b = np.random.default_rng(6).normal(size=(2, 6, 3))
    out = graph.sage_layer(df, feats, a, b)
    assert _copies_no_row(out)
    for r in out.collect():
        near = [x[i] for i, j in edges if j == r.id and i < 40]
        assert np.allclose(r.v, np.maximum(x[r.id] @ a + (np.mean(near, 0) @ b if near else 0), 0))


def _texts(spark):
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("abcdefghijklé"), int(n))) for n in rng.integers(1, 9, 400)]
    rows = [(i % 50 if i < 60 else None, [None, "en", "de"][i % 3], " ".join(rng.choice(made, int(rng.integers(0, 60))))) for i in range(80)]
    return spark.createDataFrame([*rows, (7, "en", None)], "doc_id bigint, lang string, text string")


def test_rare_ngrams_are_scored_by_the_whole_model(spark):
    """Whatever is held in memory, a document's score is that of all n-grams."""
    docs = _texts(spark)
    key = lambda df: sorted((str(r.doc_id), r.n_words, r.kept, r.base_failed, round(r.log_ppl, 7)) for r in df.collect())
    want = key(quality.quality_table(docs, quality.Rules(min_share=0.0)))
    for share in (2e-3,):
        assert key(quality.quality_table(docs, quality.Rules(min_share=share))) == want
    # Texts that the model wasn't counted on back off by the whole model too.
    other = spark.createDataFrame([(1, "en", "abba zebra κόσμος lé"), (2, "xx", "abba"), (3, None, "cab")], "doc_id bigint, lang string, text string")
    got = [{r.doc_id: r.log_ppl for r in quality.score(other, quality.fit(docs, quality.Rules(min_share=s))).collect()} for s in (0.0, 5e-3)]
    assert got[0] == pytest.approx(got[1], abs=1e-8) and got[0][2] == 0
    model = quality.fit(docs, quality.Rules(min_share=0.0))
    words = "abba zebra κόσμος lé".split()
    assert got[1][1] == pytest.approx(-model.words("en", words).sum() / (sum(map(len, words)) + 4), abs=1e-8)


def test_filter_keeps_what_the_whole_model_keeps(spark):
    docs = _texts(spark)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(quality.quality_filter(docs, quality.Rules(min_share=1.0))) == key(quality.quality_filter(docs, quality.Rules(min_share=0.0)))


def test_pipeline_stage_reads_no_rank_of_ngrams(spark, monkeypatch):
    """The first stage scores by the whole model, whatever is held in memory."""
    import corpus_pipeline

    monkeypatch.setattr(quality.quality_filter, "__defaults__", (quality.Rules(min_share=1.0),))
    docs = _texts(spark)
    got = sorted(map(str, corpus_pipeline.quality_rules(spark, docs, "").collect()))
    assert got == sorted(map(str, quality.quality_filter(docs, quality.Rules(min_share=0.0)).collect()))
