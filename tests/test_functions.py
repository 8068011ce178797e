"""Functions against NumPy, and the semantic traps of zero vectors, ties and missing fields."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import curved, distributions, geo, kernels, quantize, sparse, text, vectors


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


A, B = [1.0, -2.0, 0.0, 3.5], [0.5, 2.0, 0.0, -1.0]


def test_distances(spark):
    a, b = np.array(A), np.array(B)
    got = one(spark, vectors.l2(A, B), vectors.manhattan(A, B), vectors.chebyshev(A, B), vectors.inner_product(A, B), vectors.cosine(A, B), vectors.canberra(A, B), vectors.bray_curtis(A, B), vectors.hamming_sign(A, B), vectors.minkowski(A, B, 3))
    s = np.abs(a) + np.abs(b)
    want = [np.linalg.norm(a - b), np.abs(a - b).sum(), np.abs(a - b).max(), -(a @ b), 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), (np.abs(a - b)[s > 0] / s[s > 0]).sum(), np.abs(a - b).sum() / s.sum(), 2, (np.abs(a - b) ** 3).sum() ** (1 / 3)]
    assert np.allclose([float(x) for x in got], want)


def test_zero_vectors_and_lengths(spark):
    z = [0.0, 0.0, 0.0, 0.0]
    assert one(spark, vectors.cosine(z, A))[0] == 1.0
    assert one(spark, vectors.l2([1.0], A, "zero"))[0] == 0.0
    assert one(spark, vectors.l2([1.0, 0.0], A, "truncate"))[0] == 2.0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, vectors.l2([1.0], A))


def test_sparse(spark):
    s = sparse.sparse(F.array(*map(F.lit, [2, 0, 5, 0])), F.array(*map(F.lit, [2.0, 1.0, 3.0, 9.0])), 6)
    u = sparse.sparse(F.array(*map(F.lit, [2, 3, 5])), F.array(*map(F.lit, [4.0, 5.0, 6.0])), 6)
    got = one(spark, sparse.dot(s, u), sparse.to_text(s), sparse.cosine(s, sparse.parse(F.lit("{}/6"))), sparse.nnz(sparse.prune(u, 4.5)), sparse.to_dense(s), sparse.get(s, 5), sparse.to_text(sparse.top_k(u, 2)))
    assert got[0] == 26.0 and got[1] == "{0:1.0,2:2.0,5:3.0}/6" and got[2] == 0.0 and got[3] == 2
    assert got[4] == [1.0, 0, 2.0, 0, 0, 3.0] and got[5] == 3.0 and got[6] == "{3:5.0,5:6.0}/6"


def test_quantize(spark):
    got = one(spark, quantize.binary([0.5, 0.0, -1.0, 2.0, 1.0, 0.0, 0.0, 0.0, 3.0]), quantize.sq8(A)["codes"], quantize.sq8([2.0, 2.0])["step"])
    assert got[0] == [0b00011001, 1] and got[2] == 1.0
    assert min(got[1]) == -127 and max(got[1]) == 127


def test_curved(spark):
    a, b = [0.1, 0.2], [-0.3, 0.4]
    got = one(spark, curved.poincare_distance(a, b), curved.lorentz_distance(curved.poincare_to_lorentz(a), curved.poincare_to_lorentz(b)), vectors.l2(curved.exp_map(a, curved.log_map(a, b)), b), vectors.l2(curved.lorentz_to_poincare(curved.poincare_to_lorentz(a)), a), curved.spherical_distance([1.0, 0.0], [0.0, 1.0]))
    assert got[0] == pytest.approx(got[1], abs=1e-9) and got[2] < 1e-9 and got[3] < 1e-12 and got[4] == pytest.approx(np.pi / 2)


def test_distributions(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    got = one(spark, distributions.kl(p, q), distributions.jensen_shannon(p, q), distributions.wasserstein([3.0, 1.0], [2.0, 5.0]))
    assert got[0] == pytest.approx(np.log(2), abs=1e-9) and 0 < got[1] < np.log(2) and got[2] == 1.5
    cost = np.abs(np.subtract.outer(np.arange(3.0), np.arange(3.0)))
    c, plan = distributions.sinkhorn(cost, np.array([1.0, 0, 0]) + 1e-9, np.array([0, 0, 1.0]) + 1e-9, 0.05)
    assert c == pytest.approx(2, abs=1e-3) and plan.sum() == pytest.approx(1)


def test_text_and_geo(spark):
    got = one(spark, text.terms(F.lit("The Running nations, quickly jumped!")), text.str_before(F.lit("a-b"), "x"), text.substring0(F.lit("hello"), 1, 3), geo.distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert got[0] == ["runn", "nation", "quick", "jump"] and got[1] == "" and got[2] == "ell" and got[3] == pytest.approx(111.19, abs=0.01)


def test_kernels():
    r = np.random.default_rng(0)
    q, k, v = r.normal(size=(5, 4)), r.normal(size=(7, 4)), r.normal(size=(7, 3))
    assert np.allclose(kernels.attention(q, k, v), kernels.tiled(q, k, v, 2))
    assert kernels.min_cut(4, [(0, 1, 3.0), (1, 2, 1.0), (2, 3, 3.0)]) [0] == 1.0
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]])
    assert kernels.betti(square, 1.2) == [1, 1]
    two = np.zeros((6, 6))
    for a, b in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]:
        two[a, b] = two[b, a] = 1
    c = kernels.spectral_cluster(two + 1e-6, 2)
    assert len(set(c[:3])) == 1 and len(set(c[3:])) == 1 and c[0] != c[3]
    a = r.normal(size=(4, 4))
    a = a @ a.T + np.eye(4)
    assert np.allclose(a @ kernels.conjugate_gradient(a, np.ones(4)), 1)
    assert kernels.bottleneck([(0, 2)], [(0, 1.5)]) == 0.5
    assert kernels.effective_resistance(np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0.0]]), 0, 2) == pytest.approx(2)


def test_nearest_ties_and_blocks():
    """Equal vectors tie by id, however rows are dealt; components that aren't finite take no part."""
    import numpy as np

    from orrery.operators import search

    r = np.random.default_rng(3)
    x = r.normal(size=(300, 7)).repeat(3, 0)[r.permutation(900)]
    x[5, 2] = np.nan
    ids = r.permutation(900)
    for metric in ("l2", "l1", "cosine", "ip"):
        d = search._distances(metric, x[:40], x)
        whole = search.nearest(metric, x[:40], ids[:40], x, ids, 10, True)
        parts = [search.nearest(metric, x[:40], ids[:40], x[lo : lo + 111], ids[lo : lo + 111], 10, True) for lo in range(0, 900, 111)]
        again = search._best(*[np.concatenate(z) for z in zip(*parts, strict=True)], 10)
        assert all((a == b).all() for a, b in zip(whole, again, strict=True))
        for i in range(40):
            want = sorted((round(v, 9), j) for v, j in zip(d[i], ids, strict=True) if np.isfinite(v) and j != ids[i])[:10]
            got = [(round(v, 9), j) for k, j, v in zip(*whole, strict=True) if k == i]
            assert got == want


def test_bm25_of_hand_made_texts(spark):
    from orrery.operators import search

    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, None), (4, ""), (5, "the")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "red foxes"), (2, "zebra"), (3, None)], "query_id bigint, text string")
    got = {(r.query_id, r.doc_id): r.score for r in search.bm25(docs, asked, 5).collect()}
    import math

    n, mean = 5, 5 / 5
    idf = math.log((n - 1 + 0.5) / 1.5 + 1)
    assert set(got) == {(1, 1)} and abs(got[1, 1] - idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean))) < 1e-9
