"""Quantization: 8-bit scalar, sign bits, and product quantization by k-means in subspaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import fold, hamming_words, vec

LEVELS = 254.0


def sq8(v) -> Column:
    """struct(codes, low, step): codes truncated toward zero over 254 levels; a constant vector has step 1."""
    v = vec(v)
    low = F.array_min(v).cast("double")
    spread = F.array_max(v).cast("double") - low
    step = F.when(spread < 1e-12, 1.0).otherwise(spread / LEVELS)
    codes = F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), ((x.cast("double") - low) / step - 127).cast("int"))))
    return F.struct(codes.alias("codes"), low.alias("low"), step.alias("step"))


def sq8_decode(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: (c + 127) * q["step"] + q["low"])


def sq8_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two coded vectors of equal steps, without decoding; steps are averaged."""
    step = (a["step"] + b["step"]) / 2
    return F.sqrt(fold(F.zip_with(a["codes"], b["codes"], lambda x, y: ((x - y) * (x - y)).cast("double")))) * step


def binary(v) -> Column:
    """Bytes of sign bits: bit i of byte j is set if component 8j+i is above 0."""
    v = vec(v)
    chunk = lambda j: F.slice(v, j * 8 + 1, 8)
    byte = lambda j: F.aggregate(F.transform(chunk(j), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 8).cast("int") - 1), byte)


def binary_hamming(a: Column, b: Column) -> Column:
    return hamming_words(a, b)


def pq_train(vectors: DataFrame, column: str, subspaces: int, centroids: int = 16, sample: int = 20_000, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Codebooks [subspace, centroid, part] from a bounded sample; all vectors are coded with them afterwards."""
    n = vectors.count()
    some = vectors.select(F.col(column).cast("array<double>").alias("v")).where("v is not null")
    if n > sample:
        some = some.orderBy(F.xxhash64("v")).limit(sample)
    x = np.array([r.v for r in some.toLocalIterator()])
    rng = np.random.default_rng(seed)
    out = []
    for part in np.split(x, subspaces, axis=1):
        c = part[rng.permutation(len(part))[:centroids]]
        for _ in range(rounds):
            near = ((part[:, None, :] - c[None]) ** 2).sum(-1).argmin(1)
            c = np.array([part[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        out.append(c)
    return np.array(out)


def pq_encode(v: Column, books: np.ndarray) -> Column:
    """Index of the nearest centroid of each part, as a Column expression."""
    codes = []
    d = books.shape[2]
    for s, book in enumerate(books):
        part = F.slice(v, s * d + 1, d)
        dist = [F.struct(fold(F.zip_with(part, vec(c), lambda x, y: (x - y) * (x - y))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(book)]
        codes.append(F.array_min(F.array(*dist))["k"])
    return F.array(*codes)


def pq_table(query: list[float], books: np.ndarray) -> list[list[float]]:
    """Squared distances of a query's parts to all centroids."""
    parts = np.split(np.asarray(query, float), len(books))
    return [[float(((p - c) ** 2).sum()) for c in b] for p, b in zip(parts, books, strict=True)]


def pq_distance(codes: Column, table: list[list[float]]) -> Column:
    """Asymmetric distance: looks each code up in the query's table."""
    total = F.lit(0.0)
    for s, row in enumerate(table):
        total = total + F.get(vec(row), F.get(codes, F.lit(s)))
    return F.sqrt(total)
