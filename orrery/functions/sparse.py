"""Sparse vectors as ``struct<indices:array<int>, values:array<double>, dim:int>``, indices ascending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import fold


def sparse(indices: Column, values: Column, dim: Column | int) -> Column:
    """From parallel arrays: sorted, zeros dropped, and of repeated indices the first kept. Indices outside raise."""
    dim = F.lit(dim) if isinstance(dim, int) else dim
    pairs = F.zip_with(indices, values, lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v")))
    first = F.aggregate(
        pairs,
        F.array().cast("array<struct<i:int,v:double>>"),
        lambda acc, p: F.when(F.exists(acc, lambda q: q["i"] == p["i"]), acc).otherwise(F.concat(acc, F.array(p))),
    )
    kept = F.array_sort(F.filter(first, lambda p: p["v"] != 0))
    bad = F.exists(indices, lambda i: (i < 0) | (i >= dim))
    made = F.struct(F.transform(kept, lambda p: p["i"]).alias("indices"), F.transform(kept, lambda p: p["v"]).alias("values"), dim.cast("int").alias("dim"))
    return F.when(bad, F.raise_error(F.lit("sparse index outside the dimension")).cast("struct<indices:array<int>,values:array<double>,dim:int>")).otherwise(made)


def parse(text: Column) -> Column:
    """From ``{index:value,...}`` or ``{index:value,...}/dim``; without dim, one more than the last index."""
    body = F.regexp_extract(text, r"^\s*\{(.*)\}", 1)
    items = F.filter(F.split(body, ","), lambda x: F.trim(x) != "")
    ids = F.transform(items, lambda x: F.trim(F.split(x, ":")[0]).cast("int"))
    vals = F.transform(items, lambda x: F.trim(F.split(x, ":")[1]).cast("double"))
    dim = F.regexp_extract(text, r"\}\s*/\s*(\d+)", 1)
    return sparse(ids, vals, F.when(dim != "", dim.try_cast("int")).otherwise(F.coalesce(F.array_max(ids) + 1, F.lit(0))))


def to_text(s: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.zip_with(s["indices"], s["values"], lambda i, v: F.concat_ws(":", i, v)), ","), F.lit("}/"), s["dim"])


def _map(s: Column) -> Column:
    return F.map_from_arrays(s["indices"], s["values"])


def get(s: Column, i: int) -> Column:
    return F.coalesce(F.try_element_at(_map(s), F.lit(i)), F.lit(0.0))


def nnz(s: Column) -> Column:
    return F.size(s["indices"])


def sparsity(s: Column) -> Column:
    return 1 - nnz(s) / F.nullif(s["dim"], F.lit(0))


def norm(s: Column) -> Column:
    return F.sqrt(fold(F.transform(s["values"], lambda v: v * v)))


def l1_norm(s: Column) -> Column:
    return fold(F.transform(s["values"], F.abs))


def _zip(a: Column, b: Column, f) -> Column:
    z = F.map_zip_with(_map(a), _map(b), lambda k, x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    return F.map_values(z)


def dot(a: Column, b: Column) -> Column:
    return fold(_zip(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine *similarity*; 0.0 if a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(fold(_zip(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return fold(_zip(a, b, lambda x, y: F.abs(x - y)))


def add(a: Column, b: Column) -> Column:
    z = F.map_zip_with(_map(a), _map(b), lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return sparse(F.map_keys(z), F.map_values(z), F.greatest(a["dim"], b["dim"]))


def scale(s: Column, by: float) -> Column:
    return F.struct(s["indices"].alias("indices"), F.transform(s["values"], lambda v: v * by).alias("values"), s["dim"].alias("dim"))


def normalize(s: Column) -> Column:
    n = norm(s)
    return F.when(n == 0, s).otherwise(F.struct(s["indices"].alias("indices"), F.transform(s["values"], lambda v: v / F.nullif(n, F.lit(0.0))).alias("values"), s["dim"].alias("dim")))


def prune(s: Column, threshold: float) -> Column:
    """Without entries whose magnitude is under the threshold."""
    p = F.filter(F.arrays_zip(s["indices"].alias("i"), s["values"].alias("v")), lambda x: F.abs(x["v"]) >= threshold)
    return F.struct(F.transform(p, lambda x: x["i"]).alias("indices"), F.transform(p, lambda x: x["v"]).alias("values"), s["dim"].alias("dim"))


def top_k(s: Column, k: int) -> Column:
    """The k entries of largest magnitude (ties: smaller index), by index."""
    z = F.transform(F.arrays_zip(s["indices"].alias("i"), s["values"].alias("v")), lambda x: F.struct((-F.abs(x["v"])).alias("m"), x["i"].alias("i"), x["v"].alias("v")))
    p = F.array_sort(F.transform(F.slice(F.array_sort(z), 1, k), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"))))
    return F.struct(F.transform(p, lambda x: x["i"]).alias("indices"), F.transform(p, lambda x: x["v"]).alias("values"), s["dim"].alias("dim"))


def to_dense(s: Column) -> Column:
    return F.when(s["dim"] == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(s["dim"] - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(_map(s), i), F.lit(0.0))))


def from_dense(v: Column) -> Column:
    return sparse(F.sequence(F.lit(0), F.size(v) - 1), v, F.size(v))


def dot_dense(s: Column, dense: Column) -> Column:
    """Sparse times dense."""
    return fold(F.zip_with(s["indices"], s["values"], lambda i, v: v * F.coalesce(F.get(dense, i).cast("double"), F.lit(0.0))))


def bm25(query: Column, doc: Column, doc_len: Column, avg_len: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Score of a document's term counts against a query's idf weights."""
    tf = F.map_zip_with(_map(query), _map(doc), lambda k, idf, f: F.when(idf.isNull() | f.isNull(), 0.0).otherwise(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * doc_len / avg_len))))
    return fold(F.map_values(tf))
