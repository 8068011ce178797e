"""Vector and keyword search: exact and filtered top-k, kNN joins, fusion, BM25, re-ranking, evaluation."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels, text, vectors
from .graph import cut

#: Queries whose packed matrix stays under this are sent to all tasks; beyond, they are joined by blocks.
BROADCAST_BYTES = 32 << 20


def top_k(df: DataFrame, vector: str, query, k: int, metric: str = "l2", id_col: str = "vec_id") -> DataFrame:
    """The k nearest rows, ties by id: one scan and a bounded heap a task."""
    d = vectors.DISTANCES[metric](F.col(vector), query)
    return df.withColumn("distance", d).orderBy("distance", id_col).limit(k)


def filtered_top_k(df: DataFrame, vector: str, query, k: int, predicate: Column, strategy: str = "pre", metric: str = "l2", id_col: str = "vec_id") -> DataFrame:
    """``pre``: nearest among rows that pass. ``post``: of the k nearest, those that pass, maybe fewer. ``auto``: pre if
    under a fifth of the rows pass."""
    if strategy == "auto":
        share = df.select(F.avg(F.coalesce(predicate, F.lit(False)).cast("int"))).first()[0] or 0.0
        strategy = "pre" if share < 0.2 else "post"
    if strategy == "pre":
        return top_k(df.where(predicate), vector, query, k, metric, id_col)
    return top_k(df, vector, query, k, metric, id_col).where(predicate)


def within(df: DataFrame, vector: str, query, radius: float, metric: str = "l2") -> DataFrame:
    d = vectors.DISTANCES[metric](F.col(vector), query)
    return df.withColumn("distance", d).where(F.col("distance") < radius)


def _distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "cosine":
        nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        n = nq[:, None] * nx[None, :]
        return np.where(n == 0, 1.0, 1 - (q @ x.T) / np.where(n == 0, 1, n))
    if metric == "ip":
        return -(q @ x.T)
    if metric == "l1":
        return np.stack([np.abs(x - v).sum(1) for v in q])
    # Directly, not by expanding the square, which cancels for near vectors.
    return np.sqrt(np.maximum(np.stack([((x - v) ** 2).sum(1) for v in q]), 0))


#: Distances that a task holds at once.
MATRIX = 1 << 21

_FOUND = "query_id bigint, id bigint, distance double"


def _rough(metric: str, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(what orders pairs as their distances do, how far rounding may take two of them apart), by matrix products."""
    eps = 16 * (q.shape[1] + 8) * float(np.finfo(q.dtype).eps)
    nq, nx = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    finite = lambda v: float(v[np.isfinite(v)].max(initial=0.0))
    if metric == "l2":
        s = q @ x.T
        s *= -2
        s += nx[None, :]
        s += nq[:, None]
        return s, eps * (finite(nq) + finite(nx))
    d = _distances(metric, q, x)
    return d, eps * max(1.0, finite(nq), finite(nx), finite(np.abs(d).ravel()))


def _exactly(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each row of one to the same row of the other; equal rows give equal numbers, wherever they lie."""
    a, b = a.astype(float, copy=False), b.astype(float, copy=False)
    if metric == "l2":
        return np.sqrt(((a - b) ** 2).sum(1))
    if metric == "l1":
        return np.abs(a - b).sum(1)
    dot = (a * b).sum(1)
    if metric == "ip":
        return -dot
    n = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.where(n == 0, 1.0, 1 - dot / np.where(n == 0, 1, n))


def _best(row: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row, ties by id."""
    order = np.lexsort((ids, d, row))
    row, ids, d = row[order], ids[order], d[order]
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    return row[rank < k], ids[rank < k], d[rank < k]


def _single(metric: str, *sides: np.ndarray) -> bool:
    """Whether single precision can tell what it can't rule out: no square is lost at either end of its range."""
    top = [float((v[np.isfinite(v)] ** 2).max(initial=0.0)) for v in sides]
    return metric == "l2" and all(v.dtype == np.float32 for v in sides) and max(top) < 1e28 and min(top) > 1e-20


def nearest(metric: str, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, skip_same: bool, limit: np.ndarray | None = None):
    """(row of q, id, distance) of the k nearest of x. Matrix products leave those that rounding can't rule out; these
    are then measured one by one, so results don't depend on how rows were dealt. ``limit``: distances beyond which a
    row of q needs none any more."""
    if not _single(metric, q, x):
        q, x = q.astype(float, copy=False), x.astype(float, copy=False)
    found = []
    step = max(1, MATRIX // max(1, len(x)))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        s, slack = _rough(metric, part, x)
        most = None if limit is None else limit[lo : lo + step]
        if most is not None and np.isfinite(most).all():
            most = np.nextafter(((most**2 if metric == "l2" else most) + slack).astype(s.dtype), np.array(np.inf, s.dtype))
            r, c = kernels.places(s <= most[:, None])
            ok = np.isfinite(s[r, c])
            if skip_same:
                ok &= q_ids[r + lo] != x_ids[c]
            r, c = r[ok], c[ok]
        else:
            s[~np.isfinite(s)] = np.inf
            if skip_same:
                s[q_ids[lo : lo + step, None] == x_ids[None, :]] = np.inf
            if s.shape[1] > k:
                r, c = kernels.places((s <= np.partition(s, k - 1, axis=1)[:, k - 1 : k] + np.array(slack, s.dtype)) & np.isfinite(s))
            else:
                r, c = kernels.places(np.isfinite(s))
        size = max(1, MATRIX // max(1, q.shape[1]))
        d = [_exactly(metric, part[r[i : i + size]], x[c[i : i + size]]) for i in range(0, len(r), size)]
        found.append(_best(r + lo, x_ids[c], np.concatenate(d) if d else np.zeros(0), k))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _limits(best: tuple, n: int, k: int) -> np.ndarray:
    """The k-th distance of each of n rows in what :func:`_best` gave; infinite where fewer were found."""
    row, _, d = best
    out = np.full(n, np.inf)
    last = np.arange(k - 1, len(row))
    last = last[row[last] == row[last - (k - 1)]]
    out[row[last]] = d[last]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as a matrix; null components are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    lens = pc.list_value_length(column)
    if len(column) and pc.min(lens).as_py() != pc.max(lens).as_py():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", vector: str = "embedding", id_col: str = "vec_id", exclude_self: bool = True) -> DataFrame:
    """(query_id, id, distance, rank): each query's k nearest rows. Null vectors take no part, nor do distances that
    aren't finite.

    Two phases: every task scores its rows against a block of queries as a matrix product and keeps k a query; a window
    ranks what is left. Queries whose matrix is over BROADCAST_BYTES meet the rows by blocks of both.
    """
    spark = base.sparkSession
    q = queries.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and query_id is not null")
    b = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and id is not null")
    n, dims = q.agg(F.count("*"), F.max(F.size("v"))).first()
    if n * (dims or 1) * 8 <= BROADCAST_BYTES:
        rows = q.toArrow().combine_chunks()
        held = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), _matrix(pa.concat_arrays(rows["v"].chunks)) if n else np.zeros((0, 0))))

        def run(batches):
            ids, m = held.value
            best, limit = _NONE, None
            for batch in batches:
                if len(ids) and batch.num_rows:
                    new = nearest(metric, m, ids, _matrix(batch.column("v")), batch.column("id").to_numpy(), k, exclude_self, limit)
                    best = _best(*[np.concatenate(z) for z in zip(best, new, strict=True)], k)
                    limit = _limits(best, len(ids), k)
            yield _found(ids, best)

        found = b.mapInArrow(run, _FOUND)
    else:
        # Neither side goes to the driver, and no row is copied: a task holds some blocks of queries, and the rows stream
        # past them, all of them once there are blocks of queries for every core. So k rows a query go on, however
        # many rows there are.
        def meet(met):
            held = {}
            for _, x_ids, x, block, ids, m in met:
                ids, best, limit = held.get(block) or (ids.copy(), _NONE, None)
                new = nearest(metric, m, ids, x, x_ids, k, exclude_self, limit)
                best = _best(*[np.concatenate(z) for z in zip(best, new, strict=True)], k)
                held[block] = ids, best, _limits(best, len(ids), k)
            for ids, best, _ in held.values():
                yield _found(ids, best)

        right = _packed(queries, vector, id_col)
        left = right if base is queries else _packed(base, vector, id_col)
        cores = spark.sparkContext.defaultParallelism
        # Blocks differ by a few rows, so the number of parts of whole blocks follows from bytes.
        blocks = max(1, -(-n // BLOCK_ROWS))
        parts = min(blocks, max(4 * cores, -(-(right[1] + 24 * k * n) // QUERY_BYTES)))
        found = _block_pairs(left, right, meet, _FOUND, held=parts, streams=-(-2 * cores // parts))
    w = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_NONE = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)


def _found(ids: np.ndarray, best: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], names=["query_id", "id", "distance"])


#: Rows of a block that meets another: their distances are tiles of one matrix.
BLOCK_ROWS = 4096
#: Bytes of vectors of one side that a task holds, and sends to Python at a time.
SIDE_BYTES = 16 << 20
#: Bytes of queries, and of what was found for them, that a task of a kNN join holds.
QUERY_BYTES = 4 << 20


@contextmanager
def _dropped_shuffles(spark):
    """Plans that are made and run in here delete their shuffle files when they end, not when the driver happens to
    collect its garbage: what they give is stored."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if kept is None else spark.conf.set(key, kept)


def _packed(df: DataFrame, vector: str, id_col: str) -> tuple:
    """(a stored table (block, ids, m) with a row a block, about one in each partition; its bytes; the components' type).
    Each row is in it once. Null vectors and ids take no part."""
    kind = "float" if df.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    dtype = np.float32 if kind == "float" else np.float64
    d = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v")).where("v is not null and id is not null")
    with _dropped_shuffles(df.sparkSession):
        n, dims = d.agg(F.count("*"), F.max(F.size("v"))).first()

    def pack(batches):
        first, made, held, rows = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            ids = np.concatenate([b.column("id").to_numpy() for b in held])
            m = np.concatenate([_matrix(b.column("v")).astype(dtype) for b in held])
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([ids.tobytes()]), pa.array([m.tobytes()])], names=["block", "ids", "m"])

        for b in batches:
            while b.num_rows:
                take = b.slice(0, BLOCK_ROWS - rows)
                held.append(take)
                rows, b = rows + take.num_rows, b.slice(take.num_rows)
                if rows == BLOCK_ROWS:
                    yield block()
                    held, rows, made = [], 0, made + 1
        if held:
            yield block()

    # Half a block is left over at most: dealing rows out evenly makes parts that differ by a few rows.
    parts = max(1, -(-n // max(1, BLOCK_ROWS * 31 // 32)))
    with _dropped_shuffles(df.sparkSession):
        stored = cut(d.repartition(parts).mapInArrow(pack, "block bigint, ids binary, m binary"))
    return stored, n * (dims or 1) * np.dtype(dtype).itemsize, dtype


def _met(batches, kinds: tuple):
    """(block, ids, vectors) of both sides, of each pair of blocks."""
    for b in batches:
        for i in range(b.num_rows):
            out = []
            for side, kind in zip("ab", kinds, strict=True):
                ids = np.frombuffer(b.column(f"ids_{side}")[i].as_buffer(), np.int64)
                m = np.frombuffer(b.column(f"m_{side}")[i].as_buffer(), kind)
                out += [b.column(f"block_{side}")[i].as_py(), ids, m.reshape(len(ids), len(m) // len(ids))]
            yield tuple(out)


def _block_pairs(left: tuple, right: tuple, run, schema: str, once: bool = False, held: int | None = None, streams: int | None = None) -> DataFrame:
    """``run`` (an iterator as of :func:`_met`, which gives record batches) on each block of the left side against the
    blocks of a part of the right one; with ``once``, of one side with itself, on each two blocks once. Tasks read the
    stored blocks: nothing is shuffled, and neither side is ever whole in one place. ``held``: the number of parts of
    the right side, which tasks hold; ``streams``: that of the left one, if not each block is one."""
    (a, _, kind_a), (b, size, kind_b) = left, right
    a = a if streams is None else a.coalesce(max(1, streams))
    a, b = a.toDF("block_a", "ids_a", "m_a"), b.coalesce(held or max(1, -(-size // SIDE_BYTES))).toDF("block_b", "ids_b", "m_b")
    met = a.hint("shuffle_replicate_nl").join(b, F.col("block_a") <= F.col("block_b")) if once else a.hint("shuffle_replicate_nl").crossJoin(b)
    return met.mapInArrow(lambda batches: run(_met(batches, (kind_a, kind_b))), schema)


def _within(metric: str, q: np.ndarray, x: np.ndarray, threshold: float):
    """(row of q, row of x, distance) of pairs nearer than the threshold, tile by tile: matrix products leave those that
    rounding can't rule out, which are then measured one by one."""
    if metric == "cosine":
        unit = lambda v: v / np.where((n := np.sqrt(np.einsum("ij,ij->i", v, v))) == 0, 1, n)[:, None]
        u, w = (unit(v.astype(float)).astype(np.float32) for v in (q, x))
    elif not _single(metric, q, x):
        q, x = q.astype(float, copy=False), x.astype(float, copy=False)
    step, size = max(1, MATRIX // max(1, len(x))), max(1, MATRIX // max(1, q.shape[1]))
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        if metric == "cosine":
            least = 1 - threshold - 16 * (q.shape[1] + 8) * float(np.finfo(np.float32).eps)
            r, c = kernels.places(u[lo : lo + step] @ w.T >= np.float32(least))
        else:
            s, slack = _rough(metric, part, x)
            most = (max(threshold, 0.0) ** 2 if metric == "l2" else threshold) + slack
            r, c = kernels.places(s <= np.nextafter(s.dtype.type(most), s.dtype.type(np.inf)))
        for i in range(0, len(r), size):
            a, b = r[i : i + size], c[i : i + size]
            d = _exactly(metric, part[a], x[b])
            ok = d < threshold
            yield a[ok] + lo, b[ok], d[ok]


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, vector: str = "embedding", id_col: str = "vec_id", metric: str = "cosine") -> DataFrame:
    """(a, b, distance) of pairs nearer than the threshold, a < b, exact.

    Blocks of rows meet where they are stored, so neither side is ever whole in one place; of one table with itself, each
    two blocks meet once.
    """
    once = left is right

    def pairs(met):
        for at, ids, x, other, more, y in met:
            for r, c, d in _within(metric, x, y, threshold):
                a, b = ids[r], more[c]
                if once:
                    ok = (a != b) & ((r < c) if at == other else True)
                    a, b, d = np.minimum(a, b)[ok], np.maximum(a, b)[ok], d[ok]
                else:
                    a, b, d = a[a < b], b[a < b], d[a < b]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "distance"])

    side = _packed(left, vector, id_col)
    return _block_pairs(side, side if once else _packed(right, vector, id_col), pairs, "a bigint, b bigint, distance double", once)


def pairwise_total(df: DataFrame, metric: str = "l2", vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(total, n): the sum of the distances of all pairs, and their number. Blocks are summed where they meet, each two
    once; no pair is a row."""

    def totals(met):
        for at, ids, x, other, more, y in met:
            total, n = 0.0, 0
            x, y, common = x.astype(float), y.astype(float), bool(len(np.intersect1d(ids, more)))
            step = max(1, MATRIX // max(1, len(y)))
            for lo in range(0, len(x), step):
                d = kernels.distances(x[lo : lo + step], y) if metric == "l2" else _distances(metric, x[lo : lo + step], y)
                if common:
                    ok = ids[lo : lo + step, None] != more[None, :]
                    d = d[np.triu(ok, lo + 1) if at == other else ok]
                total, n = total + float(d.sum()), n + d.size
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64())], names=["total", "n"])

    side = _packed(df, vector, id_col)
    return _block_pairs(side, side, totals, "total double, n bigint", once=True).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def attention_rerank(candidates: DataFrame, query, k: int, vector: str = "embedding", similarity: str = "similarity", id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """(by..., id, score, rank): each list's best k by 0.6 of their attention weight, a softmax of scaled dot products
    with the query, and 0.4 of their similarity."""
    by = by or []
    dims = F.size(vector)
    c = candidates.withColumn("_s", vectors.dot(F.col(vector), query) / F.sqrt(dims.cast("double")))
    w = W.partitionBy(*by)
    c = c.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    c = c.withColumn("score", 0.6 * F.col("_e") / F.sum("_e").over(w) + 0.4 * F.col(similarity))
    return c.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), id_col))).where(F.col("rank") <= k).select(*by, id_col, "score", "rank")


def model_rerank(candidates: DataFrame, model, columns: list[str], k: int, id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """(by..., id, score, rank): each list's best k by a model, a function of pandas series that gives a score a row."""
    by = by or []
    score = F.pandas_udf(lambda *xs: pd.Series(np.asarray(model(*xs), float)), "double")
    c = candidates.withColumn("score", score(*[F.col(x) for x in columns]))
    w = W.partitionBy(*by).orderBy(F.desc("score"), id_col)
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, id_col, "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): share of a query's exact neighbours that were found."""
    e = exact.groupBy("query_id").agg(F.collect_set("id").alias("want"))
    f = found.groupBy("query_id").agg(F.collect_set("id").alias("got"))
    return e.join(f, "query_id", "left").select("query_id", (F.size(F.array_intersect("want", F.coalesce("got", F.array().cast("array<bigint>")))) / F.size("want")).alias("recall"))


# --- approximate search -------------------------------------------------------------------------------------------


def ivf_build(df: DataFrame, lists: int, vector: str = "embedding", sample: int = 20_000, rounds: int = 12, seed: int = 5) -> tuple[DataFrame, np.ndarray]:
    """(df with ``list_id``, centroids): k-means on a bounded sample, then every row is put to its nearest centroid."""
    s = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").orderBy(F.xxhash64("v")).limit(sample).toPandas()
    x = np.array(s.v.tolist())
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        near = _distances("l2", x, c).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(_distances("l2", np.array(v.tolist(), dtype=float), c).argmin(1).astype(np.int32))

    return df.where(F.col(vector).isNotNull()).withColumn("list_id", nearest(F.col(vector))), c


def ivf_search(index: DataFrame, centroids: np.ndarray, query: list[float], k: int, nprobe: int, vector: str = "embedding", metric: str = "l2", id_col: str = "vec_id") -> DataFrame:
    """Top-k within the nprobe nearest lists; a table partitioned by list_id prunes the rest."""
    near = np.argsort(_distances("l2", np.array([query], float), centroids)[0], kind="stable")[:nprobe]
    return top_k(index.where(F.col("list_id").isin(*[int(i) for i in near])), vector, query, k, metric, id_col)


#: Terms of queries up to this number are broadcast.
BROADCAST_TERMS = 100_000


# --- keyword search -----------------------------------------------------------------------------------------------


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, doc_id: str = "doc_id", query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank). idf = ln((N - df + 0.5) / (df + 0.5) + 1). Query terms count once each. Rows
    of one doc_id are one document; null texts have no terms."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(text.terms(F.col(text_col)))).alias("term"))
    wanted = asked.select("term").distinct()
    small = wanted.count() <= BROADCAST_TERMS
    wanted = F.broadcast(wanted) if small else wanted
    # Words become rows before they are stemmed, so all of it stays in generated code. Of each document, only asked terms
    # are told apart; the others are one sum, made before the shuffle.
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode_outer(text.words(F.col(text_col))).alias("w"))
    kept = words.select("doc_id", F.when(text.is_term(F.col("w")), text.stem(F.col("w"))).alias("term"))
    if not small:
        kept = kept.groupBy("doc_id", "term").agg(F.count("term").alias("n"))
    hits = kept.join(wanted.withColumnRenamed("term", "asked"), F.col("term") == F.col("asked"), "left")
    per = cut(hits.groupBy("doc_id", F.col("asked").alias("term")).agg((F.count("term") if small else F.sum("n")).alias("tf")))
    per = per.withColumn("len", F.sum("tf").over(W.partitionBy("doc_id")))
    stats = per.select("doc_id", "len").distinct().agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = per.where("term is not null")
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    hit = asked.join(df_, "term").join(tf, "term").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hit.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- fusion -------------------------------------------------------------------------------------------------------


def rrf(left: DataFrame, right: DataFrame, weights: tuple[float, float] = (1.0, 1.0), k: int = 60, key=("query_id", "id")) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key..., rank); weights are normalised."""
    total = sum(weights)
    wl, wr = weights[0] / total, weights[1] / total
    a, b = left.select(*key, F.col("rank").alias("rank_l")), right.select(*key, F.col("rank").alias("rank_r"))
    s = F.coalesce(wl / (k + F.col("rank_l")), F.lit(0.0)) + F.coalesce(wr / (k + F.col("rank_r")), F.lit(0.0))
    return a.join(b, list(key), "full").withColumn("score", s)


def normalized(df: DataFrame, score: str, how: str = "minmax", by: str = "query_id") -> DataFrame:
    """The score by min-max (equal: 1.0), by z-score (no spread: 0.0), or as it is."""
    w = W.partitionBy(by)
    c = F.col(score)
    if how == "minmax":
        lo, hi = F.min(score).over(w), F.max(score).over(w)
        c = F.when(hi == lo, 1.0).otherwise((c - lo) / F.nullif(hi - lo, F.lit(0.0)))
    elif how == "zscore":
        m, s = F.avg(score).over(w), F.stddev_pop(score).over(w)
        c = F.when(s == 0, 0.0).otherwise((c - m) / F.nullif(s, F.lit(0.0)))
    return df.withColumn(score, c)


def linear_fusion(left: DataFrame, right: DataFrame, weights: tuple[float, float], key=("query_id", "id"), presence: float = 0.0) -> DataFrame:
    """Weighted sum of two scores; a row in both lists gets ``presence`` on top."""
    a, b = left.select(*key, F.col("score").alias("score_l")), right.select(*key, F.col("score").alias("score_r"))
    s = weights[0] * F.coalesce("score_l", F.lit(0.0)) + weights[1] * F.coalesce("score_r", F.lit(0.0))
    both = F.when(F.col("score_l").isNotNull() & F.col("score_r").isNotNull(), presence).otherwise(0.0)
    return a.join(b, list(key), "full").withColumn("score", s + both)


def keyword_overlap(query: str, body: Column) -> Column:
    """Share of a query's distinct tokens that a text has."""
    want = F.array_distinct(text.tokens(F.lit(query)))
    return F.size(F.array_intersect(want, text.tokens(body))) / F.greatest(F.size(want), F.lit(1))


def hybrid(df: DataFrame, vector: str, query, query_text: str, body: str, k: int, weight: float = 0.7, id_col: str = "vec_id") -> DataFrame:
    """Semantic candidates (3k, 20 at least), scored by similarity and keyword overlap."""
    near = top_k(df, vector, query, max(3 * k, 20), "cosine", id_col)
    s = weight * (1 - F.col("distance")) + (1 - weight) * keyword_overlap(query_text, F.col(body))
    return near.withColumn("score", s).orderBy(F.desc("score"), id_col).limit(k)


# --- re-ranking ---------------------------------------------------------------------------------------------------


def mmr_order(relevance: np.ndarray, v: np.ndarray, lam: float, k: int) -> list[int]:
    """Maximal marginal relevance. All candidates in their order if k isn't below their number; ties keep the earlier."""
    n = len(relevance)
    if k >= n:
        return list(range(n))
    norm = np.linalg.norm(v, axis=1)
    unit = v / np.where(norm == 0, 1, norm)[:, None]
    left, out = list(range(n)), []
    worst = np.zeros(n)
    while left and len(out) < k:
        score = lam * relevance[left] - (1 - lam) * worst[left]
        pick = left[int(np.argmax(score))]
        out.append(pick)
        left.remove(pick)
        sim = unit @ unit[pick]
        worst = np.maximum(worst, sim) if len(out) > 1 else sim
    return out


def mmr(candidates: DataFrame, k: int, lam: float = 0.5, query: str = "query_id", id_col: str = "id", relevance: str = "score", vector: str = "embedding") -> DataFrame:
    """(query_id, id, position) after re-ranking each query's candidates, a bounded list."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, id_col], ascending=[False, True], kind="stable").reset_index(drop=True)
        order = mmr_order(pdf[relevance].to_numpy(float), np.array(pdf[vector].tolist(), float), lam, k)
        return pd.DataFrame({"query_id": pdf[query].iloc[order].to_numpy(), "id": pdf[id_col].iloc[order].to_numpy(), "position": np.arange(1, len(order) + 1)})

    c = candidates.select(F.col(query).cast("bigint").alias(query), F.col(id_col).cast("bigint").alias(id_col), relevance, vector)
    return c.groupBy(query).applyInPandas(run, "query_id bigint, id bigint, position bigint")


def soft_top_k(df: DataFrame, vector: str, query, k: int, temperature: float = 1.0, id_col: str = "vec_id") -> DataFrame:
    """The k most similar rows with softmax weights of similarity over temperature."""
    near = top_k(df, vector, query, k, "cosine", id_col).withColumn("similarity", 1 - F.col("distance"))
    w = W.partitionBy()
    e = F.exp((F.col("similarity") - F.max("similarity").over(w)) / temperature)
    return near.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def conformal_threshold(calibration: DataFrame, score: str, alpha: float) -> float:
    """The (1 - alpha) quantile of non-conformity scores, corrected for their number."""
    n = calibration.count()
    p = min(1.0, np.ceil((n + 1) * (1 - alpha)) / max(n, 1))
    return float(calibration.select(F.percentile(score, F.lit(float(p)))).first()[0])


def conformal_set(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.where(F.col(score) <= threshold)


#: What sends a question to the temporal or the graph search.
TEMPORAL = ["yesterday", "last week", "last month", "today", "this morning", "this afternoon", "hours ago", "minutes ago", "days ago", "between", "before", "after"]
GRAPH = ["related to", "connected to", "linked with", "associated with", "relationship between"]


def route(query: Column) -> Column:
    """What kind of search a question asks for: temporal or graph by the words in it; keyword if it is quoted whole or
    has two words or fewer; else hybrid."""
    q = F.lower(query)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in words])
    return (
        F.when(has(TEMPORAL), "temporal")
        .when(has(GRAPH), "graph")
        .when(F.startswith(query, F.lit('"')) & F.endswith(query, F.lit('"')), "keyword")
        .when(F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) <= 2, "keyword")
        .otherwise("hybrid")
    )


def degenerate(df: DataFrame, distance: str = "distance", least: float = 0.01) -> DataFrame:
    """Whether the distances of a result hardly differ (coefficient of variation under ``least``)."""
    return df.agg(F.coalesce(F.stddev_pop(distance) / F.nullif(F.avg(distance), F.lit(0.0)), F.lit(0.0)).alias("cv")).withColumn("degenerate", F.col("cv") < least)


def associative_recall(patterns: DataFrame, vector: str, query, beta: float = 8.0) -> DataFrame:
    """One row (pos, value) per dimension: the softmax-weighted sum of stored patterns."""
    s = patterns.select(F.col(vector).alias("v"), vectors.dot(F.col(vector), query).alias("s"))
    top = s.agg(F.max("s").alias("m"))
    e = s.crossJoin(F.broadcast(top)).select("v", F.exp(beta * (F.col("s") - F.col("m"))).alias("e"))
    total = e.agg(F.sum("e").alias("z"))
    return e.select("e", F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("e") * F.col("x")).alias("num")).crossJoin(F.broadcast(total)).select("pos", (F.col("num") / F.col("z")).alias("value"))
