"""Exact top-k inner products by block-at-a-time pruning.

Vectors are cut into document-range blocks; a block is a forward index (a matrix of its vectors) with the maxima and
minima of each dimension, the "term". A query's bound for a block is the sum over dimensions of what the block could
give at most. A task takes a group of blocks and a block of queries: each query goes through the blocks in falling
order of bounds, scores whole blocks, and stops when the next bound is below its k-th best. Tasks' best rows meet in a
last ranking by query.

A pair of (group of blocks, block of queries) is the unit of work, so neither side is ever gathered in one place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pick, tune

#: Vectors in a block, in a group of blocks, and queries that meet a group at a time.
BLOCK, GROUP, QUERIES = 256, 16_384, 8_192
#: Sums of products under this are exact in double precision.
EXACT = 2.0**53


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null, or hold null or a non-finite, go."""
    d = pick(vectors, "vec_id", "embedding", types={"vec_id": "bigint", "embedding": "array<double>"})
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad)
    return d.where(ok).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"))


class _Index:
    """A group's vectors as blocks."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        # Like vectors side by side, so that maxima are tight: by the signs of the dimensions that vary most.
        lead = np.argsort(-m.var(axis=0), kind="stable")[:16]
        code = (m[:, lead] > np.median(m[:, lead], axis=0)) @ (1 << np.arange(len(lead))[::-1])
        order = np.lexsort((ids, code))
        self.ids, self.m = ids[order], m[order]
        self.cuts = list(range(0, len(ids), BLOCK))
        self.high = np.array([self.m[c : c + BLOCK].max(axis=0) for c in self.cuts])
        self.low = np.array([self.m[c : c + BLOCK].min(axis=0) for c in self.cuts])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of each query's best k; missing ones have id -1."""
        n = len(q)
        low = np.iinfo(np.int64).min
        best, who = np.full((n, k), low), np.full((n, k), -1, np.int64)
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(n)
        for r in range(len(self.cuts)):
            block = order[live, r]
            # Equal bounds go on: a tie may bring a smaller id.
            go = bound[live, block] >= best[live, -1]
            live, block = live[go], block[go]
            if not len(live):
                break
            for b in np.unique(block):
                qs = live[block == b]
                c = self.cuts[b]
                ids = self.ids[c : c + BLOCK]
                score = (q[qs] @ self.m[c : c + BLOCK].T).astype(np.int64)
                score[ids[None, :] == q_ids[qs][:, None]] = low
                all_s = np.concatenate([best[qs], score], axis=1)
                all_i = np.concatenate([who[qs], np.broadcast_to(ids, score.shape)], axis=1)
                top = np.lexsort((all_i, -all_s.astype(np.float64) if np.abs(score[score > low]).max(initial=0) < EXACT else -all_s), axis=1)[:, :k]
                best[qs], who[qs] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
        who[best == low] = -1
        return who, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        empty = pa.table({n: pa.array([], pa.int64()) for n in names})
        if not left.num_rows or not right.num_rows:
            return empty
        out = []
        sizes = lambda t: np.array([len(x) for x in t.column("v")])
        for dims in set(sizes(left).tolist()):
            own = left.filter(pa.array(sizes(left) == dims)).combine_chunks()
            ask = right.filter(pa.array(sizes(right) == dims)).combine_chunks()
            if not ask.num_rows:
                continue
            m, q = _matrix(own.column("v").combine_chunks(), dims), _matrix(ask.column("v").combine_chunks(), dims)
            if dims * float(np.abs(m).max()) * float(np.abs(q).max()) < EXACT:
                m, q = m.astype(np.float64), q.astype(np.float64)
            who, best = _Index(own.column("vec_id").to_numpy(), m).search(ask.column("vec_id").to_numpy(), q, k)
            at, pos = np.nonzero(who >= 0) if (own.column("vec_id").to_numpy() >= 0).all() else np.nonzero(best > np.iinfo(np.int64).min)
            out.append(pa.table({"query_id": ask.column("vec_id").to_numpy()[at], "vec_id": who[at, pos], "score": best[at, pos]}))
        return pa.concat_tables(out) if out else empty

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the highest integer inner product, for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but those with the query's
    own id. Ties go to smaller ids. Vectors with a null or non-finite component, and rows without id, take no part;
    vectors of other lengths aren't comparable and give no pair. A repeated query row asks once. Fewer than k
    candidates give fewer rows.
    """
    spark = vectors.sparkSession
    tune(spark)
    v, _ = materialize(integer_vectors(vectors, scale), "vectors")
    n, asked = v.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    groups, parts = max(1, -(-n // GROUP)), max(1, -(-asked // QUERIES))
    queries = v.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    spread = lambda c, m: F.pmod(F.xxhash64(c, "v"), F.lit(m)).cast("int")
    left = v.withColumn("g", spread("vec_id", groups)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.withColumn("p", spread("vec_id", parts)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
