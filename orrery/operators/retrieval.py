"""Retrieval over graphs whose nodes have vectors: similar nodes, context, reasoning paths, prompts; membership filters;
numbers of lists to probe."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import aggregates, search
from .graph import Graph

#: Least similarity of a match, and least relevance of a context document.
LEAST_SIMILARITY, LEAST_RELEVANCE = 0.7, 0.7


def similar(items: DataFrame, query, k: int, least: float = LEAST_SIMILARITY, vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """(id, score): the k nearest nodes or edges by cosine, of those the ones at least so similar."""
    near = search.top_k(items, vector, query, k, "cosine", id_col)
    return near.select(id_col, (1 - F.col("distance")).alias("score")).where(F.col("score") >= least)


def context(items: DataFrame, query, k: int, relevance: float = LEAST_RELEVANCE, text: str = "text", vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """(id, content, score, tokens) of the documents to answer from; a token is taken as four characters."""
    found = similar(items, query, k, relevance, vector, id_col).join(items.select(id_col, F.col(text).alias("content")), id_col)
    return found.select(id_col, "content", "score", F.ceil(F.length("content") / 4).alias("tokens"))


def prompt(found: DataFrame, question: str, id_col: str = "id") -> DataFrame:
    """One row: the question behind its context, most relevant documents first. The context is a bounded list."""
    line = F.concat(F.lit("["), F.col(id_col).cast("string"), F.lit("] "), F.coalesce("content", F.lit("")))
    lines = found.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i"), line.alias("l")))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["l"]), "\n")
    return lines.select(F.concat(F.lit("Context:\n"), body, F.lit("\n\nQuestion: " + question)).alias("prompt"))


def reasoning_paths(graph: Graph, scores: DataFrame, start, hops: int, k: int) -> DataFrame:
    """(path, score): the best k walks from a node, by the mean score (id, score) of their nodes; unknown nodes score 0."""
    walks = graph.walks(graph.node(start).select("id"), 1, hops).select("path").distinct()
    each = walks.select("path", F.explode("path").alias("id")).join(scores, "id", "left")
    mean = each.groupBy("path").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    return mean.orderBy(F.desc(F.round("score", 12)), "path").limit(k)


# --- membership filters -------------------------------------------------------------------------------------------


def _places(value: Column, bits: int, hashes: int) -> Column:
    """Places of a value: two hashes, stepped."""
    a, b = F.pmod(F.xxhash64(value), F.lit(bits)), F.pmod(F.xxhash64(value, F.lit(1)), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)))


def filter_size(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter for so many values and such a rate of false positives."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def bloom(df: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(bucket, bits): a Bloom filter as bitmaps, made by partial aggregation. More values mean more rows, not longer ones."""
    return aggregates.bitmap(df.select(F.explode(_places(F.col(column), bits, hashes)).alias("at")), "at")


def counting_bloom(df: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(at, n): how many values have each place; filters of other rows are added or taken off by place."""
    return df.select(F.explode(_places(F.col(column), bits, hashes)).alias("at")).groupBy("at").agg(F.count("*").alias("n"))


def maybe_in(df: DataFrame, column: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Rows whose value the filter may hold: none that it holds is left out."""
    asked = df.select(column).distinct().select(column, F.explode(_places(F.col(column), bits, hashes)).alias("position"))
    held = aggregates.bitmap_positions(filter_)
    hit = asked.join(held.withColumn("held", F.lit(1)), "position", "left")
    good = hit.groupBy(column).agg(F.min(F.col("held").isNotNull()).alias("ok")).where("ok")
    return df.join(good.select(column), column, "left_semi")


def filter_count(filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(n): how many values a Bloom filter holds, estimated from its set bits."""
    full = F.least(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("double"), F.lit(bits - 1.0))
    return filter_.agg((-F.lit(bits / hashes) * F.log(1 - full / bits)).alias("n"))


# --- lists to probe -----------------------------------------------------------------------------------------------


def adaptive_probes(probes: int, centroid_distances: np.ndarray, least: float = 0.05) -> int:
    """More lists where the nearest centroids hardly differ in distance: the root of their number, at most four times."""
    near = np.sort(np.asarray(centroid_distances, float))[:probes]
    spread = near.std() / near.mean() if len(near) > 1 and near.mean() > 0 else math.inf
    return max(probes, min(math.ceil(math.sqrt(len(centroid_distances))), 4 * probes)) if spread < least else probes


def drift_probes(probes: int, drift: int, most: int) -> int:
    """More lists for centroids that are out of date: none more up to half of ``most`` epochs, then linearly, then twice."""
    if not most or drift <= most // 2:
        return probes
    return math.ceil(probes * (1 + (drift - most // 2) / most)) if drift <= most else 2 * probes


def ivf_write(df: DataFrame, path: str, lists: int, vector: str = "embedding") -> np.ndarray:
    """Store an inverted-file index by list, so that a search reads only the lists that it probes; gives the centroids."""
    index, centroids = search.ivf_build(df, lists, vector)
    index.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)
    return centroids


def threshold_rows(df: DataFrame, vector: str, query, least: float) -> DataFrame:
    """Rows whose cosine similarity reaches a limit."""
    return df.withColumn("similarity", vectors.cosine_similarity(F.col(vector), query)).where(F.col("similarity") >= least)
