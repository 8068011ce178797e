"""Aggregates over vectors, metrics, histograms and weighted quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors


def vector_aggregate(df: DataFrame, by: list[str], vector: str, how: str = "mean", weight: str | None = None) -> DataFrame:
    """(by..., vector): element-wise sum, mean, max, min or weighted mean over a group. Partial sums are made before
    the shuffle: what travels is a row a group and position."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = df.where(F.col(vector).isNotNull()).select(*by, w.cast("double").alias("_w"), F.posexplode(vector).alias("_pos", "_x"))
    x = F.col("_x").cast("double")
    agg = {"sum": F.sum(x), "mean": F.avg(x), "max": F.max(x), "min": F.min(x), "weighted": F.sum(x * F.col("_w")) / F.sum("_w")}[how]
    flat = e.groupBy(*by, "_pos").agg(agg.alias("_y"))
    out = flat.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_pos", "_y"))).alias("_p"))
    return out.select(*by, F.transform("_p", lambda s: s["_y"]).alias("vector"))


def distance_stats(df: DataFrame, distance: str = "distance") -> DataFrame:
    return df.agg(F.min(distance).alias("min"), F.max(distance).alias("max"), F.avg(distance).alias("mean"), F.stddev_samp(distance).alias("std"), F.count("*").alias("n"))


def latency_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    p = lambda q: F.percentile(value, F.lit(q))
    return df.groupBy(*by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def histogram(df: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """(bucket, n, mean): bucket 0 lies under low, buckets + 1 at or above high."""
    return df.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float) -> DataFrame:
    """(by..., quantile): the first value whose cumulative weight reaches the share q."""
    w = W.partitionBy(*by)
    c = df.withColumn("_c", F.sum(weight).over(w.orderBy(value).rangeBetween(W.unboundedPreceding, 0)) / F.sum(weight).over(w))
    return c.where(F.col("_c") >= q).groupBy(*by).agg(F.min(value).alias("quantile"))


def consistency(df: DataFrame, vector: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean cosine similarity of consecutive vectors."""
    w = W.partitionBy(*(by or [])).orderBy(*order)
    d = df.withColumn("_next", F.lead(vector).over(w)).where("_next is not null")
    s = vectors.cosine_similarity(F.col(vector), F.col("_next"))
    return d.groupBy(*(by or [])).agg(F.avg(s).alias("consistency"))


def contradiction_rate(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Share of pairs whose dot product is negative."""
    return pairs.agg(F.avg((vectors.dot(F.col(a), F.col(b)) < 0).cast("double")).alias("rate"))


def distinct_estimate(df: DataFrame, column: str, error: float = 0.05) -> DataFrame:
    return df.agg(F.approx_count_distinct(column, error).alias("n"))


def group_evidence(df: DataFrame, node: str, confidence: str) -> DataFrame:
    """Steps a node and the best confidence, most confident first."""
    return df.groupBy(node).agg(F.count("*").alias("n"), F.max(confidence).alias("confidence")).orderBy(F.desc("confidence"), F.desc("n"), node)


def tier_bits(accesses: Column, last: Column, now: Column, hot: int = 512, warm: int = 64, warm_bits: int = 7) -> Column:
    """Bits to keep a value with, by accesses * 1024 / (now - last + 1), a whole number: 8 if it is hot, ``warm_bits`` if
    it is warm, else 3."""
    heat = F.floor(accesses.cast("bigint") * 1024 / (now - last + 1))
    return F.when(heat >= hot, 8).when(heat >= warm, warm_bits).otherwise(3)


def weighted_cdf(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, cdf): the share of the weight at or below each value. Equal values are summed before they meet."""
    by = by or []
    s = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    w = W.partitionBy(*by)
    run = F.sum("_w").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return s.select(*by, value, (run / F.sum("_w").over(w)).alias("cdf"))


def argsort(df: DataFrame, value: str, id_col: str, by: list[str] | None = None) -> DataFrame:
    """(by..., position, id): the order of the values from 0, equal ones by id."""
    w = W.partitionBy(*(by or [])).orderBy(value, id_col)
    return df.select(*(by or []), (F.row_number().over(w) - 1).alias("position"), id_col)


def bitmap(df: DataFrame, position: str, by: list[str] | None = None) -> DataFrame:
    """(by..., bucket, bits): positions from 0 on as bitmaps of 32,768 bits, partly made before the shuffle."""
    p = F.col(position).cast("bigint") + 1
    bit = F.bitmap_bit_position(p)
    return df.where(p.isNotNull()).groupBy(*(by or []), F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def bitmap_positions(bitmaps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., position) of the bits that are set."""
    byte = F.conv(F.hex(F.substring("bits", F.col("_i") + 1, F.lit(1))), 16, 10).cast("int")
    at = bitmaps.select(*(by or []), "bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("_i")).withColumn("_b", byte).where("_b > 0")
    each = at.select(*(by or []), "bucket", "_i", "_b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_k")).where("getbit(_b, _k) = 1")
    return each.select(*(by or []), ((F.col("bucket") - 1) * 32768 + F.col("_i") * 8 + F.col("_k")).alias("position"))


def bitmap_combine(left: DataFrame, right: DataFrame, how: str, by: list[str] | None = None) -> DataFrame:
    """(by..., position) of positions that are in both bitmaps (and), in one at least (or), or in just one (xor)."""
    sides = bitmap_positions(left, by).withColumn("_s", F.lit(1)).unionByName(bitmap_positions(right, by).withColumn("_s", F.lit(2)))
    n = sides.groupBy(*(by or []), "position").agg(F.bit_or("_s").alias("_s"))
    return n.where({"and": "_s = 3", "or": "true", "xor": "_s < 3"}[how]).drop("_s")
