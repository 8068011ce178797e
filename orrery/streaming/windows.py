"""Event-time windows. On a stream, ``watermark`` bounds how late a row may be; a batch ignores it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    return df.withWatermark(ts, watermark) if df.isStreaming else df


def _flat(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *names)


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], aggs: list[Column], watermark: str) -> DataFrame:
    out = _marked(df, ts, watermark).groupBy(F.window(ts, size), *by).agg(*aggs)
    return _flat(out, out.columns[1:])


def sliding(df: DataFrame, ts: str, size: str, slide: str, by: list[str], aggs: list[Column], watermark: str) -> DataFrame:
    out = _marked(df, ts, watermark).groupBy(F.window(ts, size, slide), *by).agg(*aggs)
    return _flat(out, out.columns[1:])


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], aggs: list[Column], watermark: str) -> DataFrame:
    out = _marked(df, ts, watermark).groupBy(F.session_window(ts, gap).alias("window"), *by).agg(*aggs)
    return _flat(out, out.columns[1:])


def delta_windows(df: DataFrame, ts: str, size: str, key: str, watermark: str) -> DataFrame:
    """Summed vector deltas (key, delta array of struct(idx, dv)) a window, by position."""
    e = _marked(df, ts, watermark).select(ts, key, F.explode("delta").alias("d"))
    out = e.groupBy(F.window(ts, size), key, F.col("d.idx").alias("idx")).agg(F.sum("d.dv").alias("dv"))
    return _flat(out, [key, "idx", "dv"])


def dedup(df: DataFrame, key: list[str], ts: str, watermark: str) -> DataFrame:
    """Each key once within the watermark."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(key) if df.isStreaming else df.dropDuplicates(key)


def drift(df: DataFrame, value: str, order: list[str], baseline: int, by: list[str]) -> DataFrame:
    """z-score of each value against the mean and spread of the ``baseline`` rows before it."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-baseline, -1)
    m, s = F.avg(value).over(w), F.stddev_pop(value).over(w)
    return df.withColumn("z", F.when(s > 0, (F.col(value) - m) / F.nullif(s, F.lit(0.0))))


def latest(df: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in columns])


def correlation(df: DataFrame, ts: str, size: str, series: str, value: str) -> DataFrame:
    """(a, b, correlation) of pairs of series, on window means."""
    m = df.groupBy(F.window(ts, size)["start"].alias("t"), series).agg(F.avg(value).alias("v"))
    x, y = m.select("t", F.col(series).alias("a"), F.col("v").alias("x")), m.select("t", F.col(series).alias("b"), F.col("v").alias("y"))
    return x.join(y, "t").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("correlation"))


def every(query_df: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "5 seconds"):
    """Call back with each micro-batch; restarts resume at the checkpoint."""
    return query_df.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def trend_buckets(df: DataFrame, ts: str, size: str, value: str) -> DataFrame:
    """(start, n, average, best) of each bucket of time."""
    w = F.window(ts, size)
    return df.groupBy(w).agg(F.count("*").alias("n"), F.avg(value).alias("average"), F.max(value).alias("best")).select(F.col("window.start").alias("start"), "n", "average", "best")


def regime_change(df: DataFrame, value: str, order: list[str], recent: int, baseline: int, by: list[str]) -> DataFrame:
    """Rows with ``change``, the probability that the level shifted: how far the mean of the last ``recent`` rows is from
    that of the ``baseline`` rows before them, in standard errors of the two, as a two-sided normal probability."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy(*order)
    now, past = w.rowsBetween(-(recent - 1), 0), w.rowsBetween(-(recent + baseline - 1), -recent)
    error = F.sqrt(F.var_pop(value).over(now) / F.count(value).over(now) + F.var_pop(value).over(past) / F.nullif(F.count(value).over(past), F.lit(0)))
    z = F.abs(F.avg(value).over(now) - F.avg(value).over(past)) / F.nullif(error, F.lit(0.0))
    # 1 - erfc(z / sqrt 2), by the logistic curve next to the normal one.
    return df.withColumn("change", F.coalesce(2 / (1 + F.exp(-1.702 * z)) - 1, F.lit(0.0)))


def metrics(query) -> list[dict]:
    """Of each recent micro-batch of a running query: rows, rows a second taken in and processed, and milliseconds; it falls
    behind where more comes in than is processed."""
    out = []
    for p in query.recentProgress:
        taken, done = p["inputRowsPerSecond"] or 0.0, p["processedRowsPerSecond"] or 0.0
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "input_rate": taken, "rate": done, "ms": p["durationMs"].get("triggerExecution", 0), "behind": taken > done > 0})
    return out
