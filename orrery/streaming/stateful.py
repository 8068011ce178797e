"""Operators with state of their own: similarity dedup, residual-gated emission, forecasts, change points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class SimilarityWindow:
    """The last ``size`` kept vectors; a vector at least as similar to one of them as the threshold is a duplicate."""

    def __init__(self, size: int, threshold: float, vectors: list[list[float]] | None = None):
        self.size, self.threshold, self.kept = size, threshold, [np.asarray(v) for v in vectors or []]

    def seen(self, v: np.ndarray) -> tuple[bool, float]:
        """Whether it's a duplicate, and the best similarity; a new one is kept."""
        n = np.linalg.norm(v)
        u = v / n if n else v
        best = max((float(u @ k) for k in self.kept), default=-1.0)
        if best >= self.threshold:
            return True, best
        self.kept = [*self.kept, u][-self.size :]
        return False, best


_DEDUP = "key string, id bigint, duplicate boolean, similarity double"


def _dedup_rows(key: str, pdf: pd.DataFrame, w: SimilarityWindow) -> pd.DataFrame:
    pdf = pdf.sort_values(["ts", "id"])
    out = [(key, int(i), *w.seen(np.asarray(v, float))) for i, v in zip(pdf.id, pdf.vector, strict=True)]
    return pd.DataFrame(out, columns=["key", "id", "duplicate", "similarity"])


def similarity_dedup(df: DataFrame, size: int = 100, threshold: float = 0.95) -> DataFrame:
    """(key, id, duplicate, similarity) of rows (key string, id, ts, vector), each against the last ``size`` kept of its
    key. State holds that many vectors a key, on a stream as in a batch."""
    if not df.isStreaming:
        return df.groupBy("key").applyInPandas(lambda k, pdf: _dedup_rows(k[0], pdf, SimilarityWindow(size, threshold)), _DEDUP)

    def step(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = SimilarityWindow(size, threshold, [list(v) for v in state.get[0]] if state.exists else [])
        for pdf in pdfs:
            yield _dedup_rows(k[0], pdf, w)
        state.update(([v.tolist() for v in w.kept],))

    return df.groupBy("key").applyInPandasWithState(step, _DEDUP, "kept array<array<double>>", "append", GroupStateTimeout.NoTimeout)


def _gate_rows(key: str, pdf: pd.DataFrame, state: list, alpha: float, threshold: float) -> pd.DataFrame:
    """Rows whose residual's root mean square is over the threshold; those move the prediction, which begins with zeros."""
    out = []
    for i, value in zip(pdf.id, pdf.value, strict=True):
        v = np.atleast_1d(np.asarray(value, float))
        if state[0] is None:
            state[0] = np.zeros(len(v))
        r = float(np.sqrt(np.mean((v - state[0]) ** 2)))
        if r > threshold:
            out.append((key, int(i), value, r))
            state[0] = (1 - alpha) * state[0] + alpha * v
    return pd.DataFrame(out, columns=["key", "id", "value", "residual"]).astype({"id": "int64", "residual": "float64"})


def residual_gate(df: DataFrame, threshold: float, alpha: float = 0.3) -> DataFrame:
    """Rows (key, id, ts, value) that a running prediction missed by more than the threshold (root mean square over a
    vector's components; a number is a vector of one). Only rows that go through teach the prediction."""
    schema = f"key string, id bigint, value {dict(df.dtypes)['value']}, residual double"
    if not df.isStreaming:
        return df.groupBy("key").applyInPandas(lambda k, pdf: _gate_rows(k[0], pdf.sort_values(["ts", "id"]), [None], alpha, threshold), schema)

    def step(k, pdfs, state: GroupState):
        now = [np.array(state.get[0]) if state.exists else None]
        for pdf in pdfs:
            yield _gate_rows(k[0], pdf.sort_values(["ts", "id"]), now, alpha, threshold)
        if now[0] is not None:
            state.update((now[0].tolist(),))

    return df.groupBy("key").applyInPandasWithState(step, schema, "mean array<double>", "append", GroupStateTimeout.NoTimeout)


def forecast(series: np.ndarray, steps: int, alpha: float = 0.3, beta: float = 0.1) -> np.ndarray:
    """Holt's linear trend, ``steps`` ahead."""
    if not len(series):
        return np.zeros(steps)
    level, trend = float(series[0]), 0.0
    for x in series[1:]:
        last = level
        level = alpha * float(x) + (1 - alpha) * (level + trend)
        trend = beta * (level - last) + (1 - beta) * trend
    return level + trend * np.arange(1, steps + 1)


def cusum(series: np.ndarray, slack: float = 0.5, limit: float = 5.0) -> list[int]:
    """Places where a level shift is found, in units of the series' standard deviation."""
    s = np.asarray(series, float)
    sd = s.std() or 1.0
    z, up, down, out = (s - s.mean()) / sd, 0.0, 0.0, []
    for i, x in enumerate(z):
        up, down = max(0.0, up + x - slack), max(0.0, down - x - slack)
        if max(up, down) > limit:
            out.append(i)
            up = down = 0.0
    return out


def forecasts(df: DataFrame, steps: int, alpha: float = 0.3) -> DataFrame:
    """(key, step, forecast) for rows (key, ts, value), in the order of ts, then value."""

    def run(k, pdf):
        f = forecast(pdf.sort_values(["ts", "value"]).value.to_numpy(), steps, alpha)
        return pd.DataFrame({"key": k[0], "step": np.arange(1, steps + 1), "forecast": f})

    return df.groupBy("key").applyInPandas(run, "key string, step bigint, forecast double")


def change_feed(spark, path: str, schema: str, per_batch: int = 100):
    """A file-backed change stream; the checkpoint of its writer is the consumer's position."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def apply_changes(target_path: str, key: str, columns: list[str]):
    """A foreachBatch function that keeps a table equal to its change log: each batch writes a new version."""
    from ..operators.replication import replay

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = f"{target_path}/v{epoch - 1}"
        p = spark._jvm.org.apache.hadoop.fs.Path(old)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        state = spark.read.parquet(old) if fs.exists(p) else batch.select(key, *columns).limit(0)
        replay(state, batch, key, columns).write.mode("overwrite").parquet(f"{target_path}/v{epoch}")

    return step
