"""Divergences and transport distances between small distributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import fold, vec

FLOOR = 1e-12


def _clamp(x: Column) -> Column:
    return F.greatest(x.cast("double"), F.lit(FLOOR))


def kl(p, q) -> Column:
    """Kullback-Leibler; both sides are clamped to 1e-12 and not normalised again."""
    return fold(F.zip_with(vec(p), vec(q), lambda x, y: _clamp(x) * F.log(_clamp(x) / _clamp(y))))


def jensen_shannon(p, q) -> Column:
    mid = lambda x, y: (_clamp(x) + _clamp(y)) / 2
    return fold(F.zip_with(vec(p), vec(q), lambda x, y: (_clamp(x) * F.log(_clamp(x) / mid(x, y)) + _clamp(y) * F.log(_clamp(y) / mid(x, y))) / 2))


def fisher(p, tangent) -> Column:
    return fold(F.zip_with(vec(p), vec(tangent), lambda x, t: t.cast("double") * t / _clamp(x)))


def wasserstein(a, b, p: int = 1) -> Column:
    """Between samples of equal size: values are sorted and paired."""
    pairs = F.zip_with(F.array_sort(vec(a)), F.array_sort(vec(b)), lambda x, y: F.pow(F.abs(x.cast("double") - y), F.lit(float(p))))
    return F.pow(fold(pairs) / F.size(vec(a)), F.lit(1.0 / p))


# --- kernels for pandas UDFs --------------------------------------------------------------------------------------


def sinkhorn(cost: np.ndarray, a: np.ndarray, b: np.ndarray, reg: float = 0.1, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Regularised transport cost and plan, in log space."""
    a, b = a / a.sum(), b / b.sum()
    m = -cost / reg
    f, g = np.zeros(len(a)), np.zeros(len(b))
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    for _ in range(rounds):
        f = np.log(np.maximum(a, 1e-300)) - lse(m + g[None, :], 1)
        g = np.log(np.maximum(b, 1e-300)) - lse(m + f[:, None], 0)
    plan = np.exp(m + f[:, None] + g[None, :])
    return float((plan * cost).sum()), plan


def sliced_wasserstein(x: np.ndarray, y: np.ndarray, projections: int = 100, seed: int = 42) -> float:
    """Mean 1-D distance over random directions; sizes may differ (quantiles are interpolated)."""
    rng = np.random.default_rng(seed)
    d = rng.normal(size=(projections, x.shape[1]))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    n = max(len(x), len(y))
    q = (np.arange(n) + 0.5) / n
    return float(np.mean([np.abs(np.quantile(x @ v, q) - np.quantile(y @ v, q)).mean() for v in d]))


def gromov_wasserstein(x: np.ndarray, y: np.ndarray, reg: float = 0.05, rounds: int = 30) -> tuple[float, np.ndarray]:
    """Entropic Gromov-Wasserstein between two point clouds with uniform weights."""
    c1, c2 = (np.linalg.norm(z[:, None] - z[None], axis=-1) for z in (x, y))
    p, q = np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y))
    plan = np.outer(p, q)
    const = (c1**2 @ p)[:, None] + (c2**2 @ q)[None, :]
    for _ in range(rounds):
        cost = const - 2 * c1 @ plan @ c2.T
        _, plan = sinkhorn(cost - cost.min(), p, q, max(reg * float(np.abs(cost).max()), 1e-9), 50)
    return float(((const - 2 * c1 @ plan @ c2.T) * plan).sum()), plan
