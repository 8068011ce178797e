"""Numerical kernels on small matrices and point clouds, for pandas UDFs and ``applyInPandas``."""

from __future__ import annotations

import heapq
import itertools

import numpy as np


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def log_sum_exp(x: np.ndarray) -> float:
    m = float(np.max(x))
    return m + float(np.log(np.exp(np.asarray(x) - m).sum()))


# --- attention ----------------------------------------------------------------------------------------------------


def attention(q, k, v, mask: np.ndarray | None = None) -> np.ndarray:
    """softmax(q k' / sqrt(d)) v; a tiled evaluation gives the same numbers."""
    s = q @ k.T / np.sqrt(q.shape[-1])
    return softmax(np.where(mask, s, -1e30) if mask is not None else s) @ v


def multi_head(q, k, v, heads: int) -> np.ndarray:
    return np.concatenate([attention(a, b, c) for a, b, c in zip(*(np.split(x, heads, axis=-1) for x in (q, k, v)), strict=True)], axis=-1)


def tiled(q, k, v, tile: int = 64, rows: int = 1024) -> np.ndarray:
    """Attention by tiles of keys with a running maximum, for so many queries at a time, in bounded memory."""
    return np.concatenate([_tiled(q[lo : lo + rows], k, v, tile) for lo in range(0, max(1, len(q)), rows)])


def _tiled(q, k, v, tile: int) -> np.ndarray:
    m = np.full(len(q), -np.inf)
    z, out = np.zeros(len(q)), np.zeros((len(q), v.shape[1]))
    for i in range(0, len(k), tile):
        s = q @ k[i : i + tile].T / np.sqrt(q.shape[1])
        new = np.maximum(m, s.max(1))
        p, old = np.exp(s - new[:, None]), np.exp(m - new)
        z, out, m = z * old + p.sum(1), out * old[:, None] + p @ v[i : i + tile], new
    return out / z[:, None]


def linear_attention(q, k, v) -> np.ndarray:
    """Feature map elu + 1: no row of the score matrix is ever formed."""
    f = lambda x: np.where(x > 0, x + 1, np.exp(np.minimum(x, 0)))
    a, b = f(q), f(k)
    return (a @ (b.T @ v)) / np.maximum(a @ b.sum(0), 1e-12)[:, None]


def sliding(q, k, v, window: int) -> np.ndarray:
    i = np.arange(len(q))[:, None] - np.arange(len(k))[None, :]
    return attention(q, k, v, np.abs(i) <= window)


def sparse_attention(q, k, v, keep: int) -> np.ndarray:
    """Each query attends to its ``keep`` best keys."""
    s = q @ k.T
    cut = np.sort(s, axis=1)[:, -min(keep, s.shape[1])][:, None]
    return attention(q, k, v, s >= cut)


def cross_attention(q, context) -> np.ndarray:
    return attention(q, context, context)


def graph_attention(x, adjacency, a_self, a_near, slope: float = 0.2) -> np.ndarray:
    """GAT: leaky scores of pairs that are adjacent (self included)."""
    s = (x @ a_self)[:, None] + (x @ a_near)[None, :]
    s = np.where(s > 0, s, slope * s)
    return softmax(np.where((adjacency > 0) | np.eye(len(x), dtype=bool), s, -1e30)) @ x


def mixture(q, k, v, gates: np.ndarray, top: int = 2) -> np.ndarray:
    """Experts are plain, linear and sliding attention; each query mixes its ``top`` gates."""
    outs = np.stack([attention(q, k, v), linear_attention(q, k, v), sliding(q, k, v, 2)])
    g = q @ gates
    g = np.where(g >= np.sort(g, axis=1)[:, -min(top, g.shape[1])][:, None], g, -1e30)
    return np.einsum("qe,eqd->qd", softmax(g), outs)


def poincare_attention(q, k, v) -> np.ndarray:
    """Scores are negated hyperbolic distances."""
    n = lambda x: np.clip((x**2).sum(-1), 0, 1 - 1e-6)
    d2 = ((q[:, None] - k[None]) ** 2).sum(-1)
    return softmax(-np.arccosh(1 + 2 * d2 / ((1 - n(q))[:, None] * (1 - n(k))[None]))) @ v


# --- spectral -----------------------------------------------------------------------------------------------------


def laplacian(adj: np.ndarray) -> np.ndarray:
    d = adj.sum(1)
    s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    return np.eye(len(adj)) - s[:, None] * adj * s[None, :]


def k_means(x: np.ndarray, k: int, rounds: int = 50, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    while len(c) < k:
        d = np.min([((x - y) ** 2).sum(1) for y in c], axis=0)
        c.append(x[int(np.argmax(d))])
    c = np.array(c)
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
    return near


def spectral_cluster(adj: np.ndarray, k: int) -> np.ndarray:
    _, v = np.linalg.eigh(laplacian(adj))
    u = v[:, :k]
    return k_means(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), k)


#: Up to so many points, a matrix of all pairs is made.
DENSE = 512


def spectral_points(x: np.ndarray, k: int) -> np.ndarray:
    """spectral_cluster of points whose affinity is exp(-distance). No matrix of all pairs is kept: the first
    eigenvectors come from block Krylov spaces, and each product with the matrix measures the pairs again, tile by tile."""
    if len(x) <= DENSE:
        return spectral_cluster(np.exp(-distances(x, x)), k)
    s = 1 / np.sqrt(_affinity(x, np.ones((len(x), 1)))[:, 0])
    u = _top_vectors(lambda v: s[:, None] * _affinity(x, s[:, None] * v), 1 / s, k)
    return k_means(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), k)


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``np.nonzero`` gives of a matrix, faster: it searches flat masks by whole words."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs by a matrix product; those of near pairs, which cancel there, directly."""
    nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    d = x @ y.T
    d *= -2
    d += nx[:, None]
    d += ny[None, :]
    i, j = places(~(d > 1e-4 * (nx.max(initial=0.0) + ny.max(initial=0.0))))
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    step = max(1, (1 << 21) // max(1, x.shape[1]))
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        d[a, b] = np.sqrt(((x[a] - y[b]) ** 2).sum(1))
    return d


def _affinity(x: np.ndarray, v: np.ndarray, tile: int = 1024) -> np.ndarray:
    """The matrix exp(-distance) of all pairs times v; a tile serves both of its sides."""
    out = np.zeros_like(v)
    for i in range(0, len(x), tile):
        for j in range(i, len(x), tile):
            a = distances(x[i : i + tile], x[j : j + tile])
            np.exp(np.negative(a, out=a), out=a)
            out[i : i + tile] += a @ v[j : j + tile]
            if j > i:
                out[j : j + tile] += a.T @ v[i : i + tile]
    return out


def _top_vectors(times, first: np.ndarray, k: int, block: int = 16, most: int = 320, tol: float = 1e-12) -> np.ndarray:
    """Eigenvectors of a symmetric matrix's k largest eigenvalues, by block Lanczos steps with full orthogonalization,
    until their residuals are under ``tol``. A basis of ``most`` columns is replaced by its best half."""
    start = np.random.default_rng(42).normal(size=(len(first), block))
    start[:, 0] = first
    new = np.linalg.qr(start)[0]
    basis, t = np.zeros((len(first), 0)), np.zeros((0, 0))
    while True:
        w = times(new)
        n, basis = basis.shape[1], np.hstack([basis, new])
        h = basis.T @ w
        w = w - basis @ h
        w -= basis @ (basis.T @ w)
        t = np.block([[t, h[:n]], [h[:n].T, (h[n:] + h[n:].T) / 2]])
        values, y = np.linalg.eigh(t)
        u, size, z = np.linalg.svd(w, full_matrices=False)
        left = np.linalg.norm((size[:, None] * z) @ y[n:, -k:])
        u = u[:, size > 1e-13]
        if left < tol or not u.shape[1]:
            return basis @ y[:, : -k - 1 : -1]
        new = np.linalg.qr(u - basis @ (basis.T @ u))[0]
        if basis.shape[1] >= most:
            basis, t = basis @ y[:, -most // 2 :], np.diag(values[-most // 2 :])


def chebyshev_filter(adj: np.ndarray, signal: np.ndarray, response, degree: int = 10) -> np.ndarray:
    """A polynomial filter of the Laplacian's spectrum (0 to 2) applied to a signal."""
    n = degree + 1
    theta = (np.arange(n) + 0.5) * np.pi / n
    c = np.array([2 / n * (response(np.cos(theta) + 1) * np.cos(j * theta)).sum() for j in range(n)])
    m = laplacian(adj) - np.eye(len(adj))
    a, b = signal, m @ signal
    out = c[0] / 2 * a + (c[1] * b if degree else 0)
    for j in range(2, n):
        a, b = b, 2 * m @ b - a
        out = out + c[j] * b
    return out


RESPONSES = {"low_pass": lambda x: np.exp(-2 * x), "high_pass": lambda x: 1 - np.exp(-2 * x), "band_pass": lambda x: np.exp(-4 * (x - 1) ** 2)}


def diffusion(adj: np.ndarray, signal: np.ndarray, time: float = 1.0, degree: int = 10) -> np.ndarray:
    return chebyshev_filter(adj, signal, lambda x: np.exp(-time * x), degree)


# --- cuts and solvers ---------------------------------------------------------------------------------------------


def min_cut(n: int, edges: list[tuple[int, int, float]]) -> tuple[float, list[int]]:
    """The value of a smallest cut and one side of it, exact. Nodes that a smaller cut than the least degree so far can't
    part are put together: of heavy edges (Padberg and Rinaldi), else of edges that one scan in maximum-adjacency order
    proves as connected (Nagamochi, Ono and Ibaraki). On sparse graphs few scans are left of Stoer and Wagner's n."""
    near: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    for a, b, c in edges:
        if a != b and c:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    groups = {i: [i] for i in range(n)}
    best: tuple[float, list[int]] = (np.inf, [])
    while len(near) > 1:
        degree = {i: sum(v.values()) for i, v in near.items()}
        i = min(degree, key=lambda i: (degree[i], len(groups[i]), i))
        if degree[i] < best[0]:
            best = (degree[i], sorted(groups[i]))
        if best[0] <= 0:
            break
        pairs = _heavy(near, degree)
        if 8 * len(pairs) < len(near):
            pairs, part = _connected(near, best[0])
            if part:  # what the scan reached is not connected with the rest
                best = (0.0, sorted(x for i in part for x in groups[i]))
                break
        near, groups = _together(near, groups, pairs)
    return best


def _heavy(near: dict, degree: dict) -> list[tuple[int, int]]:
    """Edges with half the degree of an end or more, no node twice: but for the cut around that end alone, some smallest
    cut doesn't part them."""
    out, used = [], set()
    for i, v in near.items():
        if i not in used:
            for j, c in v.items():
                if j not in used and 2 * c >= min(degree[i], degree[j]):
                    out.append((i, j))
                    used |= {i, j}
                    break
    return out


def _connected(near: dict, bound: float) -> tuple[list[tuple[int, int]], list[int]]:
    """(pairs that no cut under the bound parts, the nodes reached if they aren't all): a scan in maximum-adjacency order;
    the last node is always in a pair, if no degree is under the bound."""
    todo, seen, reach, out = [(0.0, min(near))], set(), dict.fromkeys(near, 0.0), []
    while todo:
        _, i = heapq.heappop(todo)
        if i in seen:
            continue
        seen.add(i)
        for j, c in near[i].items():
            if j not in seen:
                reach[j] += c
                if reach[j] >= bound:
                    out.append((i, j))
                heapq.heappush(todo, (-reach[j], j))
    return out, sorted(seen) if len(seen) < len(near) else []


def _together(near: dict, groups: dict, pairs: list[tuple[int, int]]) -> tuple[dict, dict]:
    """The graph with the nodes of each pair made one, which has the smaller number."""
    root = {i: i for i in near}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    merged, members = {}, {}
    for i, v in near.items():
        r = find(i)
        members.setdefault(r, []).extend(groups[i])
        row = merged.setdefault(r, {})
        for j, c in v.items():
            if (s := find(j)) != r:
                row[s] = row.get(s, 0.0) + c
    return merged, members


def conjugate_gradient(a: np.ndarray, b: np.ndarray, tol: float = 1e-10, rounds: int = 1000) -> np.ndarray:
    x, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), r @ r
    for _ in range(rounds):
        if np.sqrt(rr) < tol:
            break
        ap = a @ p
        step = rr / (p @ ap)
        x, r = x + step * p, r - step * ap
        new = r @ r
        p, rr = r + new / rr * p, new
    return x


def effective_resistance(adj: np.ndarray, i: int, j: int) -> float:
    e = np.zeros(len(adj))
    e[i], e[j] = 1, -1
    return float(e @ np.linalg.pinv(np.diag(adj.sum(1)) - adj) @ e)


def matrix_profile(a: np.ndarray) -> dict[str, float]:
    """Shape facts of a matrix: size, non-zeros, symmetry, diagonal dominance."""
    d = np.abs(np.diag(a))
    return {"n": len(a), "nnz": int((a != 0).sum()), "symmetric": bool(np.allclose(a, a.T)), "dominant": bool((d >= np.abs(a).sum(1) - d).all())}


# --- topology -----------------------------------------------------------------------------------------------------


def rips(points: np.ndarray, max_dim: int = 1, max_radius: float = np.inf) -> list[tuple[float, tuple[int, ...]]]:
    """Simplices of the Vietoris-Rips filtration with their values, in filtration order."""
    d = np.linalg.norm(points[:, None] - points[None], axis=-1)
    out = [(0.0, (i,)) for i in range(len(points))]
    for k in range(2, max_dim + 3):
        for s in itertools.combinations(range(len(points)), k):
            r = max(d[a, b] for a, b in itertools.combinations(s, 2))
            if r <= max_radius:
                out.append((float(r), s))
    return sorted(out, key=lambda x: (x[0], len(x[1]), x[1]))


def _merges(points: np.ndarray) -> np.ndarray:
    """The edge lengths of a least spanning tree, by Prim's method: one row of distances at a time."""
    rest, out = points[1:], []
    best = np.full(len(rest), np.inf)
    live = np.ones(len(rest), bool)
    at = points[:1]
    for _ in range(len(rest)):
        d = np.linalg.norm(rest - at, axis=-1)
        np.fmin(best, d, out=best, where=live)
        best[~live] = np.inf
        # Of those left, the nearest; where all that is left is infinitely far or not a number, any.
        i = int(np.argmin(best))
        i = i if live[i] else int(np.argmax(live))
        out.append(best[i])
        live[i], at = False, rest[i : i + 1]
        if 2 * live.sum() < len(live):
            rest, best, live = rest[live], best[live], np.ones(int(live.sum()), bool)
    return np.array(out)


def persistence(points: np.ndarray, max_dim: int = 1, max_radius: float = np.inf) -> list[tuple[int, float, float]]:
    """(dimension, birth, death) by reduction of the boundary matrix; pairs of equal birth and death are left out. Of
    dimension 0 alone, from a least spanning tree, without listing pairs."""
    if max_dim == 0:
        w = _merges(points) if len(points) else np.zeros(0)
        dead = w[w <= max_radius]
        return [(0, 0.0, float(x)) for x in np.sort(dead[dead > 0])] + [(0, 0.0, float("inf"))] * (len(points) - len(dead))
    simplices = rips(points, max_dim, max_radius)
    index = {s: i for i, (_, s) in enumerate(simplices)}
    low: dict[int, int] = {}
    columns: dict[int, set[int]] = {}
    out, paired = [], set()
    for j, (value, s) in enumerate(simplices):
        col = {index[f] for f in itertools.combinations(s, len(s) - 1)} if len(s) > 1 else set()
        while col and max(col) in low:
            col ^= columns[low[max(col)]]
        if col:
            i = max(col)
            low[i], columns[j] = j, col
            paired |= {i, j}
            birth = simplices[i][0]
            if value > birth:
                out.append((len(s) - 2, birth, value))
    out += [(len(s) - 1, v, float("inf")) for i, (v, s) in enumerate(simplices) if i not in paired and len(s) - 1 <= max_dim]
    return sorted(out)


def betti(points: np.ndarray, radius: float, max_dim: int = 1) -> list[int]:
    p = persistence(points, max_dim, radius)
    return [sum(1 for k, b, d in p if k == dim and b <= radius < d) for dim in range(max_dim + 1)]


def bottleneck(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Bottleneck distance of two small diagrams, by search over candidate values."""
    half = lambda p: (p[1] - p[0]) / 2
    cost = lambda p, q: max(abs(p[0] - q[0]), abs(p[1] - q[1]))
    values = sorted({0.0, *map(half, a), *map(half, b), *(cost(p, q) for p in a for q in b)})

    def fits(eps: float) -> bool:
        match: dict[int, int] = {}

        def seek(i: int, seen: set[int]) -> bool:
            for j, q in enumerate(b):
                if j not in seen and cost(a[i], q) <= eps:
                    seen.add(j)
                    if j not in match or seek(match[j], seen):
                        match[j] = i
                        return True
            return False

        must_a = [i for i, p in enumerate(a) if half(p) > eps]
        if not all(seek(i, set()) for i in must_a):
            return False
        return all(j in match or half(q) <= eps or any(half(p) <= eps and cost(p, q) <= eps for p in a) for j, q in enumerate(b))

    return next((v for v in values if fits(v)), float("inf"))


def low_rank(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x + B (A x): a learned low-rank update of an embedding."""
    return x + (x @ a.T) @ b.T


def align_domains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Source vectors shifted and scaled to the target's mean and spread, dimension by dimension."""
    s, t = source.std(0), target.std(0)
    return (source - source.mean(0)) / np.where(s == 0, 1, s) * t + target.mean(0)
