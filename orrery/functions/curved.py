"""Hyperbolic, spherical and product-manifold geometry on vectors; curvature c > 0 stands for -c."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bind, dot, fold, l2, l2_squared, norm, vec

EPS = 1e-10


def _sq(a: Column) -> Column:
    return fold(F.transform(a, lambda x: x.cast("double") * x))


def poincare_distance(a, b, curvature: float = 1.0) -> Column:
    a, b = vec(a), vec(b)
    c = abs(curvature)
    inside = (1 - c * _sq(a)) * (1 - c * _sq(b))
    return F.acosh(F.greatest(F.lit(1.0), 1 + 2 * c * l2_squared(a, b) / F.greatest(inside, F.lit(EPS)))) / c**0.5


def mobius_add(a, b, curvature: float = 1.0) -> Column:
    a, b = vec(a), vec(b)
    c = abs(curvature)

    def scale(s: Column) -> Column:
        ab, aa, bb = s["ab"], s["aa"], s["bb"]
        down = F.greatest(1 + 2 * c * ab + c * c * aa * bb, F.lit(EPS))
        x, y = (1 + 2 * c * ab + c * bb) / down, (1 - c * aa) / down
        return bind(F.struct(x.alias("x"), y.alias("y")), lambda k: F.zip_with(a, b, lambda p, q: p * k["x"] + q * k["y"]))

    return bind(F.struct(dot(a, b).alias("ab"), _sq(a).alias("aa"), _sq(b).alias("bb")), scale)


def exp_map(base, tangent, curvature: float = 1.0) -> Column:
    base = vec(base)
    c = abs(curvature)

    def step(t: Column) -> Column:
        lam = 2 / F.greatest(1 - c * _sq(base), F.lit(EPS))
        k = bind(norm(t), lambda n: F.tanh(c**0.5 * lam * n / 2) / (c**0.5 * F.greatest(n, F.lit(EPS))))
        moved = bind(k, lambda k: bind(F.transform(t, lambda x: x * k), lambda s: mobius_add(base, s, c)))
        return F.when(norm(t) < EPS, F.transform(base, lambda x: x.cast("double"))).otherwise(moved)

    return bind(vec(tangent), step)


def log_map(base, target, curvature: float = 1.0) -> Column:
    base, target = vec(base), vec(target)
    c = abs(curvature)

    def step(diff: Column) -> Column:
        lam = 2 / F.greatest(1 - c * _sq(base), F.lit(EPS))
        k = bind(norm(diff), lambda n: 2 / (c**0.5 * lam) * F.atanh(F.least(c**0.5 * n, F.lit(1 - 1e-7))) / F.greatest(n, F.lit(EPS)))
        return bind(k, lambda k: F.transform(diff, lambda x: x * k))

    return bind(F.transform(base, lambda x: -x.cast("double")), lambda back: bind(mobius_add(back, target, c), step))


def project_to_ball(a, curvature: float = 1.0, margin: float = 1e-5) -> Column:
    """Scale a point back into the ball if it lies outside."""
    a = vec(a)
    most = (1 - margin) / abs(curvature) ** 0.5
    n = norm(a)
    return F.when(n > most, F.transform(a, lambda x: x * most / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def minkowski_dot(a, b) -> Column:
    """-a0*b0 + the dot product of the rest."""
    a, b = vec(a), vec(b)
    return dot(a, b) - 2 * F.element_at(a, 1).cast("double") * F.element_at(b, 1)


def lorentz_distance(a, b, curvature: float = 1.0) -> Column:
    c = abs(curvature)
    return F.acosh(F.greatest(F.lit(1.0), -c * minkowski_dot(a, b))) / c**0.5


def poincare_to_lorentz(a, curvature: float = 1.0) -> Column:
    a = vec(a)
    c = abs(curvature)
    down = F.greatest(1 - c * _sq(a), F.lit(EPS))
    return F.concat(F.array((1 + c * _sq(a)) / down / c**0.5), F.transform(a, lambda x: 2 * x / down))


def lorentz_to_poincare(a, curvature: float = 1.0) -> Column:
    a = vec(a)
    c = abs(curvature)
    return F.transform(F.slice(a, 2, F.size(a) - 1), lambda x: x / (1 + c**0.5 * F.element_at(a, 1)))


def spherical_distance(a, b) -> Column:
    """Angle between two vectors; 0 if one is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(na * nb, F.lit(0.0))))))


def product_distance(a, b, euclidean: int, hyperbolic: int, spherical: int) -> Column:
    """Root of the summed squares of the distances in each part."""
    a, b = vec(a), vec(b)
    parts, at = [], 1
    for n, f in ((euclidean, l2), (hyperbolic, poincare_distance), (spherical, spherical_distance)):
        if n:
            d = f(F.slice(a, at, n), F.slice(b, at, n))
            parts.append(d * d)
        at += n
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.sqrt(total)
