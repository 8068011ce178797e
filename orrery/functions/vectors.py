"""Distances and arithmetic on dense vectors (arrays of numbers), as Column expressions.

All folds run in double precision. Vectors of different lengths raise by default; ``policy`` may be ``"zero"`` (the
result is 0.0) or ``"truncate"`` (the shorter length counts). Smaller is always nearer: the inner-product distance
is the negated dot product. A null vector gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(v: Column | str | Sequence[float]) -> Column:
    """A vector column, or a literal vector."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    # One literal array: thousands of literals would be thousands of expressions.
    return F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in v) + "]"), "array<double>")


def fold(v: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it: lambdas don't share what they repeat."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _paired(a, b, f: Callable[[Column, Column], Column], reduce: Callable[[Column], Column], policy: str) -> Column:
    a, b = vec(a), vec(b)
    pairs = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    same = F.size(a) == F.size(b)
    if policy == "zero":
        return F.when(same & (F.size(a) > 0), reduce(pairs)).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))
    if policy == "truncate":
        n = F.least(F.size(a), F.size(b))
        return reduce(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: f(x.cast("double"), y.cast("double"))))
    return F.when(F.coalesce(~same, F.lit(False)), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(reduce(pairs))


def dot(a, b, policy: str = "raise") -> Column:
    return _paired(a, b, lambda x, y: x * y, fold, policy)


def l2_squared(a, b, policy: str = "raise") -> Column:
    return _paired(a, b, lambda x, y: (x - y) * (x - y), fold, policy)


def l2(a, b, policy: str = "raise") -> Column:
    return F.sqrt(l2_squared(a, b, policy))


def inner_product(a, b, policy: str = "raise") -> Column:
    """Negated dot product, so that ascending order is best first."""
    return -dot(a, b, policy)


def norm(a) -> Column:
    return F.sqrt(fold(F.transform(vec(a), lambda x: x.cast("double") * x)))


def cosine(a, b, policy: str = "raise", epsilon: float = 0.0) -> Column:
    """Cosine distance; 1.0 if a norm isn't above ``epsilon``."""
    na, nb = norm(a), norm(b)
    return F.when((na <= epsilon) | (nb <= epsilon), F.lit(0.0 if policy == "zero" else 1.0)).otherwise(1 - dot(a, b, policy) / (na * nb))


def cosine_similarity(a, b, policy: str = "raise") -> Column:
    return 1 - cosine(a, b, policy)


def cosine_normalized(a, b, policy: str = "raise") -> Column:
    """Cosine distance of vectors known to have norm 1."""
    return 1 - dot(a, b, policy)


def manhattan(a, b, policy: str = "raise") -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y), fold, policy)


def chebyshev(a, b, policy: str = "raise") -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y), lambda v: F.coalesce(F.array_max(v), F.lit(0.0)), policy)


def minkowski(a, b, p: float, policy: str = "raise") -> Column:
    if p == 1:
        return manhattan(a, b, policy)
    if p == 2:
        return l2(a, b, policy)
    if p == float("inf"):
        return chebyshev(a, b, policy)
    return F.pow(_paired(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))), fold, policy), F.lit(1.0 / p))


def canberra(a, b, policy: str = "raise") -> Column:
    """Terms of 0/0 count as 0."""
    return _paired(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, 0.0).otherwise(F.abs(x - y) / F.nullif(F.abs(x) + F.abs(y), F.lit(0.0))), fold, policy)


def bray_curtis(a, b, policy: str = "raise") -> Column:
    up = manhattan(a, b, policy)
    down = _paired(a, b, lambda x, y: F.abs(x) + F.abs(y), fold, policy)
    return F.when(down == 0, 0.0).otherwise(up / F.nullif(down, F.lit(0.0)))


def hamming_sign(a, b, policy: str = "raise") -> Column:
    """Number of components whose signs differ."""
    return _paired(a, b, lambda x, y: F.when((x < 0) != (y < 0), 1.0).otherwise(0.0), fold, policy).cast("int")


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def jaccard_words(a: Column, b: Column) -> Column:
    """Jaccard distance of bit sets in arrays of 64-bit words; two empty sets: 0."""
    count = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0), lambda acc, x: acc + x)
    both = count(lambda x, y: F.bit_count(x.bitwiseAND(y)))
    either = count(lambda x, y: F.bit_count(x.bitwiseOR(y)))
    return F.when(either == 0, 0.0).otherwise(1 - both / F.nullif(either, F.lit(0)))


def normalize(a) -> Column:
    """Scaled to norm 1; a zero vector stays."""
    a = vec(a)
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / F.nullif(n, F.lit(0.0))))


def add(a, b) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x.cast("double") + y)


def subtract(a, b) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x.cast("double") - y)


def scale(a, by: float) -> Column:
    return F.transform(vec(a), lambda x: x.cast("double") * by)


def k_winners(a, k: int) -> Column:
    """1.0 for the k largest components (ties: earlier ones), 0.0 elsewhere."""
    a = vec(a)
    order = F.array_sort(F.transform(a, lambda x, i: F.struct((-x.cast("double")).alias("v"), i.alias("i"))))
    top = F.transform(F.slice(order, 1, k), lambda s: s["i"])
    return F.transform(a, lambda x, i: F.when(F.array_contains(top, i), 1.0).otherwise(0.0))


def softmax(a) -> Column:
    a = vec(a)
    e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a).cast("double")))
    return F.transform(e, lambda x: x / fold(e))


DISTANCES: dict[str, Callable[..., Column]] = {
    "l2": l2, "l2_squared": l2_squared, "cosine": cosine, "ip": inner_product, "l1": manhattan,
    "chebyshev": chebyshev, "canberra": canberra, "bray_curtis": bray_curtis, "hamming_sign": hamming_sign,
}
#: The infix forms of the SQL dialect.
OPERATORS = {"<->": l2, "<=>": cosine, "<#>": inner_product, "<+>": manhattan}


# --- bit hypervectors ---------------------------------------------------------------------------------------------


def hv_bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def hv_invert(a: Column) -> Column:
    return F.transform(a, F.bitwise_not)


def hv_permute(a: Column, by: int) -> Column:
    """Rotate the words by a number of places."""
    n = F.size(a)
    k = F.pmod(F.lit(by), n)
    return F.concat(F.slice(a, n - k + 1, k), F.slice(a, 1, n - k))


def hv_similarity(a: Column, b: Column) -> Column:
    """1 - 2 * share of differing bits."""
    return 1 - 2 * hamming_words(a, b) / (F.size(a) * 64)


def hv_bundle(vectors: list[Column]) -> Column:
    """Bitwise majority of hypervectors; where as many bits are set as not, the first one's bit counts."""
    n = len(vectors)
    size = F.size(vectors[0])

    def word(at: Column) -> Column:
        w = [F.element_at(v, at) for v in vectors]
        out = F.lit(0).cast("bigint")
        for bit in range(64):
            one = [F.shiftrightunsigned(w[i], bit).bitwiseAND(F.lit(1)) for i in range(n)]
            total = one[0]
            for x in one[1:]:
                total = total + x
            on = (2 * total > n) | ((2 * total == n) & (one[0] == 1))
            out = out.bitwiseOR(F.when(on, F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint")))
        return out

    return F.transform(F.sequence(F.lit(1), size), word)
