"""Filter trees over columns or JSON payloads, compiled to one Column predicate.

A tree is nested tuples: ``("eq", field, value)``, ``("and", [trees])``, ``("not", tree)`` and so on. Leaves are two-valued:
a missing field makes every leaf false but ``ne``, which is true; so ``not`` is plain negation. In strict mode a value of
another type than the field's doesn't match, instead of being cast.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import matches_token

_KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def payload(column: str, field: str, kind: str) -> Column:
    """A typed field of a JSON text column; null if missing or of another type."""
    return F.try_variant_get(F.try_parse_json(F.col(column)), "$." + field, kind)


def json_fields(column: str) -> Callable[[str, Any], Column]:
    """How leaves read fields of a JSON payload: by the type of the value they compare with."""
    return lambda field, value: payload(column, field, _KINDS.get(type(value), "string"))


def columns(df: DataFrame, strict: bool = False) -> Callable[[str, Any], Column]:
    """How leaves read plain columns. Strict: another type than the value's never matches."""
    kinds = dict(df.dtypes)
    ints, floats = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}

    def get(field: str, value: Any) -> Column:
        if field not in kinds:
            return F.lit(None)
        k = kinds[field]
        ok = not strict or value is None or (isinstance(value, bool) and k == "boolean") or (isinstance(value, int) and not isinstance(value, bool) and k in ints) or (isinstance(value, float) and k in floats) or (isinstance(value, str) and k == "string")
        return F.col(field) if ok else F.lit(None)

    return get


def build(tree: tuple, get: Callable[[str, Any], Column]) -> Column:
    """The predicate of a tree; never null."""
    op, *args = tree
    yes = lambda c: F.coalesce(c, F.lit(False))
    if op in ("and", "or"):
        parts = [build(t, get) for t in args[0]]
        out = F.lit(op == "and")
        for p in parts:
            out = (out & p) if op == "and" else (out | p)
        return out
    if op == "not":
        return ~build(args[0], get)
    field = args[0]
    if op == "exists":
        return get(field, None).isNotNull()
    if op == "is_null":
        return get(field, None).isNull()
    value = args[1]
    if op == "ne":
        return F.coalesce(get(field, value) != F.lit(value), F.lit(True))
    if op == "in":
        return yes(get(field, value[0]).isin(*value)) if value else F.lit(False)
    if op == "text":
        return yes(matches_token(get(field, ""), value))
    if op == "range":  # inclusive, either bound may be None
        return _range(get, field, value, args[2], yes, upper_in=True)
    if op == "range_open":  # the upper bound is outside
        return _range(get, field, value, args[2], yes, upper_in=False)
    if op == "geo_radius":
        lat0, lon0, metres = value
        return yes(geo.within_radius(get(field + ".lat", 0.0), get(field + ".lon", 0.0), lat0, lon0, metres))
    if op == "geo_box":
        return yes(geo.within_box(get(field + ".lat", 0.0), get(field + ".lon", 0.0), *value))
    c = get(field, value)
    ops = {
        "eq": lambda: c == F.lit(value), "lt": lambda: c < F.lit(value), "lte": lambda: c <= F.lit(value), "gt": lambda: c > F.lit(value), "gte": lambda: c >= F.lit(value),
        "like": lambda: c.like(value), "contains": lambda: c.contains(value), "starts_with": lambda: c.startswith(value), "ends_with": lambda: c.endswith(value), "regex": lambda: c.rlike(value),
    }
    if op not in ops:
        raise ValueError(f"unknown filter: {op}")
    return yes(ops[op]())


def _range(get, field, low, high, yes, upper_in: bool) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & yes(get(field, low) >= F.lit(low))
    if high is not None:
        out = out & yes(get(field, high) <= F.lit(high) if upper_in else get(field, high) < F.lit(high))
    return out


def fields(tree: tuple) -> set[str]:
    """All fields a tree reads."""
    op, *args = tree
    if op in ("and", "or"):
        return set().union(*[fields(t) for t in args[0]])
    return fields(args[0]) if op == "not" else {args[0]}


def where(df: DataFrame, tree: tuple, json_column: str | None = None, strict: bool = False) -> DataFrame:
    return df.where(build(tree, json_fields(json_column) if json_column else columns(df, strict)))


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on a list of members."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't on a list of members."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def tenant_view(df: DataFrame, tenant: Any, column: str = "tenant_id") -> DataFrame:
    """The rows of one tenant."""
    return df.where(F.col(column) == F.lit(tenant))
