"""Valuers: what a column is compared with or set to. Each is called with the column; None drops the predicate."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.model import Col, Expr, Resolver

Valuer = Callable[[Expr, Resolver], Column | None]
Condition = Callable[[Resolver], Column | None]

__all__ = [
    "and_", "as_value", "between", "des", "ends", "eq", "eq_col", "gt", "gte", "in_", "in_seq", "incr", "is_not_null", "is_null", "left_like", "like",
    "lt", "lte", "neq", "neq_col", "not_between", "not_in", "not_in_seq", "not_like", "on", "or_", "raw", "right_like", "value", "xor",
]


def _binary(f: Callable[[Column, Any], Column]) -> Callable[[Any], Valuer]:
    return lambda v: lambda c, at: f(c.resolve(at), v.resolve(at) if isinstance(v, Expr) else F.lit(v))


eq = eq_col = _binary(lambda c, v: c == v)
neq = neq_col = _binary(lambda c, v: c != v)
gt = _binary(lambda c, v: c > v)
gte = _binary(lambda c, v: c >= v)
lt = _binary(lambda c, v: c < v)
lte = _binary(lambda c, v: c <= v)
value = as_value = _binary(lambda c, v: v)
incr = _binary(lambda c, v: c + v)
des = _binary(lambda c, v: c - v)


def in_(*values: Any) -> Valuer:
    """No values: no predicate."""
    return lambda c, at: c.resolve(at).isin(list(values)) if values else None


def not_in(*values: Any) -> Valuer:
    return lambda c, at: ~c.resolve(at).isin(list(values)) if values else None


def in_seq(values: Iterable[Any]) -> Valuer:
    """No values: nothing matches."""
    found = list(values)
    return lambda c, at: c.resolve(at).isin(found) if found else F.lit(False)


def not_in_seq(values: Iterable[Any]) -> Valuer:
    found = list(values)
    return lambda c, at: ~c.resolve(at).isin(found) if found else F.lit(True)


def is_null() -> Valuer:
    return lambda c, at: c.resolve(at).isNull()


def is_not_null() -> Valuer:
    return lambda c, at: c.resolve(at).isNotNull()


def between(a: Any, b: Any) -> Valuer:
    return lambda c, at: c.resolve(at).between(a, b)


def not_between(a: Any, b: Any) -> Valuer:
    return lambda c, at: ~c.resolve(at).between(a, b)


def _pattern(before: str, after: str, keep: bool = True) -> Callable[[str], Valuer]:
    """% and _ in the text are wildcards; a backslash is itself."""

    def make(text: str) -> Valuer:
        p = before + text.replace("\\", "\\\\") + after
        return lambda c, at: c.resolve(at).like(p) if keep else ~c.resolve(at).like(p)

    return make


like = _pattern("%", "%")
not_like = _pattern("%", "%", False)
left_like = ends = _pattern("%", "")
right_like = _pattern("", "%")


def on(col: Col, valuer: Valuer) -> Condition:
    return lambda at: valuer(col, at)


def raw(expr: Expr) -> Condition:
    return expr.resolve


def _all(f: Callable[[Column, Column], Column]) -> Callable[..., Condition]:
    def combine(*conditions: Condition | None) -> Condition:
        def resolve(at: Resolver) -> Column | None:
            parts = [p for p in (c(at) for c in conditions if c is not None) if p is not None]
            return reduce(f, parts) if parts else None

        return resolve

    return combine


and_ = _all(lambda a, b: a & b)
or_ = _all(lambda a, b: a | b)
xor = _all(lambda a, b: a != b)
