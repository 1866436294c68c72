"""Aggregates, and any Spark function by its name."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.model import Expr, Resolver


@dataclass(frozen=True)
class Call(Expr):
    function: str
    args: tuple = ()
    order: Expr | None = None

    def resolve(self, at: Resolver) -> Column:
        args = [a.resolve(at) if isinstance(a, Expr) else F.lit(a) for a in self.args]
        if self.function == "count" and self.args and isinstance(self.args[0], Call) and self.args[0].function == "distinct":
            return F.count_distinct(*[a.resolve(at) if isinstance(a, Expr) else F.lit(a) for a in self.args[0].args])
        if self.function == "distinct":
            return args[0]
        if self.function == "any_value":
            return F.any_value(args[0], ignoreNulls=F.lit(True))
        if self.order is not None:
            return {"first": F.min_by, "last": F.max_by}[self.function](args[0], self.order.resolve(at))
        return F.call_function(self.function, *(args or [F.lit(1)] if self.function == "count" else args))


def func(name: str, *args: Any) -> Call | None:
    return Call(name.lower(), args) if name else None


def count(*args: Any) -> Call:
    return Call("count", args)


def _one(name: str):
    return lambda x: Call(name, (x,))


avg, sum_, min_, max_, any_value = map(_one, ("avg", "sum", "min", "max", "any_value"))


def distinct(*args: Any) -> Call:
    return Call("distinct", args)


def first(x: Any, order: Expr | None = None) -> Call:
    """With an order, the value of the row that comes first in it: the same in every run."""
    return Call("first", (x,), order)


def last(x: Any, order: Expr | None = None) -> Call:
    return Call("last", (x,), order)
