"""The filter language: ``or(where("name",eq("x")),where("id",in(1,2)))``, with JSON literals; a bare literal is eq."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column

from millrace import functions as f
from millrace.errors import BadQuery
from millrace.model import Expr, Model
from millrace.operators import FILTER, Operator, operator, or_where, where

#: The names of the language.
COMPARE = {"eq": f.eq, "neq": f.neq, "gt": f.gt, "gte": f.gte, "lt": f.lt, "lte": f.lte, "contains": f.like, "notcontains": f.not_like, "prefix": f.right_like, "suffix": f.left_like}
MEMBER = {"in": f.in_, "notin": f.not_in}
COMBINE = ("and", "or", "intersection")


@dataclass(frozen=True)
class Rule:
    op: str
    args: tuple = ()

    def __str__(self) -> str:
        return f"{self.op}({','.join(str(a) if isinstance(a, Rule) else json.dumps(a, ensure_ascii=False, separators=(',', ':')) for a in self.args)})"

    @property
    def filters(self) -> list[Rule]:
        return [a for a in self.args if isinstance(a, Rule)]

    @property
    def values(self) -> list[Any]:
        return [a for a in self.args if not isinstance(a, Rule)]

    @property
    def is_zero(self) -> bool:
        return not self.args


def _make(op: str) -> Callable[..., Rule]:
    return lambda *args: Rule(op, args)


eq, neq, gt, gte, lt, lte, contains, not_contains, prefix, suffix, in_, not_in, and_, or_, intersection = map(_make, ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "notcontains", "prefix", "suffix", "in", "notin", "and", "or", "intersection"))


def where_(name: str, *rules: Rule) -> Rule:
    return Rule("where", (name, *rules))


def tokens(text: str) -> Iterator[tuple[str, Any]]:
    """("start", name), ("end", None) and ("value", literal)."""
    i, decoder = 0, json.JSONDecoder()
    while i < len(text):
        c = text[i]
        if c in " \t\r\n,":
            i += 1
        elif c == ")":
            yield "end", None
            i += 1
        else:
            j = i
            while j < len(text) and (text[j].isalnum() or text[j] == "_"):
                j += 1
            if j > i and j < len(text) and text[j] == "(":
                yield "start", text[i:j]
                i = j + 1
                continue
            try:
                value, i = decoder.raw_decode(text, i)
            except ValueError as e:
                raise BadQuery(f"neither a call nor a literal at {i} of {text!r}") from e
            yield "value", value


def parse(text: str) -> Rule:
    stack: list[tuple[str, list]] = [("", [])]
    for kind, v in tokens(text):
        if kind == "start":
            if v not in COMPARE and v not in MEMBER and v not in COMBINE and v != "where":
                raise BadQuery(f"unknown operation {v}")
            stack.append((v, []))
        elif kind == "end":
            if len(stack) == 1:
                raise BadQuery(f"one ) too many in {text!r}")
            op, args = stack.pop()
            stack[-1][1].append(Rule(op, tuple(args)))
        else:
            stack[-1][1].append(v)
    if len(stack) != 1 or len(stack[0][1]) != 1:
        raise BadQuery(f"not one filter: {text!r}")
    found = stack[0][1][0]
    return found if isinstance(found, Rule) else Rule("eq", (found,))


def condition(rule: Rule, col: Expr) -> Callable:
    """The rule on a column; what says nothing (no values, no parts) is dropped. intersection is and."""
    if rule.op in COMBINE:
        parts = [condition(r, col) for r in rule.filters]
        return f.or_(*parts) if rule.op == "or" else f.and_(*parts)
    if rule.op == "where":
        return f.and_(*[condition(r, col) for r in rule.filters])
    if not rule.values:
        return lambda at: None
    valuer = MEMBER[rule.op](*rule.values) if rule.op in MEMBER else COMPARE[rule.op](rule.values[0])
    return f.on(col, valuer)


def as_where(col: Expr, rule: Rule | str) -> Operator:
    rule = parse(rule) if isinstance(rule, str) else rule
    made = condition(rule, col)
    return operator(FILTER, lambda b: b.with_(where=(*b.where, ("and", made))))


@dataclass
class Composed:
    """Named fields, and rules on them that any may satisfy."""

    fields: dict[str, Expr]
    rules: list[Rule]

    def __str__(self) -> str:
        return "" if not self.rules else str(self.rules[0]) if len(self.rules) == 1 else str(Rule("or", tuple(self.rules)))

    def operator(self) -> Operator:
        parts = [_named(r, self.fields) for r in self.rules]
        made = f.or_(*parts)
        return operator(FILTER, lambda b: b.with_(where=(*b.where, ("and", made))) if parts else b)


def _named(rule: Rule, fields: dict[str, Expr]) -> Callable:
    if rule.op in COMBINE:
        parts = [_named(r, fields) for r in rule.filters]
        return f.or_(*parts) if rule.op == "or" else f.and_(*parts)
    if rule.op != "where" or not rule.args or rule.args[0] not in fields:
        raise BadQuery(f"unsupported ql field `{rule.args[0] if rule.args else rule.op}`")
    return condition(rule, fields[rule.args[0]])


def compose(fields: dict[str, Expr], text: str | None = None, **rules: Rule) -> Composed:
    """From text, or from rules by field (those without arguments are left out)."""
    if text:
        top = parse(text)
        found = list(top.filters) if top.op == "or" else [top]
        for r in found:
            _named(r, fields)
        return Composed(fields, found)
    return Composed(fields, [where_(n, r) for n, r in rules.items() if not r.is_zero])


def map_filter(args: Iterable[Any], make: Callable[[Rule], Any]) -> list[Any]:
    """What ``make`` gives for each filter among the arguments, None left out."""
    return [x for x in (make(a) for a in args if isinstance(a, Rule)) if x is not None]


def in_seq(values: Iterable[Any]) -> Rule:
    return Rule("in", tuple(values))


def not_in_seq(values: Iterable[Any]) -> Rule:
    return Rule("notin", tuple(values))


def lit(value: Any) -> Rule:
    """A literal for itself: equal to it."""
    return Rule("eq", (value,))


def first(rules: Iterable[Rule], test: Callable[[Rule], bool]) -> Rule | None:
    return next((r for r in rules if test(r)), None)


def map_where(rules: Iterable[Rule], make: Callable[[Rule], Any]) -> list[Any]:
    return [x for x in map(make, rules) if x is not None]


def indexed_filters(model: Model, domain: str) -> dict[str, Callable[[Rule | str], Operator]]:
    """An operator for each column of a key, under ``domain~field``."""
    names = dict.fromkeys(c for k in model.keys for c in k.columns)
    return {f"{domain}~{model[n].field[:1].lower()}{model[n].field[1:]}": (lambda rule, n=n: as_where(model[n], rule)) for n in names}


def any_of(*operators: tuple[Expr, Callable]) -> Operator:
    """Typed predicates joined by OR."""
    return reduce(lambda a, b: operator(FILTER, lambda blk: b(a(blk))), [or_where(c, v) if i else where(c, v) for i, (c, v) in enumerate(operators)])


def resolve(rule: Rule | str, column: Column) -> Column | None:
    """The rule on a plain Spark column."""

    class Given(Expr):
        def resolve(self, at):
            return column

    return condition(parse(rule) if isinstance(rule, str) else rule, Given())(lambda c: column)
