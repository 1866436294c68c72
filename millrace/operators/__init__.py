"""Pipe operators: each takes a block and returns a changed one. ``kind`` orders them where the executor may reorder."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.model import Catalog, Col, Expr, Model, sql_name
from millrace.plans import Block, Join, compile_block
from millrace.plans.block import subquery
from millrace.sources import as_, from_, from_all  # noqa: F401

COMPOSE, PROJECT, FILTER, SORT, LIMIT, LOCK, ON_CONFLICT, JOIN, COMMIT, SETTING = range(10)
Operator = Callable[[Block], Block]


def operator(kind: int, f: Operator) -> Operator:
    """An operator of one's own."""

    def op(block: Block) -> Block:
        return f(block)

    op.kind = kind
    return op


def compose(*operators: Operator) -> Operator:
    out = operator(COMPOSE, lambda b: b.pipe(*operators))
    out.parts = operators
    return out


# projections


def select(*cols: Expr) -> Operator:
    """The first explicit selection in a pipe holds; no columns change nothing."""
    return operator(PROJECT, lambda b: b if b.projects or not cols else b.with_(projects=tuple(cols)))


cast_select = project = select


def default_project(*cols: Expr) -> Operator:
    """Used only where nothing is selected; the last one holds."""
    return operator(PROJECT, lambda b: b.with_(default_projects=tuple(cols)))


def columns_of(*models: Model) -> list[Expr]:
    """Every column of the models as table__column: a join's default projection."""
    return [c for m in models for c in m.cols()]


def distinct() -> Operator:
    return operator(PROJECT, lambda b: b.with_(distinct=True))


def distinct_on(*cols: Expr) -> Operator:
    """The first row for each value of the columns, in the block's sort order; any row if it has none."""
    return operator(PROJECT, lambda b: b.with_(distinct_on=tuple(cols)))


def returning(*cols: Expr) -> Operator:
    """For a mutation, what its rows give back; for a read, a projection."""
    return operator(PROJECT, lambda b: b.with_(projects=tuple(cols), returning=True))


# filters


def where(col: Expr, valuer: Callable, op: str = "and") -> Operator:
    return operator(FILTER, lambda b: b.with_(where=(*b.where, (op, lambda at: valuer(col, at)))))


def or_where(col: Expr, valuer: Callable) -> Operator:
    return where(col, valuer, "or")


cast_where, cast_or_where = where, or_where


def where_cond(condition: Callable | None, op: str = "and") -> Operator:
    """A condition made of and_(), or_(), xor(), raw(); None changes nothing."""
    return operator(FILTER, lambda b: b if condition is None else b.with_(where=(*b.where, (op, condition))))


def _in_select(col: Col, column: Col, source: Block, word: str, op: str) -> Operator:
    def condition(at: Callable[[Col], Column], catalog: Catalog) -> Column | None:
        if not source.filtered:
            return None
        return F.expr(f"{sql_name(at, col)} {word} (SELECT v FROM {subquery(source, column, catalog)})")

    condition.needs_catalog = True
    return operator(FILTER, lambda b: b.with_(where=(*b.where, (op, condition))))


def where_in_select(col: Col, column: Col, source: Block, op: str = "and") -> Operator:
    """col IN (SELECT column FROM source). Without a filter or limit in the source the whole predicate vanishes."""
    return _in_select(col, column, source, "IN", op)


def where_not_in_select(col: Col, column: Col, source: Block, op: str = "and") -> Operator:
    """NOT IN by SQL's rules: a null among the source's values lets nothing pass. Vanishes like where_in_select()."""
    return _in_select(col, column, source, "NOT IN", op)


# joins


def _join(how: str) -> Callable[..., Operator]:
    def join(left: Col, right: Col, *conditions: Operator, all_rows: bool = False) -> Operator:
        """Equal columns; the right model's conditions and its soft-delete rule stand in ON."""
        theirs = Block(right.model, include_deleted=all_rows).pipe(*conditions)
        return operator(JOIN, lambda b: b.with_(joins=(*b.joins, Join(how, theirs, lambda at: left.resolve(at) == right.resolve(at)))))

    return join


join_on = inner_join_on = _join("inner")
left_join_on, right_join_on, full_join_on, cross_join_on = map(_join, ("left", "right", "full", "cross"))
join_on_as, inner_join_on_as, left_join_on_as, right_join_on_as, full_join_on_as, cross_join_on_as = join_on, join_on, left_join_on, right_join_on, full_join_on, cross_join_on


def join_cond(model: Model, condition: Callable | None = None, how: str = "inner", using: Iterable[str] = (), all_rows: bool = False) -> Operator:
    """A join on any condition, on columns of equal names, or on none."""
    return operator(JOIN, lambda b: b.with_(joins=(*b.joins, Join(how, Block(model, include_deleted=all_rows), condition, tuple(using)))))


# grouping


def aggregate(block: Block, *outs: Expr, into: Model | None = None) -> Block:
    """One row of aggregates over the block. What is piped on applies to the result, as HAVING does."""
    return aggregate_group_by(block, (), *outs, into=into)


def aggregate_group_by(block: Block, by: Iterable[Expr], *outs: Expr, into: Model | None = None) -> Block:
    by = tuple(by)
    plain = not (block.projects or block.limit or block.distinct or block.distinct_on or block.set_ops or block.orders or block.group_by)
    inner = block if plain else as_(block, block.name)
    names = [e.name for e in outs]
    made = into or Model(f"{block.model.name}_aggregate", tuple(Col(n) for n in names))
    return as_(inner.with_(group_by=by, projects=tuple(outs)), made.name).with_(model=made)


def columns(*cols: Expr) -> tuple[Expr, ...]:
    return cols


# order and pages


def _sort(how: str) -> Callable[..., Operator]:
    def sort(col: Expr, nulls: str = "") -> Operator:
        """nulls: "first" or "last"; else first in ascending and last in descending order."""
        word = f"{how}_nulls_{nulls}" if nulls else how
        return operator(SORT, lambda b: b.with_(orders=(*b.orders, (col, word))))

    return sort


asc_sort, desc_sort = _sort("asc"), _sort("desc")
cast_asc_sort, cast_desc_sort, default_sort = asc_sort, desc_sort, asc_sort


def limit(n: int, offset: int = 0) -> Operator:
    """The last one holds; 0 is no limit, a negative number changes nothing."""
    return operator(LIMIT, lambda b: b if n < 0 else b.with_(limit=n, offset=offset or b.offset))


def offset(n: int) -> Operator:
    """Rows to leave out before the limit's; without a limit it changes nothing, and a later limit() sets its own."""
    return operator(LIMIT, lambda b: b if n < 0 else b.with_(offset=n))


def for_count() -> Operator:
    """Without order and pages."""
    return operator(SETTING, lambda b: b.with_(orders=(), limit=None, offset=0))


# set operations


def _set(op: str) -> Callable[..., Operator]:
    def combine(other: Block, all: bool = False) -> Operator:  # noqa: A002
        return operator(PROJECT, lambda b: b.with_(set_ops=(*b.set_ops, (f"{op} all" if all else op, other))))

    return combine


union, intersect, except_ = map(_set, ("union", "intersect", "except"))


# locks and comments: nothing to lock here


def _lock(**options: bool) -> Operator:
    warnings.warn("row locks do nothing here: versions of a table never change, and a commit that meets another fails", stacklevel=2)
    return operator(LOCK, lambda b: b)


for_update = for_no_key_update = for_share = for_key_share = _lock


def addition(change: Callable) -> Operator:
    """A change of the finished frame (DataFrame to DataFrame): hints, clauses that have no operator."""
    return operator(SETTING, lambda b: b.with_(additions=(*b.additions, change)))


def comment(text: str) -> Operator:
    """Describes the jobs that an executor's verbs run for the block."""
    return operator(SETTING, lambda b: b.with_(comment=text))


def frame(block: Block, catalog: Catalog):
    return compile_block(block, catalog)
