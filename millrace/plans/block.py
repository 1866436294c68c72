"""The select block: what operators patch, in any order, and the one order in which it is compiled.

Scan and alias, joins with their predicates in ON, filter, grouping, projection or distinct-on, set operations, sort, offset,
limit. So a limit before a filter still limits last; only a closed block (``as_``) nests.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.model import Catalog, Col, Expr, Model, sql_name

_views = itertools.count()
_pending: list[str] = []


@dataclass(frozen=True)
class Join:
    how: str
    right: Block
    on: Any = None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Block:
    """Immutable; operators return changed copies."""

    model: Model
    source: Any = None  # None: the model's table; a Block; a DataFrame
    alias: str = ""
    joins: tuple[Join, ...] = ()
    where: tuple[tuple[str, Any], ...] = ()
    group_by: tuple[Expr, ...] | None = None
    projects: tuple[Expr, ...] = ()
    default_projects: tuple[Expr, ...] = ()
    distinct: bool = False
    distinct_on: tuple[Expr, ...] = ()
    orders: tuple[tuple[Expr, str], ...] = ()
    limit: int | None = None
    offset: int = 0
    include_deleted: bool = False
    set_ops: tuple[tuple[str, Block], ...] = ()
    comment: str = ""
    additions: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    mutation: Any = None
    returning: bool = False

    def with_(self, **changes: Any) -> Block:
        return replace(self, **changes)

    def pipe(self, *operators: Callable[[Block], Block]) -> Block:
        return reduce(lambda b, op: op(b), operators, self)

    __or__ = lambda self, op: op(self)

    @property
    def name(self) -> str:
        return self.alias or self.model.name

    @property
    def filtered(self) -> bool:
        """Does anything restrict its rows? The soft-delete rule counts."""
        return bool(self.where or self.limit or self.live is not None or isinstance(self.source, Block) and self.source.filtered)

    @property
    def live(self) -> tuple[Col, Any] | None:
        if self.model.soft_delete is None or self.include_deleted or self.source is not None:
            return None
        name, value = self.model.soft_delete
        return self.model[name], value


def safe_projected(table: str, column: str) -> str:
    """table__column; where that gets long for a database name, initials and a hash stand for the table."""
    if len(table) + len(column) < 62:
        return f"{table}__{column}"
    return "".join(p[:1] for p in table.split("_")) + "_" + hashlib.sha1(table.encode()).hexdigest()[:8] + f"__{column}"


def resolver(block: Block) -> Callable[[Col], Column]:
    names = {block.model.name: block.name}

    def at(c: Col) -> Column:
        return F.col(sql_name(at, c))

    at.table = lambda c: names.get(c.model.name, c.model.name) if c.model is not None else None
    return at


def fold(block: Block, at: Callable[[Col], Column], catalog: Catalog) -> Column | None:
    """The predicates from left to right: ``a OR b AND c`` is ``(a OR b) AND c``. None is dropped."""
    out: Column | None = None
    for op, condition in block.where:
        c = condition(at, catalog) if getattr(condition, "needs_catalog", False) else condition(at)
        if c is not None:
            out = c if out is None else (out | c if op == "or" else out & c)
    return out


def _sorted(order: tuple[Expr, str], at: Callable[[Col], Column]) -> Column:
    expr, how = order
    return getattr(expr.resolve(at), how)()


def _scan(block: Block, catalog: Catalog) -> DataFrame:
    if isinstance(block.source, Block):
        df = compile_block(block.source, catalog)
    elif block.source is not None:
        df = block.source
    else:
        df = catalog.frame(block.model)
    return df.alias(block.name)


def _project(block: Block, df: DataFrame, at: Callable[[Col], Column]) -> list[Column]:
    chosen = block.projects or block.default_projects
    if not chosen:
        return [F.col(f"`{block.name}`.*")] if block.joins and block.group_by is None and not any(j.using for j in block.joins) else []
    many = bool(block.joins)
    out = []
    for e in chosen:
        c = e.resolve(at)
        if isinstance(e, Col):
            c = c.alias(safe_projected(e.model.name, e.name) if many and e.model is not None else e.name)
        elif e.name:
            c = c.alias(e.name)
        out.append(c)
    return out


def compile_block(block: Block, catalog: Catalog) -> DataFrame:
    mark = len(_pending)
    df = _compiled(block, catalog)
    while len(_pending) > mark:  # plans are analysed by now
        df.sparkSession.catalog.dropTempView(_pending.pop())
    return df


def _compiled(block: Block, catalog: Catalog) -> DataFrame:
    at = resolver(block)
    df = _scan(block, catalog)
    for j in block.joins:
        right = _scan(j.right, catalog)
        if j.using:
            df = df.join(right, list(j.using), j.how)
            continue
        on = j.on(at) if j.on is not None else None
        theirs = fold(j.right, resolver(j.right), catalog)
        if j.right.live is not None:
            c, v = j.right.live
            alive = resolver(j.right)(c) == F.lit(v)
            theirs = alive if theirs is None else theirs & alive
        if theirs is not None:
            on = theirs if on is None else on & theirs
        df = df.crossJoin(right) if on is None else df.join(right, on, "inner" if j.how == "cross" else j.how)
    pred = fold(block, at, catalog)
    if block.live is not None:
        c, v = block.live
        alive = at(c) == F.lit(v)
        pred = alive if pred is None else pred & alive
    if pred is not None:
        df = df.filter(pred)
    orders = [_sorted(o, at) for o in block.orders]
    if block.group_by is not None:
        keys = [k.resolve(at).alias(k.name) if k.name else k.resolve(at) for k in block.group_by]
        named = {k.name for k in block.group_by}
        outs = [e.resolve(at).alias(e.name) for e in block.projects if not (isinstance(e, Col) and e.name in named)]
        df = df.groupBy(*keys).agg(*outs) if outs else df.select(*keys).distinct()
        names = [e.name for e in block.projects] or [k.name for k in block.group_by]
        df = df.select(*names)
        orders = [getattr(F.col(f"`{e.name}`") if e.name in names else e.resolve(lambda c: F.col(f"`{c.name}`")), how)() for e, how in block.orders]
    else:
        cols = _project(block, df, at)
        if block.distinct_on:
            keys = [k.resolve(at) for k in block.distinct_on]
            if orders:
                from pyspark.sql import Window as W

                df = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*orders))).filter(F.col("__rank") == 1).drop("__rank")
            else:
                first = [F.any_value(F.struct(*[F.col(f"`{block.name}`.*")])).alias("__r")]
                df = df.groupBy(*keys).agg(*first).select("__r.*").alias(block.name)
        if block.set_ops or block.distinct:
            df = df.select(*cols) if cols else df
            if block.distinct:
                df = df.distinct()
            orders = [getattr(F.col(f"`{e.name}`"), how)() for e, how in block.orders]
        else:
            # a sort may use columns that the projection drops
            df = df.orderBy(*orders) if orders else df
            df = _paged(block, df)
            return _added(block, df.select(*cols) if cols else df)
    for op, other in block.set_ops:
        right = compile_block(other, catalog)
        df = {"union all": lambda a, b: a.union(b), "union": lambda a, b: a.union(b).distinct(), "intersect all": DataFrame.intersectAll, "intersect": DataFrame.intersect, "except all": DataFrame.exceptAll, "except": DataFrame.subtract}[op](df, right)
    df = df.orderBy(*orders) if orders else df
    return _added(block, _paged(block, df))


def _paged(block: Block, df: DataFrame) -> DataFrame:
    if block.limit:  # 0 is no limit, and takes its offset along
        df = df.offset(block.offset) if block.offset > 0 else df
        df = df.limit(block.limit)
    return df


def _added(block: Block, df: DataFrame) -> DataFrame:
    for change in block.additions:
        df = change(df)
    return df


def subquery(block: Block, column: Col, catalog: Catalog) -> str:
    """A view of one column of the block, for IN and NOT IN: Catalyst knows their null rules and joins."""
    df = compile_block(block.with_(projects=(column,), default_projects=()), catalog)
    name = f"__millrace_{next(_views)}"
    df.toDF("v").createOrReplaceTempView(name)
    _pending.append(name)
    return name
