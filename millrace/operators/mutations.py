"""Inserts, upserts, updates and deletes as transforms of a table: what it holds afterwards, and the rows affected.

Plain Parquet has no row-level changes, so a change is a new version of the table (see millrace.session).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.errors import Conflict
from millrace.model import Catalog, Col, Expr, Key, Model, fields_omit_zero
from millrace.operators import COMMIT, ON_CONFLICT, Operator, operator
from millrace.plans import Block, resolver
from millrace.plans.block import fold


@dataclass(frozen=True)
class Change:
    kind: str  # update, delete, hard
    sets: tuple[tuple[Col, Callable], ...] = ()
    on_conflict: tuple[tuple[Col, ...], Any] | None = None


@dataclass(frozen=True)
class Outcome:
    after: DataFrame
    affected: DataFrame


#: Parts in which rows are numbered.
NUMBERING_PARTS = 1024


def _literal(v: Any) -> Callable:
    return lambda at: v.resolve(at) if isinstance(v, Expr) else F.lit(v)


def do_update(col: Col, valuer: Callable) -> Operator:
    """SET col = value; several accumulate."""
    def apply(b: Block) -> Block:
        sets = b.mutation.sets if b.mutation else ()
        return b.with_(mutation=Change("update", (*sets, col.by(valuer))))

    return operator(COMMIT, apply)


def do_update_set(model: Model, row: dict, *columns: Col) -> Operator:
    names = {c.name for c in columns} or {c.name for c in model.live_columns() if not c.autoincrement}
    return operator(COMMIT, lambda b: b.with_(mutation=Change("update", tuple((c, _literal(row[c.name])) for c in model.cols() if c.name in names and c.name in row))))


def do_update_set_omit(model: Model, row: dict, *omit: Col) -> Operator:
    gone = {c.name for c in omit}
    return do_update_set(model, row, *[c for c in model.cols() if c.name not in gone and not c.autoincrement and not c.deprecated])


def do_update_set_omit_zero(model: Model, row: dict, *keep: Col) -> Operator:
    kept = fields_omit_zero(row, [c.name for c in keep])
    return do_update_set(model, kept, *[c for c in model.cols() if c.name in kept])


def do_delete() -> Operator:
    """Soft, where the model has a rule for it; else hard."""
    return operator(COMMIT, lambda b: b.with_(mutation=Change("delete")))


def do_delete_hard() -> Operator:
    return operator(COMMIT, lambda b: b.with_(mutation=Change("hard")))


def on_conflict_do_nothing(*columns: Col) -> Operator:
    return operator(ON_CONFLICT, lambda b: b.with_(mutation=Change("insert", on_conflict=(columns, ()))))


def on_conflict_do_update_set(columns: list[Col], *to_update: Col) -> Operator:
    return operator(ON_CONFLICT, lambda b: b.with_(mutation=Change("insert", on_conflict=(tuple(columns), to_update))))


def on_conflict_do_with(columns: list[Col], action: Callable[[Callable, Callable], dict[str, Column]]) -> Operator:
    """action(target, excluded) gives the new columns; both map a column's name to its value."""
    return operator(ON_CONFLICT, lambda b: b.with_(mutation=Change("insert", on_conflict=(tuple(columns), action))))


def key_columns(model: Model, name: str) -> list[Col]:
    """All columns of a unique key, a soft-delete column included."""
    key: Key = model.key(name)
    return [model[c] for c in key.columns]


def insert(target: DataFrame, rows: DataFrame, model: Model, now: Any = None) -> Outcome:
    """rows appended: columns they lack get their default, autoincremented ones go on from the largest.

    The model's ``created`` and ``updated`` columns become ``now`` (unix seconds) where rows have none or zero there.
    """
    stamp = F.unix_timestamp() if now is None else F.lit(now)
    for c in filter(None, (model.created, model.updated)):
        rows = rows.withColumn(c, F.when(F.coalesce(F.col(c), F.lit(0)) == 0, stamp).otherwise(F.col(c)) if c in rows.columns else stamp)
    by_name = {c.name: c for c in model.live_columns()}
    auto = next((c.name for c in by_name.values() if c.autoincrement and c.name not in rows.columns), None)
    if auto:
        top = target.agg(F.coalesce(F.max(auto), F.lit(0)).alias("__top"))
        # numbers without one big sort: parts are counted first. Parts and order are made of the rows' contents, so both passes agree
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        rows = rows.withColumn("__i", whole).withColumn("__p", F.pmod(F.xxhash64("__i"), F.lit(NUMBERING_PARTS)))
        sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
        sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
        rows = rows.join(F.broadcast(sizes), "__p").crossJoin(F.broadcast(top))  # a row a partition, and one row
        rows = rows.withColumn(auto, (F.col("__top") + F.col("__before") + F.row_number().over(W.partitionBy("__p").orderBy("__i"))).cast(target.schema[auto].dataType)).drop("__p", "__i", "__before", "__top")
    fill = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(by_name[f.name].default if f.name in by_name and by_name[f.name].default is not None else (None if f.name not in by_name or by_name[f.name].null else by_name[f.name].zero())).cast(f.dataType) for f in target.schema.fields]
    added = rows.select(*[c.alias(f.name) for c, f in zip(fill, target.schema.fields, strict=True)])
    return Outcome(target.unionByName(added), added)


def upsert(target: DataFrame, rows: DataFrame, key: list[str], update: Any = (), all_back: bool = False) -> Outcome:
    """Insert where the key is new. Else leave the target (no ``update``), set the listed columns, or do what a callable says.

    For inserts that leave the target, the first of several rows with a new key counts (by all columns); with all_back the
    rows met come back too. Rows that update must not repeat a key: the target would be changed twice.
    """
    names = target.columns
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in names if c not in key]))
    rows = rows.select(*names)
    if not update:
        first = rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
        added = first.join(target.select(*key), key, "left_anti").select(*names)
        back = added.unionByName(target.join(rows.select(*key).distinct(), key, "left_semi").select(*names)) if all_back else added
        return Outcome(target.unionByName(added), back)
    # a repeated key fails when the rows are read
    twice = F.count(F.lit(1)).over(W.partitionBy(*key)) > 1
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    rows = rows.withColumn("__in", F.when(twice & known, F.raise_error(F.lit("a key to be updated is given twice"))).otherwise(F.lit(True)).cast("boolean"))
    old, new = target.withColumn("__old", F.lit(True)).alias("o"), rows.alias("n")
    met = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    both = F.col("__old").isNotNull() & F.col("__in").isNotNull()
    if callable(update):
        changed = update(lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}"))
    else:
        changed = {c.name if isinstance(c, Col) else c: F.col(f"n.{c.name if isinstance(c, Col) else c}") for c in update}
    value = lambda c: F.when(both, changed.get(c, F.col(f"o.{c}"))).when(F.col("__old").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    out = met.select(*[value(c).cast(target.schema[c].dataType).alias(c) for c in names], F.col("__in").isNotNull().alias("__touched"))
    return Outcome(out.drop("__touched"), out.where("__touched").drop("__touched"))


def update(target: DataFrame, block: Block, catalog: Catalog) -> Outcome:
    """SET where the block's predicate holds. Joins, order and limit of the block do not count, nor does the soft-delete rule."""
    change, at = block.mutation, resolver(block)
    df = target.alias(block.name)
    pred = fold(block, at, catalog)
    hit = F.coalesce(pred, F.lit(False)) if pred is not None else F.lit(True)
    sets = {c.name: f(at) for c, f in change.sets}
    if block.model.updated and block.model.updated not in sets:
        sets[block.model.updated] = F.unix_timestamp()
    out = df.select(*[F.when(hit, sets[c]).otherwise(at(block.model[c])).cast(target.schema[c].dataType).alias(c) if c in sets else at(block.model[c]).alias(c) for c in target.columns], hit.alias("__hit"))
    return Outcome(out.drop("__hit"), out.where("__hit").drop("__hit"))


def update_from(target: DataFrame, other: DataFrame, on: list[str], sets: dict[str, Callable[[Callable, Callable], Column]]) -> Outcome:
    """UPDATE FROM another table with unique keys ``on``: sets get (target, other), each from names to values."""
    o = other.withColumn("__met", F.lit(True)).alias("b")
    df = target.alias("a").join(o, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on], "left")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    out = df.select(*[F.when(F.col("__met"), sets[c](a, b)).otherwise(a(c)).cast(target.schema[c].dataType).alias(c) if c in sets else a(c).alias(c) for c in target.columns], F.col("__met").isNotNull().alias("__hit"))
    return Outcome(out.drop("__hit"), out.where("__hit").drop("__hit"))


def delete(target: DataFrame, block: Block, catalog: Catalog, now: Any = None) -> Outcome:
    """Hard: rows that match go. Soft: the soft-delete column of live rows that match becomes ``now``, else unix seconds."""
    at = resolver(block)
    df = target.alias(block.name)
    pred = fold(block, at, catalog)
    soft = block.model.soft_delete if block.mutation.kind == "delete" else None
    alive = block.model.soft_delete and (soft or not block.include_deleted)
    hit = pred if pred is not None else F.lit(True)
    if alive:
        name, live = block.model.soft_delete
        hit = hit & (at(block.model[name]) == F.lit(live))
    hit = F.coalesce(hit, F.lit(False))
    out = df.withColumn("__hit", hit)
    if soft:
        value = F.unix_timestamp() if now is None else F.lit(now)
        out = out.withColumn(soft[0], F.when(F.col("__hit"), value.cast(target.schema[soft[0]].dataType)).otherwise(F.col(soft[0])))
        return Outcome(out.drop("__hit"), out.where("__hit").drop("__hit"))
    return Outcome(out.where("NOT __hit").drop("__hit"), out.where("__hit").drop("__hit"))


def apply(target: DataFrame, block: Block, catalog: Catalog, now: Any = None) -> Outcome:
    """The outcome of the block's mutation; RETURNING columns select from the rows affected."""
    m = block.mutation
    if m is None or m.kind == "insert":
        rows = block.source
        if m is not None and m.on_conflict:
            full = insert(target.limit(0), rows, block.model, now).affected if set(rows.columns) != set(target.columns) else rows
            out = upsert(target, full, [c.name for c in m.on_conflict[0]], m.on_conflict[1], block.returning)
        else:
            out = insert(target, rows, block.model, now)
    elif m.kind == "update":
        out = update(target, block, catalog)
    else:
        out = delete(target, block, catalog, now)
    if block.returning and block.projects:
        back = out.affected.alias(block.name)
        out = Outcome(out.after, back.select(*[p.resolve(resolver(block)).alias(p.name) for p in block.projects]))
    return out


def check_unique(df: DataFrame, model: Model) -> None:
    """Raises Conflict if a unique key holds twice (null parts never conflict)."""
    for key in model.keys:
        if key.unique and df.dropna(subset=list(key.columns)).groupBy(*key.columns).count().where("count > 1").limit(1).count():
            raise Conflict(f"{model.table}: {key.name} holds twice")
