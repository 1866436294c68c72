"""Schema differences between two versions of a model, and their application to a table's rows; DDL text; entity relations."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import Catalog, Col, Key, Model, from_json, quoted, to_json

#: The order in which actions are carried out.
ORDER = ("drop index", "drop column", "rename column", "modify column", "add column", "add index", "create table")


PROPERTY = "millrace.model"


@dataclass(frozen=True)
class Action:
    kind: str
    name: str
    col: Col | None = None
    key: Key | None = None


def diff(now: Model | None, wanted: Model) -> list[Action]:
    """What leads from ``now`` to ``wanted``. Columns go only if declared deprecated; the primary key never changes."""
    if now is None:
        return [Action("create table", wanted.table)]
    have, out = {c.name: c for c in now.columns if not c.deprecated}, []
    target = {c.name: c for c in wanted.columns}
    changed = set()
    for c in wanted.columns:
        if c.deprecated and c.name in have:
            if isinstance(c.deprecated, str) and c.deprecated not in have:
                out.append(Action("rename column", c.name, target[c.deprecated]))
                changed |= {c.name, c.deprecated}
                if (target[c.deprecated].type, target[c.deprecated].null) != (have[c.name].type, have[c.name].null):
                    out.append(Action("modify column", c.deprecated, target[c.deprecated]))
            else:
                out.append(Action("drop column", c.name))
                changed.add(c.name)
    renamed = {a.col.name for a in out if a.kind == "rename column"}
    for c in wanted.live_columns():
        if c.name not in have and c.name not in renamed:
            out.append(Action("add column", c.name, c))
        elif c.name in have and (c.type, c.null, c.default) != (have[c.name].type, have[c.name].null, have[c.name].default):
            out.append(Action("modify column", c.name, c))
            if c.type != have[c.name].type:
                changed.add(c.name)
    old, new = ({k.name: k for k in m.keys if k.kind != "primary"} for m in (now, wanted))
    for name in sorted(old | new):
        a, b = old.get(name), new.get(name)
        if a == b and not changed & set(a.columns):
            continue
        if a:
            out.append(Action("drop index", name, key=a))
        if b:
            out.append(Action("add index", name, key=b))
    return sorted(out, key=lambda a: ORDER.index(a.kind))


def migrated(df: DataFrame, actions: list[Action]) -> DataFrame:
    """The table's rows after the actions; indexes are metadata."""
    for a in actions:
        if a.kind == "drop column":
            df = df.drop(a.name)
        elif a.kind == "rename column":
            df = df.withColumnRenamed(a.name, a.col.name)
        elif a.kind == "modify column":
            df = df.withColumn(a.name, F.coalesce(F.col(a.name).cast(a.col.type), F.lit(_default(a.col)).cast(a.col.type)) if not a.col.null and _default(a.col) is not None else F.col(a.name).cast(a.col.type))
        elif a.kind == "add column":
            df = df.withColumn(a.name, F.lit(_default(a.col)).cast(a.col.type))
    return df


def _default(c: Col) -> Any:
    return c.default if c.default is not None else (None if c.null else c.zero())


def create_sql(model: Model) -> str:
    cols = ", ".join(f"{c.name} {c.type.upper().replace('LONG', 'BIGINT')}{'' if c.null else ' NOT NULL'}" for c in model.live_columns())
    # what Spark's catalog has no place for: keys, defaults, comments
    return f"CREATE TABLE IF NOT EXISTS {model.table} ({cols}) USING parquet TBLPROPERTIES ('{PROPERTY}' = {quoted(to_json(model))})"


def drop_sql(model: Model) -> str:
    return f"DROP TABLE IF EXISTS {model.table}"


def truncate_sql(model: Model) -> str:
    return f"TRUNCATE TABLE {model.table}"


def create_tables(spark: SparkSession, catalog: Catalog) -> None:
    for m in catalog.tables():
        spark.sql(create_sql(m))


def index_sql(model: Model, key: Key | None = None, drop: str = "") -> str:
    """An index of a table in Spark's catalog, added or dropped: a change of the model that the table carries."""
    keys = tuple(k for k in model.keys if k.name not in (drop, key.name if key else "")) + ((key,) if key else ())
    return f"ALTER TABLE {model.table} SET TBLPROPERTIES ('{PROPERTY}' = {quoted(to_json(replace(model, keys=keys)))})"


def introspect_all(spark: SparkSession, database: str = "default") -> Catalog:
    """The models of a database's tables."""
    return Catalog.of(*[introspect(spark, t.name) for t in spark.catalog.listTables(database) if not t.isTemporary])


def introspect(spark: SparkSession, table: str) -> Model:
    """The model that the table was created with; of other tables, their columns."""
    stored = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if PROPERTY in stored:
        return from_json(stored[PROPERTY])
    return Model(table, tuple(Col(c.name, c.dataType.replace("bigint", "long"), c.nullable) for c in spark.catalog.listColumns(table)))


def migrate(session: Any, current: Catalog, wanted: Catalog) -> dict[str, list[Action]]:
    """Each table's actions, by name, with the session's rows rewritten where a column changes."""
    out = {}
    for m in sorted(wanted.tables(), key=lambda m: m.table):
        actions = diff(current.models.get(m.table), m)
        if any("column" in a.kind for a in actions):
            session.write(m, migrated(session.read(current.models[m.table]), actions))
        elif any("index" in a.kind for a in actions) and session.version(m.table):
            session.remodel(m)  # a unique index that does not hold fails here
        out[m.table] = actions
    return out


def entities(catalog: Catalog) -> dict:
    """Tables, columns, constraints, and relations declared or inferred from columns of the primary keys' names."""
    tables = list(catalog.tables())
    owner = {k.columns[0]: m for m in tables for k in m.keys if k.kind == "primary" and len(k.columns) == 1}
    out: dict = {"tables": {}, "relations": []}
    for m in tables:
        out["tables"][m.table] = {"comment": m.comment, "columns": {c.name: {"type": c.type, "null": c.null, "comment": c.comment} for c in m.live_columns()}, "constraints": {k.name: {"columns": list(k.columns), "unique": k.unique, "primary": k.kind == "primary", "method": k.method} for k in m.keys}}
        declared = {c for c, _, _ in m.relations}
        out["relations"] += [{"from": [m.table, c], "to": [t, o]} for c, t, o in m.relations]
        out["relations"] += [{"from": [m.table, c.name], "to": [owner[c.name].table, c.name]} for c in m.live_columns() if c.name in owner and owner[c.name].table != m.table and c.name not in declared]
    return out
