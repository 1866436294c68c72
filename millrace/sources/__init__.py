"""Where pipelines begin: tables, blocks closed under a name, and rows to insert."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.model import Catalog, Col, Model, fields_omit_zero
from millrace.plans import Block


def from_(model: Model, *patchers: Callable[[Block], Block]) -> Block:
    """The model's live rows."""
    return Block(model).pipe(*patchers)


def from_all(model: Model, *patchers: Callable[[Block], Block]) -> Block:
    """All rows, soft-deleted ones too."""
    return Block(model, include_deleted=True).pipe(*patchers)


def as_(block: Block, name: str, *patchers: Callable[[Block], Block]) -> Block:
    """Closes a block: operators that follow apply to its result."""
    return Block(block.model, source=block, alias=name, include_deleted=True).pipe(*patchers)


def from_frame(model: Model, frame: DataFrame) -> Block:
    """Any DataFrame with the model's columns, a streaming one too."""
    return Block(model, source=frame, include_deleted=True)


def _rows(spark: SparkSession, model: Model, rows: list[dict], columns: list[str]) -> Block | None:
    if not rows:
        return None
    schema = model.schema()
    schema = type(schema)([schema[c] for c in columns])
    frame = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema, verifySchema=False)
    return from_frame(model, frame)


def _insertable(model: Model, omit: Iterable[Col] = ()) -> list[str]:
    gone = {c.name for c in omit}
    return [c.name for c in model.live_columns() if not c.autoincrement and c.name not in gone]


def values(spark: SparkSession, model: Model, rows: Iterable[dict], *columns: Col) -> Block | None:
    """Rows to insert, of the given columns in the model's order, or of all but autoincremented ones. No rows: None, no statement."""
    chosen = {c.name for c in columns}
    return _rows(spark, model, list(rows), [c.name for c in model.live_columns() if c.name in chosen] if columns else _insertable(model))


def values_omit(spark: SparkSession, model: Model, rows: Iterable[dict], *columns: Col) -> Block | None:
    return _rows(spark, model, list(rows), _insertable(model, columns))


def value(spark: SparkSession, model: Model, row: dict, *columns: Col) -> Block | None:
    return values(spark, model, [row], *columns)


def value_omit(spark: SparkSession, model: Model, row: dict, *columns: Col) -> Block | None:
    return values_omit(spark, model, [row], *columns)


def value_omit_zero(spark: SparkSession, model: Model, row: dict, *keep: Col) -> Block | None:
    """The fields that are not zero, and those of ``keep``."""
    names = fields_omit_zero(row, [c.name for c in keep])
    return _rows(spark, model, [row], [c.name for c in model.live_columns() if c.name in names])


def insert_from(block: Block, model: Model, *columns: Col, catalog: Catalog) -> DataFrame:
    """The block's columns, in order, under the given columns' names."""
    from millrace.plans import compile_block

    return compile_block(block, catalog).toDF(*[c.name for c in columns or model.cols()])


def to_jdbc(df: DataFrame, model: Model, url: str, mode: str = "append", **options: Any) -> None:
    """Writes rows to a table of a database that Spark has a driver for."""
    df.select(*[c.name for c in model.live_columns() if c.name in df.columns]).write.jdbc(url, model.table, mode, {k: str(v) for k, v in options.items()})


def jdbc(spark: SparkSession, model: Model, url: str, **options: Any) -> Block:
    """A table of a database that Spark has a driver for."""
    return from_frame(model, spark.read.jdbc(url, model.table, properties={k: str(v) for k, v in options.items()}))
