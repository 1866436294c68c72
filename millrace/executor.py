"""Verbs over a block: rows, one row, counts, commits; and keyed sets of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.errors import NotFound
from millrace.model import Catalog, Model
from millrace.operators import COMPOSE, Operator, for_count
from millrace.plans import Block, compile_block


def expand(operators: tuple[Operator, ...]) -> list[Operator]:
    out: list[Operator] = []
    for op in operators:
        out += expand(op.parts) if getattr(op, "kind", COMPOSE) == COMPOSE and hasattr(op, "parts") else [op]
    return out


class Executor:
    def __init__(self, block: Block, catalog: Catalog, operators: tuple[Operator, ...] = ()):
        self.block, self.catalog, self.operators = block, catalog, operators

    def pipe(self, *operators: Operator) -> Executor:
        """Applied by kind (projections, filters, sorts, limits, ...), those of a kind as written."""
        return Executor(self.block, self.catalog, (*self.operators, *operators))

    def prepared(self) -> Block:
        return self.block.pipe(*sorted(expand(self.operators), key=lambda op: getattr(op, "kind", COMPOSE)))

    def frame(self) -> DataFrame:
        return compile_block(self.prepared(), self.catalog)

    def items(self) -> Iterator[Row]:
        return self.frame().toLocalIterator(prefetchPartitions=True)

    def list(self) -> list[Row]:
        df, text = self.frame(), self.prepared().comment
        context = df.sparkSession.sparkContext
        before = context.getLocalProperty("spark.job.description")
        if text:
            context.setJobDescription(text)
        try:
            return df.collect()
        finally:
            context.setLocalProperty("spark.job.description", before)

    def list_to(self, add: Callable[[Row], Any]) -> None:
        for row in self.items():
            add(row)

    def find_one(self) -> Row | None:
        return next(iter(compile_block(self.prepared().with_(limit=1), self.catalog).collect()), None)

    def must_one(self) -> Row:
        row = self.find_one()
        if row is None:
            raise NotFound(self.block.model.table)
        return row

    def count_frame(self) -> DataFrame:
        """One row: the number of rows without order and pages."""
        return compile_block(for_count()(self.prepared()).with_(projects=(), default_projects=()), self.catalog).agg(F.count(F.lit(1)).alias("count"))

    def count(self) -> int:
        return self.count_frame().first()[0]

    def commit(self, session: Any, now: Any = None) -> DataFrame:
        """Writes the mutation as a new version of its table; the rows affected."""
        return session.commit(self.prepared(), now)


def scan(row: Row | None, model: Model) -> dict:
    """A row as an object's fields: null is the zero value. No row: NotFound."""
    if row is None:
        raise NotFound(model.table)
    values = row.asDict()
    return {c.name: c.zero() if values[c.name] is None else values[c.name] for c in model.columns if c.name in values}


def one_to_multi(df: DataFrame, *key: str, to: str = "records") -> DataFrame:
    """All records of each key, in one array. For keys with few records each."""
    return df.groupBy(*key).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in key])).alias(to))


def first_records(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first record of each key in the order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def one_to_one(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last record of each key in the order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order]))).where("__n = 1").drop("__n")
