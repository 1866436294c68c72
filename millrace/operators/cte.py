"""Common table expressions, recursive ones too."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.model import Catalog, Col, Model
from millrace.plans import Block, compile_block


@dataclass(frozen=True)
class With:
    """Named blocks that a final one reads; each may read those before it."""

    parts: tuple[tuple[Model, Callable[[], Block]], ...] = ()

    def with_(self, model: Model, build: Callable[[], Block]) -> With:
        return With((*self.parts, (model, build)))

    def exec(self, final: Callable[[], Block], catalog: Catalog) -> DataFrame:
        scope = Catalog().require(catalog)
        for model, build in self.parts:
            scope.add(model).bind(model.table, compile_block(build(), scope).toDF(*[c.name for c in model.columns]))
        return compile_block(final(), scope)


def with_(model: Model, build: Callable[[], Block]) -> With:
    return With().with_(model, build)


def with_recursive(spark: SparkSession, name: str, columns: list[str], body: str, final: str, views: dict[str, DataFrame], depth: int = 100) -> DataFrame:
    """WITH RECURSIVE name(columns) AS (body) final, over named frames. body: base UNION ALL step. At most ``depth`` levels."""
    before = {view: spark.table(view) for view in views if any(t.isTemporary and t.name == view for t in spark.catalog.listTables())}
    for view, df in views.items():
        df.createOrReplaceTempView(view)
    try:
        return spark.sql(f"WITH RECURSIVE {name}({', '.join(columns)}) MAX RECURSION LEVEL {depth} AS ({body}) {final}")
    finally:
        for view in views:
            if view in before:
                before[view].createOrReplaceTempView(view)
            else:
                spark.catalog.dropTempView(view)


def recursive(model: Model, base: Block, parent: Col, child: Col, step: Block, final: Callable[[], Block], catalog: Catalog, spark: SparkSession, depth: int = 100) -> DataFrame:
    """A recursive expression over blocks: ``base``, then rows of ``step`` whose ``parent`` is a found row's ``child``, level by level.

    base and step give the model's columns, in order; the model's last column counts the levels from 0. ``final`` reads the model.
    """
    *names, level = (c.name for c in model.columns)
    rows = {"__base": compile_block(base, catalog).toDF(*names), "__step": compile_block(step, catalog).toDF(*names)}
    own = ", ".join(f"s.`{n}`" for n in names)
    body = f"SELECT *, 0 FROM __base UNION ALL SELECT {own}, r.`{level}` + 1 FROM __step s JOIN r ON s.`{parent.name}` = r.`{child.name}`"
    found = with_recursive(spark, "r", [f"`{c.name}`" for c in model.columns], body, "SELECT * FROM r", rows, depth)
    return compile_block(final(), Catalog.of(model).bind(model.table, found).require(catalog))
