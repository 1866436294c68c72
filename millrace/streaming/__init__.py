"""Pipelines over streams: a block over a streaming frame compiles to a streaming frame, so the same operators apply.

There is no stateful operator of its own; watermarks and windows are Spark's, through from_frame().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.model import Catalog, Model
from millrace.plans import Block, compile_block
from millrace.sources import from_frame


def stream(model: Model, frame: DataFrame, *operators: Callable[[Block], Block], catalog: Catalog | None = None) -> DataFrame:
    """Stateless operators (projections, filters, joins with tables) over a stream."""
    return compile_block(from_frame(model, frame).pipe(*operators), catalog or Catalog())
