"""The sort language: ``field!asc`` or ``field!desc``."""

from __future__ import annotations

from dataclasses import dataclass

from millrace.errors import BadQuery
from millrace.model import Expr, Model
from millrace.operators import Operator, asc_sort, desc_sort


@dataclass(frozen=True)
class By:
    field: str = ""
    order: str = "asc"

    @staticmethod
    def parse(text: str) -> By:
        if not text:
            return By()
        name, mark, order = text.partition("!")
        if not mark or not name or order not in ("asc", "desc"):
            raise BadQuery(f"not field!asc or field!desc: {text!r}")
        return By(name, order)

    def __str__(self) -> str:
        return f"{self.field}!{self.order or 'asc'}" if self.field else ""

    @staticmethod
    def options(fields: dict[str, str]) -> list[tuple[str, str]]:
        return [(f"{n}!{o}", f"{label} {o}") for n, label in fields.items() for o in ("asc", "desc")]

    def operator(self, fields: dict[str, Expr]) -> Operator:
        if not self.field:
            return lambda b: b
        if self.field not in fields:
            raise BadQuery(f"unsupported sort field {self.field}")
        return (desc_sort if self.order == "desc" else asc_sort)(fields[self.field])


def sortable(model: Model, *names: str) -> dict[str, Expr]:
    return {model[n].field: model[n] for n in names}
