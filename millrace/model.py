"""Models: named tables with typed columns, keys and an optional soft-delete rule; catalogs of them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace
from dataclasses import field as field_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Resolver = Callable[["Col"], Column]


class Expr:
    """Something that becomes a Spark column once the block knows its tables' aliases."""

    name: str | None = None

    def resolve(self, at: Resolver) -> Column:
        raise NotImplementedError

    def as_(self, name: str) -> Expr:
        return Named(self, name)


@dataclass(frozen=True)
class Named(Expr):
    inner: Expr
    name: str

    def resolve(self, at: Resolver) -> Column:
        return self.inner.resolve(at)


@dataclass(frozen=True)
class Raw(Expr):
    """Spark SQL text, the escape hatch; ``?`` and ``@name`` stand for literals."""

    text: str
    args: tuple = ()
    named: tuple = ()

    def resolve(self, at: Resolver) -> Column:
        return F.expr(render(self.text, self.args, dict(self.named)))


def quoted(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple, set)):
        return ", ".join(map(quoted, value))
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def render(text: str, args: tuple = (), named: dict | None = None) -> str:
    """text with each ``?`` and ``@name`` outside quotes replaced by a literal."""
    left, named = list(args), named or {}

    def put(m: re.Match) -> str:
        if m[0][0] in "'\"`":
            return m[0]
        if m[0] == "?":
            return quoted(left.pop(0))
        return quoted(named[m[0][1:]]) if m[0][1:] in named else m[0]

    out = re.sub(r"'(?:[^'\\]|\\.)*'|\"[^\"]*\"|`[^`]*`|\?|@\w+", put, text)
    if left:
        raise ValueError(f"{len(left)} arguments too many for {text!r}")
    return out


def fragment(text: str, *args: Any, **named: Any) -> Raw:
    return Raw(text, args, tuple(named.items()))


@dataclass(frozen=True)
class Col(Expr):
    """A column of a model. ``default`` None means none; ``deprecated`` True drops it, a name renames it."""

    name: str
    type: str = "string"
    null: bool = False
    autoincrement: bool = False
    default: Any = None
    deprecated: bool | str = False
    field: str = ""
    comment: str = ""
    size: int = 0
    model: Any = field_(default=None, compare=False, repr=False)

    def resolve(self, at: Resolver) -> Column:
        return at(self)

    def of(self, model: Model) -> Col:
        return replace(self, model=model)

    def cast_type(self, type_: str) -> Col:
        """Another declared type; no SQL cast."""
        return replace(self, type=type_)

    def computed_by(self, expr: Expr) -> Expr:
        return Named(expr, self.name)

    def by(self, *valuers: Callable) -> tuple[Col, Callable]:
        """An assignment: the valuers applied in turn."""

        def value(at: Resolver) -> Column | None:
            c: Any = self
            for v in valuers:
                c = _Given(v(c, at))
            return c.resolve(at)

        return self, value

    def fragment(self, text: str, *args: Any, **named: Any) -> Expr:
        """SQL text in which ``#`` is this column."""
        return Template(text, self, args, tuple(named.items()))

    def zero(self) -> Any:
        return {"string": "", "boolean": False, "double": 0.0, "float": 0.0, "timestamp": None, "date": None}.get(self.type, 0 if self.type in ("long", "bigint", "int", "integer", "short", "byte") else None)


@dataclass(frozen=True)
class _Given(Expr):
    column: Column | None

    def resolve(self, at: Resolver) -> Column | None:
        return self.column


def sql_name(at: Resolver, column: Col) -> str:
    """The column as SQL text, its names quoted."""
    table = getattr(at, "table", lambda c: None)(column)
    return ".".join(f"`{p.replace('`', '``')}`" for p in (table, column.name) if p)


@dataclass(frozen=True)
class Template(Expr):
    text: str
    of: Any
    args: tuple = ()
    named: tuple = ()

    def resolve(self, at: Resolver) -> Column:
        full = lambda c: sql_name(at, c)
        if isinstance(self.of, Col):
            text = self.text.replace("#", full(self.of))
        else:
            text = re.sub(r"#(\w+)", lambda m: full(self.of[m[1]]), self.text).replace("#", self.of.name)
        return F.expr(render(text, self.args, dict(self.named)))


@dataclass(frozen=True)
class Key:
    """name, columns and their options ("desc", "nulls first"); ``kind`` is primary, unique or index."""

    name: str
    columns: tuple[str, ...]
    kind: str = "index"
    method: str = ""
    options: tuple[tuple[str, ...], ...] = ()

    @property
    def unique(self) -> bool:
        return self.kind != "index"


def primary_key(*columns: str) -> Key:
    return Key("primary", columns, "primary")


def unique_index(name: str, *columns: str, method: str = "") -> Key:
    return Key(name, columns, "unique", method)


def index(name: str, *columns: str, method: str = "") -> Key:
    return Key(name, columns, "index", method, tuple(tuple(c.split(",")[1:]) for c in columns))


def parse_index(text: str) -> Key:
    """``unique_index i_name,BTREE Name Age,DESC`` (after an optional ``@def``); ``primary`` takes no name."""
    kind, *rest = text.removeprefix("@def").split()
    kind = {"primary": "primary", "unique_index": "unique", "unique": "unique", "index": "index"}.get(kind.lower(), "")
    if not kind or not rest:
        raise ValueError(f"not an index definition: {text!r}")
    name, _, method = ("primary", "", "") if kind == "primary" else rest.pop(0).partition(",")
    parts = [c.split(",") for c in rest]
    return Key(name, tuple(p[0] for p in parts), kind, method, tuple(tuple(o.lower() for o in p[1:]) for p in parts))


def match_column(col: Col, name: str) -> bool:
    """Is it the column's name, or its field's if it begins with a capital?"""
    return (col.field if name[:1].isupper() else col.name) == name


def has_soft_delete(model: Model) -> bool:
    return model.soft_delete is not None


def to_json(model: Model) -> str:
    return json.dumps(asdict(replace(model, columns=tuple(replace(c, model=None) for c in model.columns))))


def from_json(text: str) -> Model:
    d = json.loads(text)
    keys = tuple(Key(k["name"], tuple(k["columns"]), k["kind"], k["method"], tuple(tuple(o) for o in k["options"])) for k in d.pop("keys"))
    columns, soft = tuple(Col(**c) for c in d.pop("columns")), d.pop("soft_delete")
    return Model(**{**d, "columns": columns, "keys": keys, "soft_delete": tuple(soft) if soft else None, "relations": tuple(map(tuple, d["relations"]))})


def column_name(field_name: str, tag: str = "") -> str:
    """A tag's first part, lower-cased; else f_ and the field's name, lower-cased."""
    return tag.split(",")[0].lower() or f"f_{field_name.lower()}"


def table_name(type_name: str, group: str = "") -> str:
    return "t_" + (f"{group.lower()}_" if group else "") + re.sub(r"(?<=[a-z0-9])([A-Z])|(?<=[A-Z])([A-Z])(?=[a-z])", r"_\1\2", type_name).lower()


@dataclass(frozen=True)
class Model:
    """A table. ``soft_delete`` is (column, value of live rows); ``relations`` (column, other model's name, its column)."""

    name: str
    columns: tuple[Col, ...]
    keys: tuple[Key, ...] = ()
    soft_delete: tuple[str, Any] | None = None
    table: str = ""
    comment: str = ""
    relations: tuple[tuple[str, str, str], ...] = ()
    created: str = ""
    updated: str = ""

    def __post_init__(self):
        object.__setattr__(self, "table", self.table or self.name)
        object.__setattr__(self, "columns", tuple(replace(c, name=c.name.lower(), field=c.field or c.name.removeprefix("f_").title().replace("_", "")) for c in self.columns))

    def __getitem__(self, name: str) -> Col:
        """By column name, or by field name if it begins with a capital."""
        for c in self.columns:
            if (c.field if name[:1].isupper() else c.name) == name:
                return replace(c, model=self)
        raise KeyError(f"{self.name} has no column {name}")

    def __getattr__(self, name: str) -> Col:
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(str(e)) from None

    def __hash__(self):
        return hash((self.name, self.table))

    def cols(self, *names: str) -> list[Col]:
        return [self[n] for n in names] if names else [replace(c, model=self) for c in self.columns]

    def key(self, name: str) -> Key:
        return next(k for k in self.keys if k.name == name)

    def with_name(self, name: str) -> Model:
        """The same table under another name, as a self-join needs."""
        return replace(self, name=name)

    def fragment(self, text: str, *args: Any, **named: Any) -> Expr:
        """SQL text in which ``#Field`` is a column and ``#`` this table."""
        return Template(text, self, args, tuple(named.items()))

    def live_columns(self) -> list[Col]:
        return [c for c in self.columns if not c.deprecated]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type), c.null) for c in self.live_columns()])

    @staticmethod
    def of(name: str, schema: str, **more: Any) -> Model:
        """From names and types, such as "id long, name string null"."""
        parts = [p.split(None, 1) for p in re.split(r",\s*(?![^<(]*[>)])", schema)]
        return Model(name, tuple(Col(n, t.removesuffix(" null").strip(), t.endswith(" null")) for n, t in parts), **more)


def fields_omit_zero(row: dict, exclude: Iterable[str] = ()) -> dict:
    """The values that are not zero, and those of ``exclude`` whatever they are."""
    keep = set(exclude)
    return {k: v for k, v in row.items() if k in keep or v not in (None, 0, "", False)}


@dataclass
class Catalog:
    """Models by name in the order of their addition, and where their rows are."""

    models: dict[str, Model] = field(default_factory=dict)
    frames: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    required: list[Catalog] = field(default_factory=list)

    @staticmethod
    def of(*models: Model) -> Catalog:
        return Catalog().add(*models)

    def add(self, *models: Model) -> Catalog:
        self.models.update({m.table: m for m in models})
        return self

    def remove(self, table: str) -> None:
        self.models.pop(table, None)
        self.frames.pop(table, None)

    def require(self, *catalogs: Catalog) -> Catalog:
        self.required += catalogs
        return self

    def tables(self) -> Iterator[Model]:
        seen: set[str] = set()
        for m in [*self.models.values(), *(m for c in self.required for m in c.tables())]:
            if m.table not in seen:
                seen.add(m.table)
                yield m

    def names(self) -> list[str]:
        return [m.table for m in self.tables()]

    def bind(self, table: str, frame: DataFrame | Callable[[], DataFrame]) -> Catalog:
        self.frames[table] = frame if callable(frame) and not isinstance(frame, DataFrame) else lambda: frame
        return self

    def frame(self, model: Model) -> DataFrame:
        for c in (self, *self.required):
            if model.table in c.frames:
                return c.frames[model.table]()
        raise KeyError(f"no rows are bound to {model.table}")

    @staticmethod
    def parquet(spark: SparkSession, folder: str, *models: Model) -> Catalog:
        """Models whose rows are folder/table.parquet."""
        out = Catalog.of(*models)
        for m in models:
            out.bind(m.table, lambda m=m: spark.read.parquet(f"{folder}/{m.table}.parquet"))
        return out
