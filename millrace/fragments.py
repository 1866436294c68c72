"""Fragments: pieces of SQL text with their arguments, and what puts them together.

A fragment is a ``Raw`` expression. None and the empty fragment are nil: combinators leave them out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column

from millrace.model import Expr, Raw, Resolver, fragment, render

_toggles: ContextVar[dict] = ContextVar("toggles", default={})


def const(text: str) -> Raw:
    """SQL text as it is."""
    return Raw(text)


def empty() -> Raw:
    return Raw("")


def is_nil(part: Any) -> bool:
    return part is None or isinstance(part, Raw) and not part.text


def collect(part: Raw | None) -> str:
    """The text with its arguments put in; nil gives nothing."""
    return "" if is_nil(part) else render(part.text, part.args, dict(part.named))


def pair(text: str, *args: Any, **named: Any) -> Raw:
    """``?`` and ``@name`` stand for arguments; a fragment among them is put in as text, a sequence as a list of values."""
    return const(_filled(text, args, named)) if any(isinstance(a, (Raw, Custom)) for a in (*args, *named.values())) else fragment(text, *args, **named)


def _filled(text: str, args: tuple, named: dict) -> str:
    marks = {f"\x01{i}\x02": a for i, a in enumerate([*args, *named.values()]) if isinstance(a, (Raw, Custom))}
    of = {id(a): m for m, a in marks.items()}
    out = render(text, tuple(of.get(id(a), a) for a in args), {k: of.get(id(a), a) for k, a in named.items()})
    for mark, a in marks.items():
        out = out.replace(f"'{mark}'", collect(a) if isinstance(a, Raw) else a.text())
    return out


@dataclass(frozen=True)
class Custom:
    """An argument with a placeholder of its own, such as ``unhex(?)``."""

    placeholder: str
    value: Any

    def text(self) -> str:
        return render(self.placeholder, (self.value,))


def values(items: Iterable[Any]) -> Raw:
    """``?, ?, ?``, one for each value."""
    found = tuple(items)
    return Raw(", ".join("?" * len(found)), found)


def non_nil(parts: Iterable[Any]) -> Iterator[Any]:
    return (p for p in parts if not is_nil(p))


def map_(items: Iterable[Any], make: Callable[[Any], Any]) -> Iterator[Any]:
    return non_nil(map(make, items))


def join(separator: str, parts: Iterable[Raw | None]) -> Raw:
    return const(separator.join(collect(p) for p in non_nil(parts)))


def join_values(separator: str, *parts: Raw | None) -> Raw:
    return join(separator, parts)


def _wrapped(part: Raw | None, before: str, after: str) -> Raw:
    return empty() if is_nil(part) else const(before + collect(part) + after)


def inline_block(part: Raw | None) -> Raw:
    """( part )"""
    return _wrapped(part, "(", ")")


def block(part: Raw | None) -> Raw:
    """Brackets on lines of their own, the part indented between them."""
    return empty() if is_nil(part) else const("(\n\t" + collect(part).replace("\n", "\n\t") + "\n)")


def block_without_brackets(parts: Iterable[Raw | None]) -> Raw:
    """The parts on a line each, indented."""
    return _wrapped(join(",\n", parts), "\n\t", "\n") if (parts := list(non_nil(parts))) else empty()


@dataclass(frozen=True)
class Func(Expr):
    """A function as a fragment; it is called when the expression is resolved, with the toggles that hold then."""

    make: Callable[[dict], Raw | None]

    def resolve(self, at: Resolver) -> Column:
        return (self.make(_toggles.get()) or Raw("NULL")).resolve(at)


@contextmanager
def toggled(**toggles: Any) -> Iterator[None]:
    token = _toggles.set({**_toggles.get(), **toggles})
    try:
        yield
    finally:
        _toggles.reset(token)


@dataclass(frozen=True)
class Injected(Expr):
    toggles: tuple
    inner: Expr

    def resolve(self, at: Resolver) -> Column:
        with toggled(**dict(self.toggles)):
            return self.inner.resolve(at)


def with_context(part: Expr, **toggles: Any) -> Expr:
    """The part, resolved where the toggles hold."""
    return Injected(tuple(toggles.items()), part)
