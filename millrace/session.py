"""Sessions: a catalog whose tables are versions in a folder; a commit writes versions, then one file that names them the current ones."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from millrace.errors import Conflict, NotFound, RolledBack
from millrace.model import Catalog, Model, from_json, to_json
from millrace.operators.mutations import apply, check_unique
from millrace.plans import Block

_registry: dict[str, str] = {}
_sessions: dict[str, Session] = {}
_scoped: ContextVar[dict[str, Session]] = ContextVar("sessions", default={})


@dataclass
class Endpoint:
    scheme: str
    host: str = ""
    port: int = 0
    path: str = ""
    user: str = ""
    password: str = ""
    extra: dict = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> Endpoint:
        u = urlsplit(text)
        if not u.scheme:
            raise ValueError(f"an endpoint needs a scheme: {text!r}")
        return Endpoint(u.scheme, u.hostname or "", u.port or 0, u.path.lstrip("/") if u.netloc else u.path, unquote(u.username or ""), unquote(u.password or ""), dict(parse_qsl(u.query)))

    def _text(self, password: str) -> str:
        who = f"{self.user}:{password}@" if password else f"{self.user}@" if self.user else ""
        query = "&".join(f"{k}={v}" for k, v in sorted(self.extra.items()))
        return f"{self.scheme}://{who}{self.host}{f':{self.port}' if self.port else ''}/{self.path}{f'?{query}' if query else ''}"

    def __str__(self) -> str:
        return self._text(self.password)

    def masked(self) -> str:
        return self._text("-" * 6 if self.password else "")

    def patched(self, name: str = "", user: str = "", password: str = "", extra: str = "") -> Endpoint:
        return Endpoint(self.scheme, self.host, self.port, name or self.path, user or self.user, password or self.password, self.extra | dict(parse_qsl(extra)))


class Session:
    """Tables under ``folder``/table/version, read through ``catalog``.

    A commit is one file, _commits/number, that names every table's current version and its model; it is created
    exclusively and number by number. So a transaction's tables become current together, and of two writers that began
    from the same state the second fails with Conflict if they changed the same table, and follows the first otherwise.
    """

    def __init__(self, spark: SparkSession, folder: str, catalog: Catalog, name: str = ""):
        self.spark, self.folder, self.name, self.staged, self.began = spark, folder.rstrip("/"), name, None, None
        self.catalog = Catalog().add(*catalog.tables())
        for m in self.catalog.models.values():
            self.catalog.bind(m.table, lambda m=m: self.read(m))
        _sessions[name] = self

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict[str, dict]]:
        """Number and content of the last commit, {table: {version, model}}; one that a crash left unfinished does not count."""
        path, fs = self._path(f"{self.folder}/_commits")
        numbers = sorted((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), reverse=True) if fs.exists(path) else []
        for n in numbers:
            stream = fs.open(self._path(f"{self.folder}/_commits/{n:012d}")[0])
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            try:
                return numbers[0], json.loads(text)
            except ValueError:
                continue
        return (numbers[0] if numbers else 0), {}

    def version(self, table: str) -> str | None:
        if self.staged is not None and table in self.staged:
            return self.staged[table]["version"]
        return (self.began[1] if self.began else self._state()[1]).get(table, {}).get("version")

    def stored(self) -> Catalog:
        """The models that the tables were last written with: columns, defaults, keys."""
        return Catalog.of(*[from_json(x["model"]) for x in self._state()[1].values()])

    def read(self, model: Model) -> DataFrame:
        version = self.version(model.table)
        if version is None:
            return self.spark.createDataFrame([], model.schema())
        return self.spark.read.parquet(f"{self.folder}/{model.table}/{version}")

    def write(self, model: Model, df: DataFrame) -> None:
        began = self.began or self._state()
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{model.table}/{version}")
        check_unique(self.spark.read.parquet(f"{self.folder}/{model.table}/{version}"), model)
        self._set(model, version, began)

    def _set(self, model: Model, version: str, began: tuple[int, dict]) -> None:
        change = {model.table: {"version": version, "model": to_json(model)}}
        if self.staged is not None:
            self.staged.update(change)
        else:
            self._publish(change, began[1])

    def remodel(self, model: Model) -> None:
        """Another model (keys, comments) for a table whose rows stay; its unique keys must hold."""
        began = self.began or self._state()
        check_unique(self.read(model), model)
        self._set(model, self.version(model.table), began)

    def _publish(self, changes: dict[str, dict], began: dict[str, dict]) -> None:
        exists = "FileAlreadyExistsException"
        while True:
            number, now = self._state()
            for table in changes:
                if now.get(table, {}).get("version") != began.get(table, {}).get("version"):
                    raise Conflict(f"{table} was changed by another commit")
            path, fs = self._path(f"{self.folder}/_commits/{number + 1:012d}")
            try:
                out = fs.create(path, False)
            except Py4JJavaError as e:
                if exists in str(e.java_exception):
                    continue
                raise
            out.write(json.dumps(now | changes).encode())
            out.close()
            return

    def commit(self, block: Block | None, now=None) -> DataFrame | None:
        """No block, no statement. The rows affected are those of the version read, so they stay readable."""
        if block is None:
            return None
        alone = self.began is None
        self.began = self.began or self._state()
        try:
            out = apply(self.read(block.model), block, self.catalog, now)
            self.write(self.catalog.models.get(block.model.table, block.model), out.after)
        finally:
            if alone:
                self.began = None
        return out.affected

    def tx(self, do: Callable[[Session], None]) -> None:
        """Versions become current together at the end, or not at all; a transaction within another is part of it."""
        if self.staged is not None:
            return do(self)
        self.staged, self.began = {}, self._state()
        try:
            do(self)
            done, began = self.staged, self.began
        finally:
            self.staged = self.began = None
        if done:
            self._publish(done, began[1])

    @property
    def in_tx(self) -> bool:
        return self.staged is not None

    def rollback(self) -> None:
        raise RolledBack(self.name)


class ReadOnlySplit:
    """Reads from one session, writes and transactions (with their reads) in another."""

    def __init__(self, writer: Session, reader: Session):
        self.writer, self.reader, self.name = writer, reader, writer.name
        _sessions[writer.name] = self

    @property
    def catalog(self) -> Catalog:
        return (self.writer if self.writer.in_tx else self.reader).catalog

    def read(self, model: Model) -> DataFrame:
        return (self.writer if self.writer.in_tx else self.reader).read(model)

    def __getattr__(self, name: str):
        return getattr(self.__dict__["writer"], name)


@contextmanager
def injected(session: Session | ReadOnlySplit) -> Iterator[None]:
    """The session of its name in this context, before any registered one."""
    token = _scoped.set({**_scoped.get(), session.name: session})
    try:
        yield
    finally:
        _scoped.reset(token)


def from_context(name: str) -> Session | ReadOnlySplit | None:
    return _scoped.get().get(name)


def register_catalog(name: str, catalog: Catalog) -> None:
    _registry.update(dict.fromkeys(catalog.names(), name))


def session_for(name_or_model: str | Model) -> Session:
    name = name_or_model if isinstance(name_or_model, str) else _registry.get(name_or_model.table, "")
    if (found := from_context(name)) is not None:
        return found
    if name not in _sessions:
        raise NotFound(f"no session {name!r}")
    return _sessions[name]


@dataclass
class Database:
    """A named session on an endpoint (``file:///folder`` or any scheme Hadoop reads), migrated at its start if asked to."""

    name: str
    endpoint: str
    catalog: Catalog = field(default_factory=Catalog)
    enable_migrate: bool = False
    name_overwrite: str = ""
    session: Session | None = None

    def apply_catalog(self, *catalogs: Catalog) -> Database:
        self.catalog.require(*catalogs)
        register_catalog(self.name, self.catalog)
        return self

    def init(self, spark: SparkSession) -> Session:
        e = Endpoint.parse(self.endpoint).patched(name=self.name_overwrite)
        folder = e.path if e.scheme == "file" else f"{e.scheme}://{e.host}{f':{e.port}' if e.port else ''}/{e.path}"
        register_catalog(self.name, self.catalog)
        self.session = Session(spark, folder, self.catalog, self.name)
        return self.session

    def run(self, current: Catalog | None = None) -> dict:
        """Migrates from ``current``, else from the models that the tables were written with."""
        from millrace.migrate import migrate

        return migrate(self.session, current or self.session.stored(), self.catalog) if self.enable_migrate else {}
