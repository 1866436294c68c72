"""Typed errors, each with a test of its own kind."""


class MillraceError(Exception):
    pass


class NotFound(MillraceError):
    """A single row was asked for and there is none."""


class Conflict(MillraceError):
    """A unique key would hold twice."""


class RolledBack(MillraceError):
    """A staged write was given up."""


class BadQuery(MillraceError, ValueError):
    """Filter or sort text that cannot be read."""


def is_not_found(e: BaseException) -> bool:
    return isinstance(e, NotFound)


def is_conflict(e: BaseException) -> bool:
    return isinstance(e, Conflict)


def is_rolled_back(e: BaseException) -> bool:
    return isinstance(e, RolledBack)
