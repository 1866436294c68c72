"""Codecs: second timestamps, durations, JSON text, texts that are null when empty, three-valued booleans."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of each unit of a duration.
UNITS = {
    "ns": 1, "nanosecond": 1, "nanoseconds": 1, "us": 10**3, "µs": 10**3, "microsecond": 10**3, "microseconds": 10**3, "ms": 10**6, "millisecond": 10**6, "milliseconds": 10**6,
    "s": 10**9, "sec": 10**9, "second": 10**9, "seconds": 10**9, "m": 60 * 10**9, "min": 60 * 10**9, "minute": 60 * 10**9, "minutes": 60 * 10**9,
    "h": 3600 * 10**9, "hr": 3600 * 10**9, "hour": 3600 * 10**9, "hours": 3600 * 10**9, "d": 86400 * 10**9, "day": 86400 * 10**9, "days": 86400 * 10**9, "w": 604800 * 10**9, "wk": 604800 * 10**9, "week": 604800 * 10**9, "weeks": 604800 * 10**9,
}
PART = r"(\d+(?:\.\d+)?)\s*([A-Za-zµ]+)"


def parse_duration(text: str) -> int:
    """Nanoseconds of text such as ``1wk``, ``1  minute`` or ``1h30m``."""
    parts = re.findall(PART, text)
    if not re.fullmatch(rf"\s*(?:{PART}\s*)+", text) or any(u.lower() not in UNITS for _, u in parts):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * UNITS[u.lower()] if n.isdigit() else round(float(n) * UNITS[u.lower()]) for n, u in parts)


def is_duration(text: str) -> bool:
    try:
        parse_duration(text)
    except ValueError:
        return False
    return True


def duration_ns(c: Column) -> Column:
    """parse_duration() of a column; null where the text is no duration."""
    numbers, units = (F.regexp_extract_all(c, F.lit(PART), F.lit(i)) for i in (1, 2))
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    ns = F.zip_with(numbers, units, lambda n, u: F.round(n.cast("decimal(18,6)") * F.try_element_at(table, F.lower(u))).cast("long"))
    return F.when(F.rlike(c, F.lit(rf"^\s*(?:{PART}\s*)+$")), F.aggregate(ns, F.lit(0).cast("long"), lambda a, b: a + b))


# timestamps are unix seconds; negative ones are zero


def seconds(ts: Column) -> Column:
    return F.greatest(F.unix_timestamp(ts), F.lit(0))


def timestamp(s: Column) -> Column:
    return F.timestamp_seconds(F.greatest(F.coalesce(s, F.lit(0)), F.lit(0)))


def is_zero(s: Column) -> Column:
    return F.coalesce(s, F.lit(0)) == 0


def add(s: Column, ns: Column | int) -> Column:
    return (s + (ns if isinstance(ns, Column) else F.lit(ns)) / F.lit(10**9)).cast("long")


def sub(a: Column, b: Column) -> Column:
    """Nanoseconds from b to a."""
    return (a - b) * F.lit(10**9)


def add_date(ts: Column, years: int, months: int, days: int) -> Column:
    """Days that a month lacks run on into the next: January 31 and a month is March 2 or 3."""
    start = F.make_date(F.year(ts), F.month(ts), F.lit(1))
    moved = F.date_add(F.add_months(start, 12 * years + months), F.dayofmonth(ts) - 1 + days)
    return F.timestamp_seconds(F.unix_timestamp(moved.cast("timestamp")) + F.unix_timestamp(ts) - F.unix_timestamp(F.to_date(ts).cast("timestamp")))


def parse_timestamp(c: Column, layouts: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(x)) for x in layouts])


#: Layouts that parse_any() tries, and the one that format_any() writes: (layout, zone).
supported_layouts: list[tuple[str, str]] = [("yyyy-MM-dd'T'HH:mm:ssXXX", "UTC"), ("yyyy-MM-dd HH:mm:ss", "UTC"), ("yyyy-MM-dd", "UTC")]
output_layout: list[tuple[str, str]] = [("yyyy-MM-dd'T'HH:mm:ssXXX", "UTC")]


def add_supported_layout(layout: str, zone: str = "UTC") -> None:
    if (layout, zone) not in supported_layouts:
        supported_layouts.append((layout, zone))


def set_output_layout(layout: str, zone: str = "UTC") -> None:
    output_layout[0] = (layout, zone)


def parse_any(c: Column) -> Column:
    """By the first supported layout that fits; one without an offset is in its own zone."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(x)) if "X" in x else F.to_utc_timestamp(F.try_to_timestamp(c, F.lit(x)), z) for x, z in supported_layouts])


def format_any(ts: Column) -> Column:
    layout, zone = output_layout[0]
    return F.date_format(F.from_utc_timestamp(ts, zone), layout)


def year(ts: Column) -> Column:
    return F.year(ts)


def month(ts: Column) -> Column:
    return F.month(ts)


def day(ts: Column) -> Column:
    return F.dayofmonth(ts)


def format_timestamp(ts: Column, layout: str = "yyyy-MM-dd'T'HH:mm:ss'+08:00'", zone: str = "Asia/Shanghai") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), layout)


def in_zone(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def now() -> int:
    return int(datetime.now(timezone.utc).timestamp())


def local(s: int, zone: str = "Asia/Shanghai") -> str:
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=max(s, 0))).astimezone(ZoneInfo(zone)).isoformat()


# JSON text: nothing is the empty text, and the empty text and null are nothing


def to_json(c: Column) -> Column:
    return F.coalesce(F.to_json(c), F.lit(""))


def array_to_json(c: Column) -> Column:
    return F.when(F.coalesce(F.size(c), F.lit(0)) == 0, "").otherwise(F.to_json(c))


def from_json(c: Column, schema: str) -> Column:
    return F.from_json(F.nullif(c, F.lit("")), schema)


def json_value(c: Column, path: str) -> Column:
    return F.get_json_object(F.nullif(c, F.lit("")), path)


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# 0 unknown, 1 true, 2 false


def from_bool(c: Column) -> Column:
    return F.when(c, 1).when(~c, 2).otherwise(0)


def to_bool(c: Column) -> Column:
    return F.when(c == 1, True).when(c == 2, False)


def mark_created(c: Column, at: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0)) == 0, at).otherwise(c)


def coalesce_zero(columns: dict[str, object]) -> list[Column]:
    """Columns with their zero in place of null, as objects take them."""
    return reduce(lambda out, kv: [*out, F.coalesce(F.col(kv[0]), F.lit(kv[1])).alias(kv[0])], columns.items(), [])
