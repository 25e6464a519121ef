"""Times without zone, by the fields of their date and clock, so that no session time zone shifts them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970."""
    ts = _col(ts)
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970."""
    ts = _col(ts)
    return seconds(ts) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long") % 1_000_000


def floor_to(unit: str, ts: Column | str) -> Column:
    """The start of the minute, hour, day or (Monday's) week of a time."""
    ts = _col(ts)
    day = (F.trunc(ts, "week") if unit == "week" else F.to_date(ts)).cast("timestamp_ntz")
    if unit in ("day", "week"):
        return day
    if unit not in ("hour", "minute"):
        raise ValueError(f"unknown unit {unit}")
    return day + F.make_dt_interval(F.lit(0), F.hour(ts), F.minute(ts) if unit == "minute" else F.lit(0))


def date_of(sec: Column | str) -> Column:
    """The date of seconds since 1970."""
    return F.date_from_unix_date(F.floor(_col(sec) / 86_400).cast("int"))
