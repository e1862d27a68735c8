"""Time helpers that stay in TIMESTAMP_NTZ and in JVM expressions.

Epoch values come from ``unix_timestamp`` and the seconds field, which read
the stored NTZ wall time, and shifts use ``timestampadd`` on NTZ, so results
never depend on the session time zone, and literals are typed NTZ so that range filters reach the
Parquet scan as pushed filters.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
US = 1_000_000


def to_datetime(value) -> _dt.datetime:
    """A naive UTC datetime from a datetime or ISO-like text (``2024-01-10
    00:00:00``); an offset, in either form, is converted to UTC."""
    if isinstance(value, _dt.datetime):
        return value if value.tzinfo is None else value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    return to_datetime(_dt.datetime.fromisoformat(str(value).strip()))


def ts_text(value) -> str:
    d = to_datetime(value)
    return d.strftime("%Y-%m-%d %H:%M:%S") + (f".{d.microsecond:06d}" if d.microsecond else "")


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal (pushable into Parquet filters)."""
    return F.expr(f"TIMESTAMP_NTZ'{ts_text(value)}'")


def div(a: Column, b: int) -> Column:
    """Whole quotient of non-negative integers, exact beyond 2^53."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def seconds_between(start, end) -> int:
    """Whole seconds from ``start`` to ``end`` (both at second resolution)."""
    return int((to_datetime(end) - to_datetime(start)).total_seconds())


def epoch_seconds_trunc(col: str | Column) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP_NTZ, zone-free (``unix_timestamp``
    on NTZ reads the stored wall time).  Truncated toward zero, so monotone but
    one too high for fractional times before 1970: fine for chunk numbers."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_timestamp(c)


def epoch_us(col: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, exact and zone-free.

    Whole seconds from ``unix_timestamp`` (floored for times before 1970)
    plus the microsecond of the second from the seconds field.  (``timestamp_diff``
    would cast NTZ to the session zone and shift wall times in DST gaps.)
    """
    c = F.col(col) if isinstance(col, str) else col
    frac = (F.extract(F.lit("SECOND"), c) * F.lit(US)).cast("long") % F.lit(US)
    secs = F.unix_timestamp(c) - F.when((c < F.expr(EPOCH)) & (frac > 0), F.lit(1)).otherwise(F.lit(0))
    return secs * F.lit(US) + frac


def epoch_us_value(value) -> int:
    d = to_datetime(value)
    return (d - _dt.datetime(1970, 1, 1)) // _dt.timedelta(microseconds=1)


def from_epoch_us(col: Column) -> Column:
    return F.timestamp_add("MICROSECOND", col, F.expr(EPOCH))


def add_seconds(ts, seconds: Column) -> Column:
    base = ts_lit(ts) if not isinstance(ts, Column) else ts
    return F.timestamp_add("SECOND", seconds, base)


def bound_filter(col: str, start, end, bounds: str = "[]") -> Column:
    """Range predicate with bound kind ``[]``, ``[)``, ``(]`` or ``()``.

    ``start`` / ``end`` may be None for an open side.
    """
    if bounds not in ("[]", "[)", "(]", "()"):
        raise ValueError(f"bounds must be one of [] [) (] (), got {bounds!r}")
    c = F.col(col)
    cond = F.lit(True)
    if start is not None:
        cond = cond & ((c >= ts_lit(start)) if bounds[0] == "[" else (c > ts_lit(start)))
    if end is not None:
        cond = cond & ((c <= ts_lit(end)) if bounds[1] == "]" else (c < ts_lit(end)))
    return cond
