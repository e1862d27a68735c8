"""Timestamp normalisation of raw text (COL1), as a column expression.

Rules (the reference's date parser):

* empty text                      -> error ``date is not valid``
* no ``:`` in the text            -> a number; the first ``,`` becomes ``.``;
  not a number                    -> error ``not a float``;
  above 1e9                       -> epoch **milliseconds**;
  otherwise                       -> Excel day serial, ``(x - 25569) * 86400``
  seconds, truncated to whole seconds; outside the years 1 to 9999 -> error
  ``date is not valid``
* with ``:``                      -> the layouts below, first match wins;
  none matches                    -> error ``date is not valid``

Text without an offset (and with a literal trailing ``Z``) is taken as wall
time; offsets are converted to UTC.  Runs of spaces match one space and a
fraction of a second may follow the seconds, as Go's parser allows.
Deviations: at most 6 fraction digits; ``inf``/``nan`` are not numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagscope.functions.timecols import from_epoch_us

# The reference's accepted date layouts, in its order, written
# as Spark datetime patterns ("[.SSSSSS]" = optional fraction after seconds).
DATE_LAYOUTS = [
    ("yyyy-MM-dd H:mm:ss[.SSSSSS]", False),            # 2006-01-02 15:04:05
    ("yyyy-MM-dd'T'H:mm:ss[.SSSSSS]'Z'", False),       # 2006-01-02T15:04:05Z (literal Z)
    ("yyyy-MM-dd'T'H:mm:ss[.SSSSSS]", False),          # 2006-01-02T15:04:05
    ("yyyy-MM-dd'T'H:mm", False),                      # 2006-01-02T15:04
    ("dd.MM.yyyy H:mm:ss[.SSSSSS]", False),            # 02.01.2006 15:04:05
    ("dd.MM.yyyy H:mm", False),                        # 02.01.2006 15:04
    ("dd.MM.yyyy'T'H:mm:ss[.SSSSSS]'Z'", False),       # 02.01.2006T15:04:05Z
    ("dd.MM.yyyy'T'H:mm:ss[.SSSSSS]", False),          # 02.01.2006T15:04:05
    ("dd.MM.yyyy'T'H:mm", False),                      # 02.01.2006T15:04
    ("yyyy-MM-dd'T'H:mm:ss[.SSSSSS]XXX", True),        # 2006-01-02T15:04:05-07:00
    ("yyyy-MM-dd'T'H:mm:ss.SXXX", True),               # 2006-01-02T15:04:05.0-07:00
    ("yyyy-MM-dd'T'H:mm:ss.SSXXX", True),              # 2006-01-02T15:04:05.00-07:00
    ("yyyy-MM-dd'T'H:mm:ss.SSSXXX", True),             # 2006-01-02T15:04:05.000-07:00
]
EXCEL_EPOCH_DAYS = 25569.0
EPOCH_MS_THRESHOLD = 1e9
ERR_INVALID_DATE = "date is not valid"
ERR_NOT_A_FLOAT = "not a float"
YEARS_1_TO_9999 = (-62_135_596_800_000_000, 253_402_300_799_999_999)   # microseconds

_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _parse_layout(text: Column, pattern: str, has_offset: bool) -> Column:
    """Parse to UTC wall time without consulting the session zone: text
    without an offset gets an explicit ``+0000`` (so wall times in a DST gap
    of the session zone cannot shift), and the parsed instant is rendered as
    NTZ from its epoch microseconds."""
    if not has_offset:
        text, pattern = F.concat(text, F.lit(" +0000")), pattern + " xx"
    t = F.try_to_timestamp(text, F.lit(pattern))
    return from_epoch_us(F.unix_micros(t))


def parse_text_time(text: Column, layouts=DATE_LAYOUTS) -> Column:
    """NULL when no layout matches.  The shape of the text (year or day first,
    blank or T, seconds, trailing Z or offset) leaves one or two layouts to try."""
    s = F.regexp_replace(text, " +", " ")
    found = F.lit(None).cast("timestamp_ntz")
    for shape, members in reversed(_by_shape(layouts).items()):
        found = F.when(s.rlike(shape), F.coalesce(*[_parse_layout(s, p, off) for p, off in members])).otherwise(found)
    return found


def _by_shape(layouts) -> dict[str, list]:
    """Layouts by a pattern that every text they accept has."""
    out: dict[str, list] = {}
    for pattern, has_offset in layouts:
        day = "^[0-9]{4}-" if pattern.startswith("yyyy") else "^[0-9]{2}[.]"
        blank = "[^T]*T" if "'T'" in pattern else "[^T]* "
        seconds = "[^:]*:[0-9]{2}:" if ":ss" in pattern else "[^:]*:[0-9]{2}$"
        end = "" if ":ss" not in pattern else ".*Z$" if "'Z'" in pattern else ".*([+-][0-9]{2}:[0-9]{2}|Z)$" if has_offset else "[0-9.]*$"
        out.setdefault(day + blank + seconds + end, []).append((pattern, has_offset))
    return out


def _decimal_point(text: Column) -> Column:
    return F.regexp_replace(text, "^([^,]*),", "$1.")


def parse_number_time(text: Column) -> Column:
    """Epoch milliseconds (> 1e9) or Excel serial; NULL when not a number."""
    s = _decimal_point(text)
    x = F.when(s.rlike(_NUMBER), s.try_cast("double"))
    ms = x.try_cast("long")
    excel_s = ((x - F.lit(EXCEL_EPOCH_DAYS)) * F.lit(86400.0)).try_cast("long")
    us = F.when(x > F.lit(EPOCH_MS_THRESHOLD), F.try_multiply(ms, F.lit(1000))) \
        .otherwise(F.try_multiply(excel_s, F.lit(1_000_000)))
    return F.when(us.between(*YEARS_1_TO_9999), from_epoch_us(us))


def normalise_time(raw: Column, layouts=DATE_LAYOUTS) -> Column:
    """``struct(DateTime timestamp_ntz, error string)`` for a raw text column."""
    has_colon = F.instr(raw, ":") > 0
    parsed = (F.when(raw.isNull() | (raw == ""), F.lit(None).cast("timestamp_ntz"))
              .when(has_colon, parse_text_time(raw, layouts))
              .otherwise(parse_number_time(raw)))
    error = (F.when(parsed.isNotNull(), F.lit(None).cast("string"))
             .when(raw.isNull() | (raw == "") | has_colon | _decimal_point(raw).rlike(_NUMBER), F.lit(ERR_INVALID_DATE))
             .otherwise(F.lit(ERR_NOT_A_FLOAT)))
    return F.struct(parsed.alias("DateTime"), error.alias("error"))


def normalise_times(df, col: str = "raw", layouts=DATE_LAYOUTS):
    """Table job: add ``DateTime`` and ``error`` (rejects keep their raw text)."""
    n = normalise_time(F.col(col), layouts)
    return df.select("*", n["DateTime"].alias("DateTime"), n["error"].alias("error"))
