"""Event detection over ordered samples (WIN1-5).

All per-tag sequential steps use the chunked helpers, so a tag with a third
of the data is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagscope.operators.chunked import fill_forward, neighbour, nth_row
from tagscope.operators.filters import filter_range, filter_tags


def with_previous(history: DataFrame, start=None, end=None, tags=None, bounds: str = "[]") -> DataFrame:
    """WIN1: ``prev_Value`` and ``prev_DateTime`` of the previous sample in the
    filtered range (the filter runs first, as in the reference)."""
    h = filter_range(filter_tags(history, tags), start, end, bounds)
    return neighbour(h.select("TagName", "DateTime", "Value"), ["TagName"], "DateTime",
                     ["Value", "DateTime"], direction=-1)


def transitions(history: DataFrame, start, end, target: float, tags=None) -> DataFrame:
    """Times in ``[start, end]`` where the value becomes ``target``: the first
    sample of the range counts when it already equals ``target``."""
    p = with_previous(history, start, end, tags)
    cond = (F.col("Value") == F.lit(target)) & (F.col("prev_DateTime").isNull() | (F.col("Value") != F.col("prev_Value")))
    return p.filter(cond).select("TagName", "DateTime")


def down_events(history: DataFrame, start, end, tags=None) -> DataFrame:
    """WIN2: equipment went down (value turns 0)."""
    return transitions(history, start, end, 0.0, tags)


def up_events(history: DataFrame, start, end, tags=None) -> DataFrame:
    """WIN3: equipment came back up (value turns 1)."""
    return transitions(history, start, end, 1.0, tags)


def nth_event(events: DataFrame, n) -> DataFrame:
    """WIN4: the n-th event (0-based) of each tag; a bad number means 0 and
    tags with fewer events give no row."""
    try:
        k = int(n)
    except (TypeError, ValueError):
        k = 0
    return nth_row(events, ["TagName"], ["DateTime"], max(k, 0))


def hold_previous(df: DataFrame, col: str = "Value") -> DataFrame:
    """WIN5: fill NULL values with the previous non-NULL value of the tag."""
    d = df.withColumn("_present", F.col(col).isNotNull())
    return fill_forward(d, ["TagName"], "DateTime", [col], "_present").drop("_present")
