"""As-of lookups: value at a date (last / exact / interpolated) and at N instants.

Single-date lookups are one hash aggregate with partial (map-side) combine,
so a hot tag is pre-reduced in every task before the shuffle.  The N-instant
form never joins instants to samples: each sample is numbered with the first
instant it feeds (pure arithmetic), reduced to one row per (tag, instant)
and each reduced row is exploded over the instants it
holds, up to the next reduced row found with the chunked lead.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagscope.functions.timecols import (
    US, add_seconds, div, epoch_us, epoch_us_value, from_epoch_us, seconds_between, to_datetime, ts_lit)
from tagscope.operators.chunked import explode_span, filled_grid, forward_runs, index_chunk, shuffled_by_chunk
from tagscope.operators.filters import filter_range, filter_tags, guard_after_mark, load_mark
from tagscope.operators.tree import SummaryTree, around_source, asof_source, at_instant


def last_sample(cond: Column | None = None, prefix: str = "") -> list[Column]:
    """Latest sample (optionally among rows where ``cond``) as two primitive
    aggregates, so the aggregation stays a hash aggregate with partials.
    Duplicate times of one tag pick an arbitrary one (see ``collapse_duplicates``)."""
    t = F.col("DateTime") if cond is None else F.when(cond, F.col("DateTime"))
    return [F.max(t).alias(prefix + "DateTime"), F.max_by(F.col("Value"), t).alias(prefix + "Value")]


def first_sample(cond: Column | None = None, prefix: str = "") -> list[Column]:
    t = F.col("DateTime") if cond is None else F.when(cond, F.col("DateTime"))
    return [F.min(t).alias(prefix + "DateTime"), F.min_by(F.col("Value"), t).alias(prefix + "Value")]


def sample_struct(prefix: str) -> Column:
    """``struct(DateTime, Value)`` of aggregated columns, NULL when no sample."""
    return F.when(F.col(prefix + "DateTime").isNotNull(),
                  F.struct(F.col(prefix + "DateTime").alias("DateTime"), F.col(prefix + "Value").alias("Value")))


def collapse_duplicates(history: DataFrame, how: str = "avg") -> DataFrame:
    """One sample per (tag, time): mean (``avg``) or ``max`` of duplicates."""
    f = F.avg if how == "avg" else F.max
    return history.groupBy("TagName", "DateTime").agg(f("Value").alias("Value"))


def value_at(history: DataFrame, at, tags=None, guard: bool = False, mark: DataFrame | None = None,
             tree: SummaryTree | None = None) -> DataFrame:
    """PIT1/PIT4: last sample at or before ``at`` per tag.

    Returns ``TagName, DateTime`` (the sample's own time), ``Value``.  With
    ``guard`` the value is NULL when ``at`` is past the load mark (FLT5).  With a
    summary ``tree`` only ``at``'s day and three folders of the tree are read;
    without one all history up to ``at``.
    """
    src = asof_source(history, at, at, tree, tags)
    # with a tree few rows are left and ties take the largest value
    last = (at_instant(src, at).select("TagName", F.col("b_DateTime").alias("DateTime"), F.col("b_Value").alias("Value"))
            if tree is not None else src.groupBy("TagName").agg(*last_sample()))
    value = F.col("Value")
    if guard:
        value = guard_after_mark(value, at, mark if mark is not None else load_mark(history))
    return last.select("TagName", "DateTime", value.alias("Value"))


def value_exact(history: DataFrame, at, tags=None) -> DataFrame:
    """PIT2: samples stamped exactly ``at``."""
    h = filter_tags(history, tags)
    return h.filter(F.col("DateTime") == ts_lit(at)).select("TagName", "DateTime", "Value")


def interpolate_expr(at_us: Column, before: Column, after: Column) -> Column:
    """Linear value at ``at`` between two ``struct(DateTime, Value)`` samples.

    The earlier value when both are the same instant; NULL when a side is missing.
    """
    b_us, a_us = epoch_us(before["DateTime"]), epoch_us(after["DateTime"])
    span = a_us - b_us
    frac = F.try_divide((at_us - b_us).cast("double"), span.cast("double"))
    return (F.when(before.isNull() | after.isNull(), F.lit(None).cast("double"))
            .when(span == 0, before["Value"])
            .otherwise(before["Value"] + frac * (after["Value"] - before["Value"])))


def value_interpolated(history: DataFrame, at, tags=None, tree: SummaryTree | None = None) -> DataFrame:
    """PIT3: linear interpolation at ``at``; tags lacking a side give no row.

    With a summary ``tree`` only ``at``'s day is read from the history, and the
    folders of the tree beside it on both sides."""
    src = around_source(history, [at], tree, tags)
    if tree is not None:
        g = at_instant(src, at, after=True)
    else:
        a = ts_lit(at)
        g = src.groupBy("TagName").agg(*last_sample(F.col("DateTime") <= a, "b_"), *first_sample(F.col("DateTime") >= a, "a_"))
    v = interpolate_expr(F.lit(epoch_us_value(at)), sample_struct("b_"), sample_struct("a_"))
    return (g.filter(F.col("b_DateTime").isNotNull() & F.col("a_DateTime").isNotNull())
            .select("TagName", ts_lit(at).alias("DateTime"), v.alias("Value")))


def even_offset(i: Column, total_seconds: int, n: int) -> Column:
    """Offset (s) of instant ``i``: ``(i*T) div N``."""
    return div(i * F.lit(total_seconds).cast("long"), n)


def _first_instant_even(x_us: Column, total_seconds: int, n: int) -> Column:
    """Smallest i with ``(i*T) div N >= x`` for a sample ``x`` µs after the start."""
    if total_seconds == 0:
        return F.when(x_us <= 0, F.lit(0)).otherwise(F.lit(None).cast("long"))
    c = div(x_us + F.lit(US - 1), US)
    i = div(c * F.lit(n).cast("long") + F.lit(total_seconds - 1), total_seconds)
    return F.when(x_us <= 0, F.lit(0)).otherwise(i)


def _first_instant_step(x_us: Column, step_us: int) -> Column:
    return F.when(x_us <= 0, F.lit(0)).otherwise(div(x_us + F.lit(step_us - 1), step_us))


def instant_runs(history: DataFrame, start, n_instants: int, first_instant: Column,
                 last_instant_at, tree: SummaryTree | None = None) -> DataFrame:
    """Samples reduced to the last one per (tag, first instant it feeds).

    Returns ``TagName, i, Value`` for non-empty i only.
    """
    src = asof_source(history, start, last_instant_at, tree)
    x_us = epoch_us("DateTime") - F.lit(epoch_us_value(start))
    b = src.withColumn("i", first_instant(x_us)).filter(F.col("i").isNotNull() & (F.col("i") < n_instants))
    return b.groupBy("TagName", "i").agg(F.max_by(F.col("Value"), F.col("DateTime")).alias("Value"))


def instant_values(runs, n_instants: int, leading_nulls: bool, chunk_size: int) -> DataFrame:
    """Expand reduced runs to one row per tag and instant: ``TagName, i, Value``.

    Each non-empty instant holds until the next non-empty one (found with the
    chunked lead), so rows are produced by ``explode`` where the run lives (long runs
    are cut and dealt out) and the output is never sorted.  With ``leading_nulls``
    the instants before a tag's first sample are emitted with NULLs.
    """
    if leading_nulls:
        return filled_grid(runs.select("TagName", "i", "Value"), ["TagName"], "i", 0, n_instants - 1, chunk_size).drop("_own")
    d = shuffled_by_chunk(runs.select("TagName", "i", "Value"), ["TagName"], "i", index_chunk("i", chunk_size))
    near, tail = forward_runs(d, ["TagName"], "i")
    near = near.withColumn("_at", F.explode_outer(F.sequence("i", F.col("next_i") - 1)))
    far = explode_span(tail, F.col("i"), F.coalesce("next_i", F.lit(n_instants).cast("long")) - 1, "_at", deal=["TagName"])
    cols = ["TagName", F.col("_at").alias("i"), "Value"]
    return near.select(*cols).unionByName(far.select(*cols))


def values_at_instants(history: DataFrame, start, end, n: int, tags=None, chunk_size: int = 4096,
                       tree: SummaryTree | None = None, guard: bool = False,
                       mark: DataFrame | None = None) -> DataFrame:
    """PIT5: as-of value at N evenly spaced instants ``start + (i*T) div N`` s.

    One row per tag and instant (``TagName, DateTime, Value``); Value is NULL
    before a tag's first sample and, with ``guard``, for instants after the
    load mark (FLT5 per instant).  N < 1 is an error, as in the reference.
    """
    if n is None or n == 0:
        raise ValueError("count is empty")
    if n < 1:
        raise ValueError("count is less than one")
    T = seconds_between(start, end)
    last_at = to_datetime(start) + _dt.timedelta(seconds=((n - 1) * T) // n)
    runs = instant_runs(filter_tags(history, tags), start, n, lambda x: _first_instant_even(x, T, n),
                        last_at, tree)
    g = instant_values(runs, n, leading_nulls=True, chunk_size=chunk_size)
    t = add_seconds(start, even_offset(F.col("i"), T, n))
    value = F.col("Value")
    if guard:
        m = (mark if mark is not None else load_mark(history))
        value = F.when(t > m.select(F.max(m.columns[0])).scalar(), F.lit(None).cast("double")).otherwise(value)
    return g.select("TagName", t.alias("DateTime"), value.alias("Value"))


def values_cyclic(history: DataFrame, start, end, step_ms: int = 60000, tags=None, chunk_size: int = 4096,
                  tree: SummaryTree | None = None) -> DataFrame:
    """RNG3: cyclic retrieval, one held value every ``step_ms`` in ``[start, end)``.

    Instants before a tag's first sample are dropped.
    """
    step_us = step_ms * 1000
    span_us = epoch_us_value(end) - epoch_us_value(start)
    k = max(0, -(-span_us // step_us))
    if k == 0:
        return history.sparkSession.createDataFrame([], "TagName string, DateTime timestamp_ntz, Value double")
    last_at = from_us_value(epoch_us_value(start) + (k - 1) * step_us)
    runs = instant_runs(filter_tags(history, tags), start, k, lambda x: _first_instant_step(x, step_us),
                        last_at, tree)
    g = instant_values(runs, k, leading_nulls=False, chunk_size=chunk_size)
    t = from_epoch_us(F.lit(epoch_us_value(start)) + F.col("i") * F.lit(step_us))
    return g.select("TagName", t.alias("DateTime"), "Value")


def from_us_value(us: int) -> _dt.datetime:
    return _dt.datetime(1970, 1, 1) + _dt.timedelta(microseconds=us)
