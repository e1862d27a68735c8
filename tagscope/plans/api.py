"""Request-shaped entry points: the reference's API surface as DataFrame calls.

``get_tag`` dispatches on which parameters are present, in the reference's
order: date; from+to+count+group; from+to+count; from+to+group; from+to.
Request times are text and go through the same normalisation rules as the
COL1 table job (evaluated once, on a one-row frame).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagscope.functions.timecols import to_datetime
from tagscope.functions.timeparse import normalise_time
from tagscope.operators import aggregate as agg
from tagscope.operators import buckets as bk
from tagscope.operators import events as ev
from tagscope.operators import filters as flt
from tagscope.operators import paging as pg
from tagscope.operators import pointintime as pit
from tagscope.operators import resample as rs
from tagscope.operators.tree import SummaryTree
from tagscope.functions import numbers as num
from tagscope.functions import tagdecode as dec
from tagscope.sinks import export as exp


def parse_request_time(spark: SparkSession, value) -> _dt.datetime:
    """A request time (datetime or any accepted text form) as a naive UTC datetime."""
    if isinstance(value, _dt.datetime):
        return to_datetime(value)
    r = spark.range(1).select(normalise_time(F.lit(str(value))).alias("t")).first()["t"]
    if r["DateTime"] is None:
        raise ValueError(f"{r['error']}: {value!r}")
    return r["DateTime"]


def get_tag(spark: SparkSession, history: DataFrame, tag=None, date=None, start=None, end=None,
            count=None, group=None, mode: str = "filled", guard: bool = True,
            tree: SummaryTree | None = None, method: str = "previous", mark: DataFrame | None = None,
            round=None, format: str | None = None) -> DataFrame:
    """``/get/tag/``: value at a date, range, grouped value, N instants or N buckets.

    A date lookup is ``method='previous'`` (last value, optionally guarded by
    the load mark), ``'linear'`` (interpolated) or ``'exact'``.  ``tree``
    (a summary tree) bounds every as-of search; ``mark`` (one row, from the tag
    dimension) is the load mark, so that a guarded request reads the history once.

    With ``format`` (text, json, xml, csv, grafana) the result is rows of that format,
    rounded to ``round`` decimals (2 unless it is a number); without one it is
    ``TagName, DateTime, Value`` unrounded."""
    found = _get_tag(spark, history, tag, date, start, end, count, group, mode, guard, tree, method, mark)
    return found if format is None else exp.rows_as(found, format, num.parse_round(round))


def _get_tag(spark, history, tag, date, start, end, count, group, mode, guard, tree, method, mark) -> DataFrame:
    tags = flt.split_tags(tag, strict=group is not None) if tag is not None else None
    if date is not None:
        at = parse_request_time(spark, date)
        if method == "linear":
            return pit.value_interpolated(history, at, tags, tree=tree)
        if method == "exact":
            return pit.value_exact(history, at, tags)
        if method != "previous":
            raise ValueError(f"method must be previous, linear or exact, got {method!r}")
        return pit.value_at(history, at, tags, guard=guard, mark=mark, tree=tree)
    if start is None or end is None:
        raise ValueError("need date, or from and to")
    a, b = parse_request_time(spark, start), parse_request_time(spark, end)
    if count is not None and group is not None:
        return bk.buckets(history, a, b, int(count), group, mode, tags, tree=tree)
    if count is not None:
        return pit.values_at_instants(history, a, b, int(count), tags, guard=guard, mark=mark, tree=tree)
    if group is not None:
        return agg.aggregate(history, a, b, group, mode, tags, tree=tree)
    if mode == "raw":
        return rs.range_raw(history, a, b, tags)
    if mode == "cyclic":
        return pit.values_cyclic(history, a, b, tags=tags, tree=tree)
    return rs.resample(history, a, b, 1, seeded=(mode != "gapfill"), tags=tags, tree=tree)


def get_tag_list(tag_table: DataFrame, like: str | None = None, page: int | None = None,
                 per_page: int = pg.PER_PAGE) -> DataFrame:
    """``/get/tag/list/``: tag names by mask, ordered; one page when asked."""
    t = flt.tag_list(tag_table, like)
    return pg.page(t, ["TagName"], page, per_page) if page else t.orderBy("TagName")


def get_down_dates(spark: SparkSession, history: DataFrame, tag, start, end, count=None) -> DataFrame:
    """``/get/tag/down/``: down events; with ``count`` only the n-th per tag."""
    e = ev.down_events(history, parse_request_time(spark, start), parse_request_time(spark, end), tag)
    return ev.nth_event(e, count) if count is not None else e


def get_up_dates(spark: SparkSession, history: DataFrame, tag, start, end, count=None) -> DataFrame:
    """``/get/tag/up/``."""
    e = ev.up_events(history, parse_request_time(spark, start), parse_request_time(spark, end), tag)
    return ev.nth_event(e, count) if count is not None else e


def decode(tags: DataFrame, classifier: dict | None = None) -> DataFrame:
    """``/tag/decode/``."""
    return dec.decode_tags(tags, classifier)
