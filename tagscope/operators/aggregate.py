"""Aggregates over a time range, one row per tag stamped with the range end (AGG1-9, 12-14).

``mode`` selects which series is aggregated, mirroring the reference's
backends as explicit semantics:

* ``raw``    - samples in ``[from, to)`` (MySQL)
* ``filled`` - the 1-second previous-value-filled series over ``[from, to]`` (ClickHouse)
* ``seeded`` - the same series seeded with the values at both bounds
* ``cyclic`` - the 1-minute cyclic series over ``[from, to)`` (MS SQL historian)

All filled variants are computed from run lengths (value x seconds), never by
materialising the grid, and every aggregate is a hash aggregate with partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagscope.functions.timecols import epoch_us_value, ts_lit
from tagscope.operators import pointintime as pit
from tagscope.operators.chunked import forward_runs, index_chunk, shuffled_by_chunk
from tagscope.operators.filters import complete_tags, filter_range, filter_tags
from tagscope.operators.resample import fill_runs
from tagscope.operators.tree import SummaryTree, around_source, points_source

GROUPS = ("avg", "sum", "min", "max", "count", "dif", "avgm")
MODES = ("raw", "filled", "seeded", "cyclic")


def check_group(group: str) -> str:
    g = (group or "").lower()
    if g not in GROUPS:
        raise ValueError(f"group error: {group!r}")
    return g


def raw_agg(group: str, v: Column = None) -> Column:
    v = F.col("Value") if v is None else v
    return {"avg": F.avg(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v),
            "count": F.count(v)}[group]


def weighted_agg(group: str, v: Column = None, w: Column = None) -> Column:
    """Aggregate of a run-length encoded series (value ``v`` held ``w`` steps)."""
    v = F.col("Value") if v is None else v
    w = F.col("w") if w is None else w
    vw = F.when(v.isNotNull(), v * w)
    wn = F.when(v.isNotNull(), w)
    return {"avg": F.try_divide(F.sum(vw), F.sum(wn)), "sum": F.sum(vw), "min": F.min(v),
            "max": F.max(v), "count": F.coalesce(F.sum(wn), F.lit(0)).cast("long")}[group]


def _stamp(df: DataFrame, end, value: Column) -> DataFrame:
    return df.select("TagName", ts_lit(end).alias("DateTime"), value.cast("double").alias("Value"))


def aggregate_raw(history: DataFrame, start, end, group: str, tags=None, bounds: str = "[)") -> DataFrame:
    """AGG1 / AGG7 (MySQL count): plain aggregate of the samples in range."""
    g = check_group(group)
    h = filter_range(filter_tags(history, tags), start, end, bounds)
    return _stamp(h.groupBy("TagName").agg(raw_agg(g).alias("_v")), end, F.col("_v"))


def filled_runs_weighted(history, start, end, seeded: bool, tags=None, step_seconds: int = 1, tree: SummaryTree | None = None) -> DataFrame:
    runs = fill_runs(history, start, end, step_seconds, seeded, tags,
                     tree=tree)
    return runs.withColumn("w", F.col("next_slot") - F.col("slot"))


def aggregate_filled(history: DataFrame, start, end, group: str, seeded: bool = False, tags=None, tree: SummaryTree | None = None) -> DataFrame:
    """AGG2 (unseeded) / AGG3 (seeded): aggregate of the 1-second filled series."""
    g = check_group(group)
    r = filled_runs_weighted(history, start, end, seeded, tags, tree=tree)
    return _stamp(r.groupBy("TagName").agg(weighted_agg(g).alias("_v")), end, F.col("_v"))


def cyclic_runs(history: DataFrame, start, end, step_ms: int = 60000, tags=None, chunk_size: int = 4096,
                tree: SummaryTree | None = None) -> DataFrame:
    """Runs of the cyclic series: ``TagName, i, next_i, Value`` (instant numbers)."""
    step_us = step_ms * 1000
    span_us = epoch_us_value(end) - epoch_us_value(start)
    k = max(0, -(-span_us // step_us))
    last_at = pit.from_us_value(epoch_us_value(start) + max(k - 1, 0) * step_us)
    runs = pit.instant_runs(filter_tags(history, tags), start, k,
                            lambda x: pit._first_instant_step(x, step_us), last_at, tree)
    near, tail = forward_runs(shuffled_by_chunk(runs.select("TagName", "i", "Value"), ["TagName"], "i", index_chunk("i", chunk_size)),
                              ["TagName"], "i")
    return near.unionByName(tail.drop("_first")).select("TagName", "i", F.coalesce("next_i", F.lit(k).cast("long")).alias("next_i"), "Value")


def aggregate_cyclic(history: DataFrame, start, end, group: str, step_ms: int = 60000, tags=None, tree: SummaryTree | None = None) -> DataFrame:
    """AGG4 / AGG7 (MS SQL): aggregate of the cyclic series; ``count`` is hours
    (number of cyclic values x step / 1 h, i.e. count/60.0 at one minute)."""
    g = check_group(group)
    r = cyclic_runs(history, start, end, step_ms, tags, tree=tree).withColumn(
        "w", F.col("next_i") - F.col("i"))
    if g == "count":
        v = weighted_agg("count") * F.lit(step_ms / 3_600_000)
    else:
        v = weighted_agg(g)
    return _stamp(r.groupBy("TagName").agg(v.alias("_v")), end, F.col("_v"))


def aggregate_dif(history: DataFrame, start, end, tags=None, interpolate: bool = False,
                  tree: SummaryTree | None = None) -> DataFrame:
    """AGG5: value at ``to`` minus value at ``from`` (last at or before each);
    AGG6 with ``interpolate``: the same with linear interpolation at both ends.
    NULL when a side is missing."""
    h = filter_tags(history, tags)
    a, b = ts_lit(start), ts_lit(end)
    t = F.col("DateTime")
    if not interpolate:
        g = points_source(h, [start, end], tree).groupBy("TagName").agg(
            *pit.last_sample(t <= a, "f_"), *pit.last_sample(t <= b, "t_"))
        v = F.col("t_Value") - F.col("f_Value")
        g = g.withColumn("_v", F.when(F.col("f_DateTime").isNotNull(), v))
    else:
        src = around_source(h, [start, end], tree)
        g = src.groupBy("TagName").agg(
            *pit.last_sample(t <= a, "fb_"), *pit.first_sample(t >= a, "fa_"),
            *pit.last_sample(t <= b, "tb_"), *pit.first_sample(t >= b, "ta_"))
        v = (pit.interpolate_expr(F.lit(epoch_us_value(end)), pit.sample_struct("tb_"), pit.sample_struct("ta_"))
             - pit.interpolate_expr(F.lit(epoch_us_value(start)), pit.sample_struct("fb_"), pit.sample_struct("fa_")))
        g = g.withColumn("_v", v)
    v = F.col("_v")
    return _stamp(g, end, v)


def aggregate(history: DataFrame, start, end, group: str, mode: str = "filled", tags=None, tree: SummaryTree | None = None) -> DataFrame:
    """AGG12: grouped value per tag for any group name and series mode.

    ``dif`` is the last-value difference except in ``raw`` mode (interpolated,
    as MySQL); ``avgm`` is the plain mean of the mode's retrieved series.  With
    a list of tags each asked tag has its row, also without samples (count 0,
    otherwise NULL).
    """
    g = check_group(group)
    check_mode(mode)
    found = _aggregate(history, start, end, g, mode, tags, tree)
    return complete_tags(found, tags, end, 0.0 if g == "count" else None)


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return mode


def _aggregate(history, start, end, g, mode, tags, tree) -> DataFrame:
    if g == "dif":
        return aggregate_dif(history, start, end, tags, interpolate=(mode == "raw"), tree=tree)
    if g == "avgm":
        return average_of_series(history, start, end, mode, tags, tree)
    if mode == "raw":
        return aggregate_raw(history, start, end, g, tags)
    if mode == "cyclic":
        return aggregate_cyclic(history, start, end, g, tags=tags, tree=tree)
    return aggregate_filled(history, start, end, g, seeded=(mode == "seeded"), tags=tags, tree=tree)


def average_of_series(history: DataFrame, start, end, mode: str = "filled", tags=None, tree: SummaryTree | None = None) -> DataFrame:
    """AGG8 ``avgm``: arithmetic mean of the points the range retrieval returns
    (ClickHouse: the seeded 1-second series; MS SQL: cyclic; MySQL: raw)."""
    if mode == "raw":
        return aggregate_raw(history, start, end, "avg", tags)
    if mode == "cyclic":
        return aggregate_cyclic(history, start, end, "avg", tags=tags,
                                tree=tree)
    return aggregate_filled(history, start, end, "avg", seeded=True, tags=tags,
                            tree=tree)


def average_labelled_from(history: DataFrame, start, end, tags=None) -> DataFrame:
    """AGG9: mean over ``[from, to)`` labelled with ``from``."""
    h = filter_range(filter_tags(history, tags), start, end, "[)")
    return h.groupBy("TagName").agg(F.avg("Value").alias("Value")).select(
        "TagName", ts_lit(start).alias("DateTime"), "Value")


def distinct_tags(history: DataFrame) -> DataFrame:
    """AGG13."""
    return history.select("TagName").distinct()


def totals(history: DataFrame) -> DataFrame:
    """AGG14: number of distinct tags and of records."""
    return history.agg(F.countDistinct("TagName").alias("tags"), F.count(F.lit(1)).alias("records"))


