"""Tag-set, time-range, mask and load-mark filters (FLT1-5)."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagscope.functions.timecols import bound_filter, to_datetime, ts_lit

# Above this many names a tag list is joined (left_semi) instead of inlined.
INLINE_TAG_LIMIT = 1000


def split_tags(tag: str | Iterable[str] | None, strict: bool = False) -> list[str] | None:
    """``'a, b ,c'`` -> ``['a', 'b', 'c']``.  None means all tags.

    ``strict`` (the grouped path) drops empty items and rejects an empty list.
    """
    if tag is None:
        return None
    items = tag.split(",") if isinstance(tag, str) else list(tag)
    items = [t.strip() for t in items]
    if strict:
        items = [t for t in items if t]
        if not items:
            raise ValueError("tag list is empty")
    return items


def filter_tags(history: DataFrame, tags: str | Iterable[str] | DataFrame | None,
                strict: bool = False) -> DataFrame:
    """Keep the rows of the given tags.  A DataFrame of ``TagName`` is applied
    as a ``left_semi`` join (Spark broadcasts it when AQE measures it small).
    Rows without a tag name belong to no series and are left out, with or
    without a list."""
    if tags is None:
        return history.filter(F.col("TagName").isNotNull())
    if isinstance(tags, DataFrame):
        return history.join(tags.select("TagName").distinct(), "TagName", "left_semi")
    names = split_tags(tags, strict)
    if len(names) > INLINE_TAG_LIMIT:
        # a local table of known size: Spark broadcasts it where it is small enough
        return history.join(asked_names(history.sparkSession, names), "TagName", "left_semi")
    return history.filter(F.col("TagName").isin(names))


def asked_names(spark, tags) -> DataFrame:
    """The names of a request as a table of distinct ``TagName``."""
    if isinstance(tags, DataFrame):
        return tags.select("TagName").where("TagName is not null").distinct()
    # from Arrow the names are a local table whose size the planner knows
    return spark.createDataFrame(pa.table({"TagName": pa.array(list(dict.fromkeys(split_tags(tags))), pa.string())}))


def complete_tags(result: DataFrame, tags, end, empty: float | None = None) -> DataFrame:
    """``TagName, DateTime, Value`` with a row for every asked tag: one that has
    no samples gets ``DateTime`` = end and Value = ``empty``.  Without a list of
    tags the result is complete as it is."""
    if tags is None:
        return result
    names = asked_names(result.sparkSession, tags).withColumnRenamed("TagName", "_asked")
    j = result.join(names, F.col("TagName") == F.col("_asked"), "right")
    missing = F.col("TagName").isNull()
    return j.select(F.col("_asked").alias("TagName"), F.when(missing, ts_lit(end)).otherwise(F.col("DateTime")).alias("DateTime"),
                    F.when(missing, F.lit(empty).cast("double")).otherwise(F.col("Value")).alias("Value"))


def filter_range(history: DataFrame, start, end, bounds: str = "[]", col: str = "DateTime") -> DataFrame:
    """Time range with bound kind ``[]`` (ClickHouse), ``[)`` (MS SQL, MySQL) or ``()``.

    On a day-partitioned history (a ``day`` date column, see
    ``sources.history.write_history``) the matching ``day`` bounds are added so
    whole folders are pruned, not only row groups.
    """
    h = history.filter(bound_filter(col, start, end, bounds))
    if "day" in history.columns and col == "DateTime":
        if start is not None:
            h = h.filter(F.col("day") >= F.lit(to_datetime(start).date()))
        if end is not None:
            h = h.filter(F.col("day") <= F.lit(to_datetime(end).date()))
    return h


def mask_to_like(mask: str | None) -> str:
    """Tag mask to a LIKE pattern: empty is all, ``*``->``%``, ``?``->``_``, space->``%``."""
    if not mask:
        return "%"
    return mask.replace("*", "%").replace("?", "_").replace(" ", "%")


def filter_mask(df: DataFrame, mask: str | None, col: str = "TagName") -> DataFrame:
    return df.filter(F.col(col).like(mask_to_like(mask)))


def tag_list(tag_table: DataFrame, mask: str | None = None) -> DataFrame:
    """Distinct tag names matching a mask (FLT3 + AGG13); order with ``orderBy`` at export."""
    return filter_mask(tag_table.select("TagName"), mask).distinct()


def load_mark(history: DataFrame) -> DataFrame:
    """One row: the newest loaded sample time (SRC8)."""
    return history.agg(F.max("DateTime").alias("LoadMark"))


def guard_after_mark(value: Column, at, mark: DataFrame | Column) -> Column:
    """FLT5: the value is missing when ``at`` lies after the load mark.

    ``mark`` is a one-row DataFrame (evaluated as a scalar subquery) or a Column.
    """
    m = mark.select(F.max(mark.columns[0])).scalar() if isinstance(mark, DataFrame) else mark
    return F.when(ts_lit(at) > m, F.lit(None).cast("double")).otherwise(value)
