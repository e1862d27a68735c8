"""Summary tree over time: nearest samples on both sides of an instant in O(log) levels.

"Last value at or before t" has no lower time bound and "first value at or after
t" no upper one, so on a plain table both read all of one side.  The tree keeps,
for every tag, the first and last sample of each day, month and year that has one:

| node | children (rows with ``parent`` = node) |
| --- | --- |
| ``all`` | the years |
| ``2024`` | the months of that year |
| ``2024-01`` | the days of that month |

The samples before an instant's day lie in the earlier years, the earlier months of
its year and the earlier days of its month: three folders of the tree and at most
(years + 11 + 30) rows a tag, whatever the history holds.  What is left is the
instant's own day, read from the history.  The other side is the mirror image.

``parent`` is the partition column, so these folders are all that is read.  A node
may have several rows (one per ingest batch, or after late data): only the earliest
first and the latest last sample count, so merging nodes, and adding one twice, is
harmless.  ``compact`` folds them into one row each.  Of samples with one time the
largest value is taken.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagscope.functions.timecols import to_datetime, ts_lit
from tagscope.operators.filters import filter_range, filter_tags

NODE_COLUMNS = ["TagName", "period", "DateTime", "Value", "FirstDateTime", "FirstValue"]
ROOT = "all"


def latest(time: str, value: str, cond: Column | None = None) -> Column:
    """``struct(DateTime, Value)`` of the latest sample; ties take the largest value."""
    s = F.struct(F.col(time).alias("DateTime"), F.col(value).alias("Value"))
    return F.max(s if cond is None else F.when(cond, s))


def earliest(time: str, value: str, cond: Column | None = None) -> Column:
    """The earliest sample; ties take the largest value."""
    s = F.struct(F.col(time).alias("DateTime"), F.col(value).isNull().alias("none"), (-F.col(value)).alias("Negative"))
    m = F.min(s if cond is None else F.when(cond, s))
    return F.when(m.isNotNull(), F.struct(m["DateTime"].alias("DateTime"), (-m["Negative"]).alias("Value")))


def _merged(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = rows.groupBy(*keys).agg(latest("DateTime", "Value").alias("l"), earliest("FirstDateTime", "FirstValue").alias("f"))
    return g.select(*keys, F.col("l.DateTime").alias("DateTime"), F.col("l.Value").alias("Value"),
                    F.col("f.DateTime").alias("FirstDateTime"), F.col("f.Value").alias("FirstValue"))


def tree_nodes(history: DataFrame) -> DataFrame:
    """All nodes of a history: ``parent`` and NODE_COLUMNS.  The samples are reduced
    to days before the first shuffle; months and years come from the days."""
    h = history.filter(F.col("TagName").isNotNull() & F.col("DateTime").isNotNull())
    days = _merged(h.select("TagName", F.to_date("DateTime").alias("day"), "DateTime", "Value",
                            F.col("DateTime").alias("FirstDateTime"), F.col("Value").alias("FirstValue")), ["TagName", "day"])
    month, year = F.trunc("day", "month"), F.trunc("day", "year")
    places = F.array(F.struct(F.date_format("day", "yyyy-MM").alias("parent"), F.col("day").alias("period")),
                     F.struct(F.date_format("day", "yyyy").alias("parent"), month.alias("period")),
                     F.struct(F.lit(ROOT).alias("parent"), year.alias("period")))
    up = days.select("*", F.explode(places).alias("p")).select("p.*", *[c for c in days.columns if c != "day"])
    return _merged(up, ["parent", "TagName", "period"])


class SummaryTree:
    """Nodes of a tree, as a table with the partition column ``parent``."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    def _beside(self, at, tags, before: bool) -> DataFrame:
        d = to_datetime(at).date()
        own = {ROOT: d.replace(month=1, day=1), f"{d:%Y}": d.replace(day=1), f"{d:%Y-%m}": d}
        cond = F.lit(False)
        for parent, period in own.items():
            edge = F.lit(period)
            cond = cond | ((F.col("parent") == parent) & ((F.col("period") < edge) if before else (F.col("period") > edge)))
        n = filter_tags(self.nodes.filter(F.col("parent").isin(list(own))).filter(cond), tags)
        return n.select("TagName", "DateTime", "Value") if before else \
            n.select("TagName", F.col("FirstDateTime").alias("DateTime"), F.col("FirstValue").alias("Value"))

    def before_day(self, at, tags=None) -> DataFrame:
        """Samples among which is the last one before ``at``'s day, for every tag."""
        return self._beside(at, tags, True)

    def after_day(self, at, tags=None) -> DataFrame:
        """Samples among which is the first one after ``at``'s day, for every tag."""
        return self._beside(at, tags, False)


def day_start(t) -> _dt.datetime:
    d = to_datetime(t)
    return _dt.datetime(d.year, d.month, d.day)


def asof_source(history: DataFrame, start, end, tree: SummaryTree | None = None, tags=None) -> DataFrame:
    """Rows (``TagName, DateTime, Value``) giving the exact as-of value for every
    instant in ``[start, end]``: nodes before ``start``'s day and the history from
    that day's begin to ``end``.  Without a tree, all history up to ``end``."""
    h = filter_tags(history, tags)
    if tree is None:
        return filter_range(h, None, end, "[]").select("TagName", "DateTime", "Value")
    recent = filter_range(h, day_start(start), end, "[]").select("TagName", "DateTime", "Value")
    return tree.before_day(start, tags).unionByName(recent)


def points_source(history: DataFrame, points, tree: SummaryTree | None = None, tags=None) -> DataFrame:
    """Rows giving the exact as-of value at each of ``points``: with a tree, nodes
    and the day of each point, nothing between them."""
    if tree is None:
        return asof_source(history, min(map(to_datetime, points)), max(map(to_datetime, points)), None, tags)
    out = None
    for p in points:
        part = asof_source(history, p, p, tree, tags)
        out = part if out is None else out.unionByName(part)
    return out


def after_source(history: DataFrame, at, tree: SummaryTree | None = None, tags=None) -> DataFrame:
    """Rows giving the exact first sample at or after ``at``: the rest of its day and
    the nodes after it.  Without a tree, all history from ``at`` on."""
    h = filter_tags(history, tags)
    if tree is None:
        return filter_range(h, at, None, "[]").select("TagName", "DateTime", "Value")
    same_day = filter_range(h, at, day_start(at) + _dt.timedelta(days=1), "[)").select("TagName", "DateTime", "Value")
    return tree.after_day(at, tags).unionByName(same_day)


def around_source(history: DataFrame, points, tree: SummaryTree | None = None, tags=None) -> DataFrame:
    """Rows giving the exact samples on both sides of each of ``points``: each point's
    day and the nodes beside it (the whole history without a tree)."""
    if tree is None:
        return filter_tags(history, tags).select("TagName", "DateTime", "Value")
    out = None
    for p in points:
        d = day_start(p)
        day = filter_range(filter_tags(history, tags), d, d + _dt.timedelta(days=1), "[)").select("TagName", "DateTime", "Value")
        part = tree.before_day(p, tags).unionByName(day).unionByName(tree.after_day(p, tags))
        out = part if out is None else out.unionByName(part)
    return out


# ---- storage -------------------------------------------------------------------------

def write_tree(history: DataFrame, path: str, batch: int = 0) -> None:
    """Add the nodes of ``history`` as one batch; writing a batch again replaces it."""
    (tree_nodes(history).withColumn("batch", F.lit(batch)).repartition("parent")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("parent", "batch").parquet(path))


def read_tree(spark: SparkSession, path: str) -> SummaryTree:
    schema = ("TagName string, period date, DateTime timestamp_ntz, Value double, FirstDateTime timestamp_ntz, FirstValue double, "
              "parent string, batch int")
    return SummaryTree(spark.read.schema(schema).parquet(path).select("parent", *NODE_COLUMNS))


def compacted(tree: SummaryTree) -> DataFrame:
    """One row per node."""
    return _merged(tree.nodes, ["parent", "TagName", "period"])


def compact(spark: SparkSession, path: str, out: str) -> None:
    """Write a copy of a stored tree with one row per node.  A reader of either
    copy gets the same answers, and so does one that reads a copy to which batches
    were added that it holds already."""
    (compacted(read_tree(spark, path)).withColumn("batch", F.lit(-1)).repartition("parent")
     .write.mode("overwrite").partitionBy("parent", "batch").parquet(out))


def at_instant(rows: DataFrame, at, after: bool = False) -> DataFrame:
    """TagName, ``b_DateTime, b_Value`` (last sample at or before ``at``) and, with
    ``after``, ``a_DateTime, a_Value`` (first at or after)."""
    t = ts_lit(at)
    aggs = [latest("DateTime", "Value", F.col("DateTime") <= t).alias("b")]
    if after:
        aggs.append(earliest("DateTime", "Value", F.col("DateTime") >= t).alias("a"))
    g = rows.groupBy("TagName").agg(*aggs)
    return g.select("TagName", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("b", "a")[:1 + after] for c in ("DateTime", "Value")])
