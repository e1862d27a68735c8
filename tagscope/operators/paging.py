"""Ordering, paging and top-k (SRT1-4)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tagscope.session import shared_dir

PER_PAGE = 23
# Rows before the end of a page up to which the page is taken as a top-k.
NEAR_ROWS = 10_000


def page_count(total: int, per_page: int = PER_PAGE) -> int:
    """Number of pages (ceil; the reference's ``len/(per+1)+1`` loses rows)."""
    return max(1, math.ceil(total / per_page))


def page(df: DataFrame, order: Sequence[str | Column], page_no: int, per_page: int = PER_PAGE,
         clamp: bool = True) -> DataFrame:
    """SRT3: rows of page ``page_no`` (1-based) of ``df`` in a total order.

    With ``clamp`` a page past the end shows the last page.  A page that ends within
    the first ``NEAR_ROWS`` rows is a top-k: every task keeps that many rows at most,
    and how many there are comes from the same pass.  For a later page the rows are
    laid out once (``Pager``); to read several pages, keep the pager.
    """
    p = max(1, int(page_no or 1))
    if p * per_page > NEAR_ROWS:
        return Pager(df, order, per_page).page(p, clamp)
    top = df.orderBy(*order).limit(p * per_page)
    rn, last = F.col("_rn"), F.col("_n")
    ranked = top.withColumn("_rn", F.row_number().over(Window.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    first = F.lit((p - 1) * per_page)
    if clamp:      # fewer rows than the page's begin: the last page that has some
        first = F.least(first, F.floor((last - 1) / per_page) * per_page)
    return ranked.filter((rn > first) & (rn <= first + per_page)).drop("_rn", "_n")


class Pager:
    """The rows of a result, laid out once in order so that any page is read by itself.

    The input runs once, into a table in the shared folder; that copy is
    range-partitioned by the order (and by all columns, so that rows with one key may
    part) and written with its partition number.  The counts per partition, one number
    each, tell which one or two partitions hold a page; only those are read and sorted."""

    def __init__(self, df: DataFrame, order: Sequence[str | Column], per_page: int = PER_PAGE):
        spark = df.sparkSession
        self.path, self.per_page, self.columns = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", per_page, df.columns
        named = {o for o in order if isinstance(o, str)}
        self.order = [*order, *[c for c in df.columns if c not in named]]
        df.write.parquet(f"{self.path}/rows")
        rows = spark.read.schema(df.schema).parquet(f"{self.path}/rows")
        rows.repartitionByRange(*self.order).withColumn("_part", F.spark_partition_id()) \
            .write.partitionBy("_part").parquet(f"{self.path}/parts")
        self.parts = spark.read.schema(StructType([*df.schema.fields, StructField("_part", IntegerType())])).parquet(f"{self.path}/parts")
        counts = sorted((r["_part"], r["n"]) for r in self.parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
        self.starts, self.total = [], 0
        for part, n in counts:                       # one entry per partition
            self.starts.append((part, self.total, self.total + n))
            self.total += n

    @property
    def pages(self) -> int:
        return page_count(self.total, self.per_page)

    def page(self, page_no: int, clamp: bool = True) -> DataFrame:
        p = max(1, int(page_no or 1))
        p = min(p, self.pages) if clamp else p
        lo, hi = (p - 1) * self.per_page, p * self.per_page
        held = [(part, start) for part, start, stop in self.starts if start < hi and stop > lo]
        rows = self.parts.filter(F.col("_part").isin([part for part, _ in held]) if held else F.lit(False)).select(*self.columns)
        skip = lo - held[0][1] if held else 0
        return rows.orderBy(*self.order).offset(skip).limit(self.per_page)


def latest(df: DataFrame, time_col: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """SRT4: the ``k`` most recent rows (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(F.col(time_col).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tiebreak]).limit(k)
