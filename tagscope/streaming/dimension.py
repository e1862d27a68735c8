"""Maintained tag dimension and load marks (SRC4, SRC8, AGG13-14, FLT5, STR2).

One row per (tag, source): how many records were loaded and the time of the newest
one.  Every micro-batch adds its own partial rows in a folder of its batch number;
a replayed batch writes the same folder again, so nothing counts twice, and a run
without new files adds nothing and loses nothing.  The dimension is the sum over the
folders.  ``fold`` sums the folders so far into a base and moves a pointer to it in
one step; folders up to the base are no longer read.

So the tag list, the totals and the load marks never read the history: their work
grows with tags, not samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagscope.sources.shared_files import exists, open_folder, read_json, write_json

COLUMNS = "TagName string, source string, records long, LoadMark timestamp_ntz"
POINTER = "current.json"


def partial_rows(rows: DataFrame, source=None) -> DataFrame:
    """Dimension rows of some samples; ``source`` is a column (none: 'history')."""
    src = source if source is not None else F.lit("history")
    return rows.filter(F.col("TagName").isNotNull()).groupBy("TagName", src.alias("source")) \
        .agg(F.count(F.lit(1)).alias("records"), F.max("DateTime").alias("LoadMark"))


def add_batch(rows: DataFrame, path: str, batch: int, source=None) -> None:
    """Add one batch of samples; adding it again replaces it."""
    (partial_rows(rows, source).withColumn("batch", F.lit(batch).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/batches"))


def _current(path: str) -> dict:
    fs, base = open_folder(path)
    return read_json(fs, f"{base}/{POINTER}") if exists(fs, f"{base}/{POINTER}") else {"base": None, "upto": None}


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """TagName, source, records, LoadMark of everything added."""
    now = _current(path)
    fs, plain = open_folder(path)
    parts = []
    if exists(fs, f"{plain}/batches"):
        new = spark.read.schema(COLUMNS + ", batch long").parquet(f"{path}/batches")
        parts.append(new.filter(F.col("batch") > now["upto"]).drop("batch") if now["base"] else new.drop("batch"))
    if now["base"]:
        parts.append(spark.read.schema(COLUMNS).parquet(f"{path}/{now['base']}"))
    if not parts:
        return spark.createDataFrame([], COLUMNS)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("TagName", "source").agg(F.sum("records").alias("records"), F.max("LoadMark").alias("LoadMark"))


def fold(spark: SparkSession, path: str, upto: int) -> None:
    """Sum all batches up to ``upto`` (none of which may be replayed any more) into the base."""
    now = _current(path)
    if now["base"] and now["upto"] >= upto:
        return
    old = spark.read.schema(COLUMNS + ", batch long").parquet(f"{path}/batches").filter(F.col("batch") <= upto)
    rows = old.filter(F.col("batch") > now["upto"]) if now["base"] else old
    rows = rows.drop("batch")
    if now["base"]:
        rows = rows.unionByName(spark.read.schema(COLUMNS).parquet(f"{path}/{now['base']}"))
    name = f"base-{upto}"
    rows.groupBy("TagName", "source").agg(F.sum("records").alias("records"), F.max("LoadMark").alias("LoadMark")) \
        .write.mode("overwrite").parquet(f"{path}/{name}")
    fs, plain = open_folder(path)
    write_json(fs, f"{plain}/{POINTER}", {"base": name, "upto": upto})


def tags(dimension: DataFrame) -> DataFrame:
    """The tag list."""
    return dimension.select("TagName").distinct()


def totals(dimension: DataFrame) -> DataFrame:
    """Number of tags and of records."""
    return dimension.agg(F.countDistinct("TagName").alias("tags"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


def load_mark(dimension: DataFrame) -> DataFrame:
    """One row: the newest loaded time of all tags."""
    return dimension.agg(F.max("LoadMark").alias("LoadMark"))


def running_marks(rows: DataFrame) -> DataFrame:
    """The marks as a stateful stream (update mode): a changed mark per (tag, source).
    The state lives in the query's checkpoint and survives restarts and idle runs."""
    return rows.groupBy("TagName", "source").agg(F.count(F.lit(1)).alias("records"), F.max("DateTime").alias("LoadMark"))
