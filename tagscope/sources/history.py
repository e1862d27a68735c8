"""History scans: Parquet tables, relational sources over JDBC, shape normalising (SRC1-4).

A history is ``TagName string, DateTime timestamp_ntz, Value double``.  For
large stores the recommended layout is Parquet partitioned by day
(``write_history``), sorted by ``(TagName, DateTime)`` within files, so range
filters prune partitions and tag filters skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_SCHEMA = T.StructType([
    T.StructField("TagName", T.StringType()),
    T.StructField("DateTime", T.TimestampNTZType()),
    T.StructField("Value", T.DoubleType()),
])

# Column spellings used by the reference's backends.
COLUMN_ALIASES = {
    "tagname": "TagName", "t": "TagName",
    "datetime": "DateTime", "datatime": "DateTime", "d": "DateTime",
    "value": "Value", "v": "Value",
}


def normalize_history(df: DataFrame, tag: str | None = None) -> DataFrame:
    """SRC3: 3 columns (tag, time, value) or 2 columns (time, value; tag given).

    Known spellings (``DataTime``, ``t/d/v``) are renamed; any other width is an error.
    """
    cols = df.columns
    if len(cols) == 3:
        named = {COLUMN_ALIASES.get(c.lower(), c): c for c in cols}
        if set(named) == {"TagName", "DateTime", "Value"}:
            src = named
        else:
            src = dict(zip(["TagName", "DateTime", "Value"], cols))
        return df.select(F.col(src["TagName"]).cast("string").alias("TagName"),
                         F.col(src["DateTime"]).cast("timestamp_ntz").alias("DateTime"),
                         F.col(src["Value"]).cast("double").alias("Value"))
    if len(cols) == 2:
        if tag is None:
            raise ValueError("a 2-column history needs the tag name")
        return df.select(F.lit(tag).alias("TagName"), F.col(cols[0]).cast("timestamp_ntz").alias("DateTime"),
                         F.col(cols[1]).cast("double").alias("Value"))
    raise ValueError(f"unexpected number of columns: {len(cols)}, expected 2 or 3")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: Parquet history (optionally day-partitioned) with the canonical schema.

    A ``day`` partition column is kept: the range filters add ``day`` bounds
    to it, so folders outside a range are never listed or read."""
    df = spark.read.parquet(path)
    if {"TagName", "DateTime", "Value"} <= set(df.columns):
        return df.select("TagName", "DateTime", "Value") if "day" not in df.columns else df
    return normalize_history(df)



def write_history(df: DataFrame, path: str, mode: str = "append") -> None:
    """Day-partitioned, tag-clustered Parquet layout for large histories; a hot
    tag's day is dealt out by the hour."""
    (df.withColumn("day", F.to_date("DateTime"))
       .repartition("day", "TagName", F.hour("DateTime"))
       .sortWithinPartitions("TagName", "DateTime")
       .write.mode(mode).partitionBy("day").parquet(path))


def tag_dimension(spark: SparkSession, path: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """SRC4: the tag table, or the distinct tags of a history."""
    if path is not None:
        t = spark.read.parquet(path)
        return t.select(F.col(t.columns[0]).cast("string").alias("TagName"))
    return history.select("TagName").distinct()


# ---- relational sources (SRC2) ------------------------------------------------------
# JDBC driver classes and URL shapes per backend type.
JDBC_BACKENDS = {
    "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", "jdbc:clickhouse://{host}:{port}/{database}"),
    "mssql": ("com.microsoft.sqlserver.jdbc.SQLServerDriver",
              "jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=false;trustServerCertificate=true"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}"),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}"),
}


def jdbc_options(backend: str, host: str, port: str | int, database: str, user: str, password: str,
                 table: str = "history", partition_column: str | None = "DateTime",
                 lower_bound: str | None = None, upper_bound: str | None = None,
                 num_partitions: int = 64, fetchsize: int = 10000) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``: parallel range-split reads on
    the time column when bounds are given (one query per partition)."""
    try:
        driver, url = JDBC_BACKENDS[backend]
    except KeyError:
        raise ValueError(f"unknown backend {backend!r}; one of {sorted(JDBC_BACKENDS)}") from None
    opts = {"driver": driver, "url": url.format(host=host, port=port, database=database),
            "dbtable": table, "user": user, "password": password, "fetchsize": str(fetchsize)}
    if partition_column and lower_bound is not None and upper_bound is not None:
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower_bound),
                     "upperBound": str(upper_bound), "numPartitions": str(num_partitions)})
    return opts


def read_history_jdbc(spark: SparkSession, backend: str, tag: str | None = None, **kw) -> DataFrame:
    """SRC2: a history table of a relational backend, normalised."""
    return normalize_history(spark.read.format("jdbc").options(**jdbc_options(backend, **kw)).load(), tag)
