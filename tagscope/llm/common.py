"""Helpers shared by the corpus operators: reading tables, the word rule, and
intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the word rule of every word-counting operator.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only when the session names none (local tests) is it a warehouse subfolder;
    a machine-local temporary folder is never used."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return d.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts
    lineage, so a lost executor costs a re-read of files that survive it.  The
    shuffle files of the write are deleted with its end, not when the driver
    happens to collect its garbage: else those of all steps lie on the disks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop_staged(df: DataFrame) -> None:
    """Delete a table made by ``staged`` once nothing reads it any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, f)


def clear_staged(spark: SparkSession) -> int:
    """Delete every table that ``staged`` made in this process, once the results that
    read them are written; their number."""
    n = len(_STAGED)
    while _STAGED:
        _delete(spark, _STAGED.pop())
    return n


class Renamed:
    """A table under plain column names (c0, c1, ...), so that columns an
    operator adds cannot clash with the table's own; ``back`` restores them."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def name(self, column: str) -> str:
        return f"c{self.names.index(column)}"

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.df.columns).toDF(*self.names)


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def id_key(c: Column) -> Column:
    """Text form of an id, defined for null too."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def held_out(doc_id: Column) -> Column:
    """True when crc32 of the id's text leaves the remainder 1 by 3: these rows
    are never learned from (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))
