"""File-drop ingest as a Structured Streaming job (SRC5-8, STR1-2).

Gzip files of one JSON object per line land in a folder; history drops are
``result_*.json.gz`` / ``hs_*.json.gz``, truck-scale drops ``av_*.json.gz``.
The ``tag_drops`` source (``streaming.drops``) turns every new file into rows of
lines, each file once and only if it can be read to its end.  Each micro-batch
parses its lines in Spark and is split into good rows (appended to the sink,
Parquet, partitioned by day) and rejects (kept with the raw line and the source
file; a file that cannot be read whole is one reject and stays where it is).
Batch output folders are keyed by batch id and overwritten on replay, so a
restarted or retried batch never duplicates rows.

Neither paths nor rows come to the driver with the data: it lists the folder and
hands out names.  At most ``max_files`` drops make one micro-batch, so a backlog
is worked off in pieces (``drain_ingest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagscope.operators.tree import SummaryTree, read_tree, write_tree
from tagscope.streaming import dimension as dim
from tagscope.streaming.drops import MAX_FILES, read_drop_lines, stream_drop_lines

# File-name patterns and record layouts of the drops.
PATTERNS = {"history": ["result_*.json.gz", "hs_*.json.gz"], "truck": ["av_*.json.gz"]}
SCHEMAS = {
    "history": "TagName string, DateTime timestamp_ntz, Value double, _corrupt_record string",
    "truck": ("DateTime timestamp_ntz, CertNum string, Tare double, Brutto double, DriverName string, "
              "VanNum string, CargoType string, _corrupt_record string"),
}
REQUIRED = {"history": ["TagName", "DateTime"], "truck": ["DateTime"]}
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record",
                "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}


def parse_lines(lines: DataFrame, kind: str = "history") -> DataFrame:
    """Rows of (file, line, problem): the record's columns, ``_corrupt_record``,
    ``_file`` and ``_problem``."""
    record = F.from_json("line", SCHEMAS[kind], JSON_OPTIONS)
    return lines.select(record.alias("r"), F.col("file").alias("_file"), F.col("problem").alias("_problem"), F.col("line").alias("_line")) \
        .select("r.*", "_file", "_problem", "_line")


def drop_stream(spark: SparkSession, source_dir: str, state: str, kind: str = "history", max_files: int = MAX_FILES) -> DataFrame:
    """Streaming DataFrame of the parsed rows of the drops of one kind; ``state`` is
    the folder of the source's file log (below the query's checkpoint)."""
    return parse_lines(stream_drop_lines(spark, source_dir, PATTERNS[kind], state, max_files), kind)


def read_drops(spark: SparkSession, source_dir: str, kind: str = "history") -> DataFrame:
    """Parsed rows of the drops that lie in a folder now."""
    return parse_lines(read_drop_lines(spark, source_dir, PATTERNS[kind]), kind)


def judged(batch: DataFrame, kind: str = "history") -> DataFrame:
    """Parsed rows with the reason why they are rejected (NULL: they are not)."""
    lacking = F.lit(False)
    for c in REQUIRED[kind]:
        lacking = lacking | F.col(c).isNull()
    reason = (F.when(F.col("_problem").isNotNull(), F.col("_problem")).when(F.col("_corrupt_record").isNotNull(), "malformed")
              .when(lacking, "missing field"))
    return batch.withColumn("_reason", reason)


def split_batch(batch: DataFrame, kind: str = "history") -> tuple[DataFrame, DataFrame]:
    """Good rows (schema columns only) and rejects (raw line, file, reason): files
    and lines that could not be read, malformed JSON, records that lack a required
    field."""
    rows = judged(batch, kind)
    good = rows.filter(F.col("_reason").isNull()).select(*[c for c in batch.columns if not c.startswith("_")])
    rejects = rows.filter(F.col("_reason").isNotNull()) \
        .select(F.col("_line").alias("line"), F.col("_file").alias("file"), F.col("_reason").alias("reason"))
    return good, rejects


def _writer(sink_dir: str, reject_dir: str, kind: str):
    def write(rows: DataFrame, batch_id: int) -> None:
        batch = rows.persist()
        good, rejects = split_batch(batch, kind)
        (good.withColumn("day", F.to_date("DateTime")).withColumn("batch", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch", "day").parquet(sink_dir))
        if kind == "history":
            # what requests read instead of the history: nodes of the summary tree, tags with counts and load marks
            write_tree(good, tree_dir(sink_dir), batch_id)
            source = F.regexp_extract("_file", r"([^/_]+)_[^/]*$", 1)
            dim.add_batch(judged(batch, kind).filter(F.col("_reason").isNull()), dimension_dir(sink_dir), batch_id, source)
        (rejects.withColumn("batch", F.lit(batch_id))
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch").json(reject_dir))
        batch.unpersist()
    return write


def start_ingest(spark: SparkSession, source_dir: str, sink_dir: str, reject_dir: str, checkpoint: str,
                 kind: str = "history", once: bool = True, every: str = "1 minute",
                 clean_source: str | None = None, max_files: int = MAX_FILES) -> StreamingQuery:
    """STR1: start the ingest; ``once`` takes one micro-batch of at most ``max_files``
    drops and stops, otherwise it polls every ``every`` (the reference's cron).
    With ``clean_source="archive"`` finished drops move to a folder beside the drop
    folder; deleting drops is refused, since rejected ones are to be kept."""
    if clean_source not in (None, "archive"):
        raise ValueError("clean_source must be 'archive': an unreadable drop must not be deleted")
    lines = stream_drop_lines(spark, source_dir, PATTERNS[kind], checkpoint.rstrip("/") + "/drops", max_files,
                              source_dir.rstrip("/") + "_archive" if clean_source else None)
    w = (parse_lines(lines, kind).writeStream.foreachBatch(_writer(sink_dir, reject_dir, kind))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=every)
    return w.start()


def drain_ingest(spark: SparkSession, source_dir: str, sink_dir: str, reject_dir: str, checkpoint: str, **options) -> int:
    """Run one micro-batch after the other until no new drop is left; their number."""
    batches = 0
    while True:
        q = start_ingest(spark, source_dir, sink_dir, reject_dir, checkpoint, once=True, **options)
        q.awaitTermination()
        if not any(p["numInputRows"] for p in q.recentProgress):
            return batches
        batches += 1


def tree_dir(sink_dir: str) -> str:
    """Where the summary tree lives (beside the sink, not inside it)."""
    return sink_dir.rstrip("/") + "_tree"


def dimension_dir(sink_dir: str) -> str:
    """Where the tag dimension with counts and load marks lives."""
    return sink_dir.rstrip("/") + "_tags"


def read_ingested_tree(spark: SparkSession, sink_dir: str) -> SummaryTree:
    """The summary tree of everything ingested (pass as ``tree=`` to as-of operators)."""
    return read_tree(spark, tree_dir(sink_dir))


def read_ingested(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The ingested history (canonical columns plus the ``day`` partition)."""
    return spark.read.parquet(sink_dir).select("TagName", "DateTime", "Value", "day")


def read_ingested_dimension(spark: SparkSession, sink_dir: str) -> DataFrame:
    """SRC4: TagName, source, records, LoadMark of everything ingested."""
    return dim.read_dimension(spark, dimension_dir(sink_dir))


def load_mark(spark: SparkSession, sink_dir: str) -> DataFrame:
    """SRC8/STR2: newest loaded sample time (one row), from the dimension the ingest
    maintains, so it never scans the history."""
    return dim.load_mark(read_ingested_dimension(spark, sink_dir))


def running_load_mark(stream: DataFrame) -> DataFrame:
    """STR2 as a streaming aggregate (complete output mode) over ``drop_stream``."""
    return stream.filter(F.col("_corrupt_record").isNull()).agg(F.max("DateTime").alias("LoadMark"))
