"""Log reading (SRC9): JSON lines, ``time=.. level=.. msg=".."`` lines, or free text.

* a line holding a JSON object gives its ``time``, ``level`` and ``msg`` keys;
* else ``msg`` is everything after the first ``msg=`` (surrounding quotes
  removed), ``level`` the last ``level=`` word (default ``UNKNOWN``) and
  ``time`` the last RFC 3339 ``time=`` word;
* else the whole line is the message with level ``UNKNOWN``;
* blank lines are dropped.  A missing or bad time is NULL (the reference
  substitutes "now", which is not reproducible).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagscope.functions.timecols import from_epoch_us

LOG_JSON_SCHEMA = "time string, level string, msg string"


def rfc3339(text: Column) -> Column:
    """RFC 3339 text (``Z`` or an offset, optional fraction) as UTC wall time."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    t = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"))
    return F.when(ok, from_epoch_us(F.unix_micros(t)))


def parse_log_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse a DataFrame of text lines into ``time, level, msg`` (+ other columns)."""
    line = F.col(col)
    rest = [F.col(c) for c in lines.columns if c != col]
    msg_pos = F.instr(line, "msg=")
    staged = lines.filter(line != "").select(
        *rest, line.alias("_line"),
        # only lines opening with "{" can hold a JSON object: skip the parser otherwise
        F.coalesce(F.when(F.ltrim(line).startswith("{"), F.json_object_keys(line).isNotNull()),
                   F.lit(False)).alias("_is_json"),
        F.when(F.ltrim(line).startswith("{"), F.from_json(line, LOG_JSON_SCHEMA)).alias("_j"),
        F.when(msg_pos > 0, F.expr(f"substring({col}, instr({col}, 'msg=') + 4)")).alias("_after"))
    after = F.col("_after")
    quoted = (F.length(after) >= 2) & after.startswith('"') & after.endswith('"')
    text_msg = (F.when(after.isNull(), F.col("_line"))
                .when(quoted, F.expr("substring(_after, 2, length(_after) - 2)")).otherwise(after))
    level_word = F.regexp_extract("_line", r"^.*(?:^|\s)level=(\S*)", 1)
    has_level = F.col("_line").rlike(r"(?:^|\s)level=")
    time_word = F.regexp_extract("_line", r"^.*(?:^|\s)time=(\S*)", 1)
    j = F.col("_j")
    return staged.select(
        *rest,
        F.when(F.col("_is_json"), rfc3339(j["time"])).otherwise(rfc3339(time_word)).alias("time"),
        F.when(F.col("_is_json"), j["level"]).when(has_level, level_word).otherwise(F.lit("UNKNOWN")).alias("level"),
        F.when(F.col("_is_json"), j["msg"]).otherwise(text_msg).alias("msg"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Scan log files (any number, split by Spark) and parse them."""
    return parse_log_lines(spark.read.text(path))
