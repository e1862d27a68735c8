"""Views over the driver's test tables that give the engine its inputs.

Only ``events`` and ``part`` are used.  Every view is a projection of a scan
(plus, for the counter, one skew-safe running sum), so Catalyst prunes columns
and pushes predicates from the operators down into the Parquet reader.
The same definitions are written in DuckDB SQL in ``tagscope.plans.oracle``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagscope.functions.timecols import epoch_us
from tagscope.operators.chunked import running_sum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 analogue tags A20_WT_00..A20_WT_19 with the event value."""
    e = _events(spark, sf_dir)
    return e.select(
        F.concat(F.lit("A20_WT_"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("TagName"),
        F.col("ts").alias("DateTime"),
        F.col("value").cast("double").alias("Value"),
    )


def state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0/1 run signal per user: 0 on an error event, else 1."""
    e = _events(spark, sf_dir)
    return e.select(
        F.col("user_id").cast("string").alias("TagName"),
        F.col("ts").alias("DateTime"),
        F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.lit(1.0)).alias("Value"),
    )


def sparse_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``history`` with the value missing (NULL) on every 'view' event."""
    e = _events(spark, sf_dir)
    return e.select(
        F.concat(F.lit("A20_WT_"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("TagName"),
        F.col("ts").alias("DateTime"),
        F.when(F.col("event_type") != "view", F.col("value").cast("double")).alias("Value"),
    )


def counter_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A growing totaliser per tag: running sum of the value, rounded to 2."""
    h = history(spark, sf_dir)
    r = running_sum(h, ["TagName"], ["DateTime"], "Value", "_total")
    return r.select("TagName", "DateTime", F.round(F.col("_total"), 2).alias("Value"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("TagName").distinct()


# Fixed values of the synthetic tag-name fixture (chosen by the data layout in
# FIXTURES.md): area code by p_partkey % 5, device by p_size % 6, suffix by
# p_partkey % 7.  An empty device means the part is left out of the name.
TAG_AREAS = ["A10", "A20", "A35", "A55", "X"]
TAG_DEVICES = ["WT", "FQT", "TT", "PMP", "CVR", ""]
TAG_SUFFIXES = ["_AH_", "_HI_", "_URS_", "_DRH_", "_TOT", "", "_S12"]


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    area = _pick(TAG_AREAS, F.col("p_partkey") % 5)
    dev = _pick(TAG_DEVICES, F.col("p_size") % 6)
    num = F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    suf = _pick(TAG_SUFFIXES, F.col("p_partkey") % 7)
    name = F.concat(F.concat_ws("_", area, F.nullif(dev, F.lit("")), num), suf)
    return p.select(name.alias("TagName")).distinct()


# Kinds of raw time text: (date and time pattern, fraction digits, minutes of offset
# from UTC or None, ending).  The thirteen layouts, then runs of blanks with a fraction.
RAW_TIME_KINDS = [
    ("yyyy-MM-dd HH:mm:ss", 0, None, ""), ("yyyy-MM-dd'T'HH:mm:ss", 0, None, "Z"), ("yyyy-MM-dd'T'HH:mm:ss", 0, None, ""),
    ("yyyy-MM-dd'T'HH:mm", 0, None, ""), ("dd.MM.yyyy HH:mm:ss", 0, None, ""), ("dd.MM.yyyy HH:mm", 0, None, ""),
    ("dd.MM.yyyy'T'HH:mm:ss", 0, None, "Z"), ("dd.MM.yyyy'T'HH:mm:ss", 0, None, ""), ("dd.MM.yyyy'T'HH:mm", 0, None, ""),
    ("yyyy-MM-dd'T'HH:mm:ss", 0, 330, "+05:30"), ("yyyy-MM-dd'T'HH:mm:ss", 1, -420, "-07:00"), ("yyyy-MM-dd'T'HH:mm:ss", 2, 0, "+00:00"),
    ("yyyy-MM-dd'T'HH:mm:ss", 3, 840, "+14:00"), ("yyyy-MM-dd   HH:mm:ss", 6, None, ""),
]
# Numbers and texts that are no times: out of range both ways, no date, empty.
RAW_TIME_BAD = ["500000000", "9e18", "2024-13-45 00:00:00", "2024-01-01 25:00:00", "31.02.2024 10:00", ""]


def raw_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times rendered as text, by event_id: every kind of RAW_TIME_KINDS, Excel day
    serial with a decimal comma (8 decimals, integer arithmetic), epoch milliseconds,
    the texts of RAW_TIME_BAD and other text."""
    e = _events(spark, sf_dir).withColumn("_us", epoch_us("ts"))
    excel = F.expr("concat(cast(_us div 86400000000L + 25569 as string), ',', "
                   "lpad(cast(pmod(_us, 86400000000L) * 100000000L div 86400000000L as string), 8, '0'))")
    forms = []
    for pattern, digits, minutes, end in RAW_TIME_KINDS:
        t = F.col("ts") if not minutes else F.timestamp_add("MINUTE", F.lit(minutes), F.col("ts"))
        parts = [F.date_format(t, pattern)]
        if digits:
            parts += [F.lit("."), F.substring(F.date_format(t, "SSSSSS"), 1, digits)]
        forms.append(F.concat(*parts, F.lit(end)))
    forms += [excel, F.expr("cast(_us div 1000L as string)"), *[F.lit(x) for x in RAW_TIME_BAD],
              F.concat(F.lit("bad-"), F.col("event_id").cast("string"))]
    k = F.col("event_id") % len(forms)
    raw = F.when(k == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        raw = raw.when(k == i, form)
    return e.select("event_id", raw.alias("raw"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event in three shapes (event_id % 3)."""
    e = _events(spark, sf_dir)
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    level = (F.when(F.col("event_type") == "error", "ERROR")
             .when(F.col("event_type") == "signup", "WARN").otherwise("INFO"))
    msg = F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))
    k = F.col("event_id") % 3
    line = (F.when(k == 0, F.concat(F.lit('{"time":"'), t, F.lit('","level":"'), level,
                                    F.lit('","msg":"'), msg, F.lit('"}')))
            .when(k == 1, F.concat(F.lit("time="), t, F.lit(" level="), F.lower(level),
                                   F.lit(' msg="'), msg, F.lit('"')))
            .otherwise(F.concat(msg, F.lit(" at "), t)))
    return e.select(F.col("event_id"), line.alias("value"))
