"""Export of results (EXP1-7).  Rounding (COL2) is applied here, never inside aggregates.

Every writer is a distributed Spark write; nothing passes through the driver.
Outputs that are one document per tag (chart series, time map, XML) go through the
ordered document writer (``sinks.documents``): their points are rows until the
document is a file, so no row grows with the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagscope.functions.numbers import DEFAULT_ROUND, decimal_comma, plain_text, round_half_away
from tagscope.functions.timecols import epoch_us
from tagscope.sinks.documents import write_documents

DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"
# missing values are written as null rather than dropped from the object
JSON_OPTIONS = {"ignoreNullFields": "false"}

FORMATS = ("text", "json", "xml", "csv", "grafana", "series", "map")


def _date(col: str = "DateTime") -> Column:
    return F.date_format(F.col(col), DATE_FORMAT)


def _value(r: int | None) -> Column:
    v = F.col("Value")
    return v if r is None else round_half_away(v, r)


def _json_value(r: int | None) -> Column:
    """Value for chart JSON: NaN has no JSON form and becomes null."""
    return F.nanvl(_value(r), F.lit(None).cast("double"))


def text_lines(df: DataFrame, r: int | None = DEFAULT_ROUND, decimal_mark: str = ",") -> DataFrame:
    """EXP1: ``tag TAB time TAB value`` lines (decimal comma by default)."""
    v = _value(r)
    txt = decimal_comma(v) if decimal_mark == "," else plain_text(v)
    return df.select(F.concat_ws("\t", F.col("TagName"), _date(), txt).alias("value"))


def table_text(df: DataFrame) -> DataFrame:
    """EXP1 for generic (template) results: tab-separated cells, all as text."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def write_text(df: DataFrame, path: str, r: int | None = DEFAULT_ROUND, decimal_mark: str = ",",
               header: bool = False) -> None:
    if header or "TagName" not in df.columns:
        df.write.mode("overwrite").option("header", header).option("sep", "\t").csv(path)
    else:
        text_lines(df, r, decimal_mark).write.mode("overwrite").text(path)


def json_records(df: DataFrame, r: int | None = DEFAULT_ROUND) -> DataFrame:
    """EXP2: ``{name, date, value}`` records, NaN written as 0."""
    v = F.nanvl(_value(r), F.lit(0.0))
    return df.select(F.col("TagName").alias("name"), _date().alias("date"), v.alias("value"))


def json_table_rows(df: DataFrame) -> DataFrame:
    """EXP2 for generic (template) results: one JSON object per row, cells as
    text (the reference's headers+rows form, without one record that holds
    the whole result)."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cells)).alias("value"))


def write_json(df: DataFrame, path: str, r: int | None = DEFAULT_ROUND) -> None:
    """EXP2 of a tag result; of a generic result, one object per row.  NULL
    values are written as null."""
    if "TagName" in df.columns:
        json_records(df, r).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        json_table_rows(df).write.mode("overwrite").text(path)


def _xml_row(r: int | None) -> F.Column:
    s = F.struct(F.col("TagName"), _date().alias("DateTime"), decimal_comma(_value(r)).alias("Value"))
    return F.to_xml(s, {"rowTag": "row"})


def write_xml(df: DataFrame, path: str, r: int | None = DEFAULT_ROUND) -> None:
    """EXP3: ``<data><row><TagName/><DateTime/><Value/></row>...</data>`` with a
    decimal comma; every part file is a document."""
    out = df.select("TagName", _date().alias("DateTime"), decimal_comma(_value(r)).alias("Value"))
    out.write.mode("overwrite").format("xml").option("rootTag", "data").option("rowTag", "row").save(path)


def xml_rows(df: DataFrame, r: int | None = DEFAULT_ROUND) -> DataFrame:
    """EXP3 per row, as text (``to_xml``)."""
    return df.select(_xml_row(r).alias("value"))


def write_xml_documents(df: DataFrame, path: str, r: int | None = DEFAULT_ROUND) -> DataFrame:
    """EXP3 as one ordered document per tag."""
    pieces = df.select(F.col("TagName").alias("doc"), F.col("DateTime").alias("at"), _xml_row(r).alias("piece"))
    return write_documents(pieces, path, F.lit("<data>\n"), "\n", "\n</data>", ".xml")


def write_csv(df: DataFrame, path: str) -> None:
    """EXP6: CSV with header, every field quoted."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def rfc3339(col: str = "DateTime") -> Column:
    """The instant with as many fraction digits as it has, in UTC."""
    c = F.col(col)
    fraction = F.rtrim(F.date_format(c, "SSSSSS"), F.lit("0"))
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def grafana_by_time(df: DataFrame, r: int | None = DEFAULT_ROUND) -> DataFrame:
    """EXP4: one record per instant: ``{time, data: [{name, value}]}``.

    A record holds one point per tag at that instant, so it is bounded by the
    number of tags, not by the history.
    """
    pts = df.select("DateTime", F.struct(F.col("TagName").alias("name"), _json_value(r).alias("value")).alias("p"))
    g = pts.groupBy("DateTime").agg(F.sort_array(F.collect_list("p")).alias("data")).withColumn("time", rfc3339())
    return g.select("time", F.to_json(F.struct("time", "data"), JSON_OPTIONS).alias("json"))


def _json_text(c: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'^\{"s":(.*)\}$', 1)


def series_points(df: DataFrame, r: int | None = DEFAULT_ROUND) -> DataFrame:
    """(doc, at, piece) of EXP5: ``[value, epoch ms]`` pairs; a missing value is null."""
    v = _json_value(r)
    ms = F.floor(epoch_us("DateTime") / F.lit(1000)).cast("long").cast("string")
    return df.select(F.col("TagName").alias("doc"), F.col("DateTime").alias("at"),
                     F.concat(F.lit("["), F.coalesce(F.when(F.abs(v) < float("inf"), plain_text(v)), F.lit("null")), F.lit(","), ms, F.lit("]")).alias("piece"))


def write_grafana_series(df: DataFrame, path: str, r: int | None = DEFAULT_ROUND) -> DataFrame:
    """EXP5: one document ``{"target": tag, "datapoints": [[value, ms], ...]}`` per tag."""
    head = F.concat(F.lit('{"target":'), _json_text(F.col("doc")), F.lit(',"datapoints":['))
    return write_documents(series_points(df, r), path, head, ",", "]}", ".json")


def map_entries(df: DataFrame, r: int | None = DEFAULT_ROUND) -> DataFrame:
    """(doc, at, piece) of EXP7: ``"time":"value"`` with a decimal comma, a missing
    value null.  Points of one second are averaged first, since keys are unique."""
    second = F.date_trunc("second", "DateTime").cast("timestamp_ntz")
    per = df.groupBy("TagName", second.alias("DateTime")).agg(F.avg("Value").alias("Value"))
    text = F.when(F.col("Value").isNotNull(), F.concat(F.lit('"'), decimal_comma(_value(r)), F.lit('"'))).otherwise("null")
    return per.select(F.col("TagName").alias("doc"), F.col("DateTime").alias("at"),
                      F.concat(F.lit('"'), _date(), F.lit('":'), text).alias("piece"))


def write_tag_time_maps(df: DataFrame, path: str, r: int | None = DEFAULT_ROUND) -> DataFrame:
    """EXP7: one document ``{tag: {time: value, ...}}`` per tag."""
    head = F.concat(F.lit("{"), _json_text(F.col("doc")), F.lit(":{"))
    return write_documents(map_entries(df, r), path, head, ",", "}}", ".json")


def read_documents(written: DataFrame, path: str, suffix: str = ".json") -> DataFrame:
    """(doc, text) of written documents, each as one value: for small results."""
    texts = written.sparkSession.read.option("pathGlobFilter", "*" + suffix).text(path, wholetext=True) \
        .select(F.element_at(F.split("_metadata.file_name", "/"), -1).alias("_name"), F.col("value").alias("text"))
    names = written.select("doc", F.element_at(F.split("file", "/"), -1).alias("_name"))
    return names.join(texts, "_name").select("doc", "text")


def rows_as(df: DataFrame, fmt: str, r: int | None = DEFAULT_ROUND) -> DataFrame:
    """A tag result as text rows (``value``) of a named format: one line, object, XML
    row, CSV line, or chart instant each."""
    fmt = (fmt or "text").lower()
    if fmt == "text":
        return text_lines(df, r)
    if fmt == "json":
        return json_records(df, r).select(F.to_json(F.struct("name", "date", "value"), JSON_OPTIONS).alias("value"))
    if fmt == "xml":
        return xml_rows(df, r)
    if fmt == "csv":
        return df.select(F.to_csv(F.struct("TagName", _date().alias("DateTime"), _value(r).alias("Value")), {"quoteAll": "true"}).alias("value"))
    if fmt == "grafana":
        return grafana_by_time(df, r).select(F.col("json").alias("value"))
    raise ValueError(f"formatter '{fmt}' not found")


def write_json_table(df: DataFrame, path: str) -> DataFrame:
    """EXP2 of a generic result as one document ``{"headers": [...], "rows": [[...], ...]}``
    of text cells, rows in the order Spark holds them."""
    cells = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))
    pieces = df.select(F.lit("table").alias("doc"), F.monotonically_increasing_id().alias("at"), cells.alias("piece"))
    head = F.concat(F.lit('{"headers":'), F.to_json(F.array(*[F.lit(c) for c in df.columns])), F.lit(',"rows":['))
    return write_documents(pieces, path, head, ",", "]}", ".json")


def export(df: DataFrame, fmt: str, path: str, r: int | None = DEFAULT_ROUND) -> None:
    """Write ``df`` in a named format (text is the default, as in the reference)."""
    fmt = (fmt or "text").lower()
    if fmt == "text":
        write_text(df, path, r)
    elif fmt == "json":
        write_json(df, path, r)
    elif fmt == "xml" and "TagName" not in df.columns:
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
        df.select(*cells).write.mode("overwrite").format("xml").option("rootTag", "data").option("rowTag", "row").save(path)
    elif fmt == "xml":
        write_xml(df, path, r)
    elif fmt == "csv":
        write_csv(df, path)
    elif fmt == "grafana" and "TagName" not in df.columns:
        json_table_rows(df).write.mode("overwrite").text(path)
    elif fmt == "grafana":
        grafana_by_time(df, r).select("json").write.mode("overwrite").text(path)
    elif fmt == "series":
        write_grafana_series(df, path, r)
    elif fmt == "map":
        write_tag_time_maps(df, path, r)
    else:
        raise ValueError(f"formatter '{fmt}' not found")
