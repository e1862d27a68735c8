"""One plan for every size: shared exchanges, NULL tags, long gaps, odd texts."""

import datetime as dt

from pyspark.sql import functions as F

from tagscope.functions import timeparse as tp
from tagscope.functions.timecols import to_datetime
from tagscope.operators import aggregate as agg
from tagscope.operators import buckets as bk
from tagscope.operators import events as ev
from tagscope.operators import pointintime as pit
from tagscope.operators import resample as rs
from tagscope.operators.chunked import explode_span
from tagscope.plans import catalog
from tests.conftest import SF_SMALL, hist

S, E = "2024-01-01 00:00:00", "2024-01-01 01:00:00"


def plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_reduction_is_shuffled_once(spark):
    # as-of queries read the history once and the summary tree once
    for name, scans in (("group_filled", 1), ("values_n_instants", 2), ("buckets_filled", 1), ("range_cyclic", 2)):
        df = catalog.QUERIES[name](spark, SF_SMALL)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in text, name
        assert "existingrdd" not in text.lower()      # nothing was materialised on the way
        assert text.count("FileScan") == scans, name


def test_null_tags_belong_to_no_series(spark):
    h = hist(spark, [("A", "2024-01-01 00:00:01", 1), (None, "2024-01-01 00:00:02", 5), (None, "2024-01-01 00:10:02", 0)])
    results = [agg.aggregate(h, S, E, g, m) for g in ("avg", "count", "dif", "avgm") for m in agg.MODES]
    results += [bk.buckets(h, S, E, 3, "avg", m) for m in agg.MODES]
    results += [pit.value_at(h, E), pit.values_at_instants(h, S, E, 4), pit.values_cyclic(h, S, E), rs.range_raw(h, S, E),
                rs.resample(h, S, E), ev.down_events(h, S, E)]
    for df in results:
        assert {r.TagName for r in df.select("TagName").collect()} <= {"A"}


def test_year_long_gap(spark):
    h = hist(spark, [("A", "2023-01-01 00:00:00", 1), ("A", "2024-01-01 00:00:00", 3)])
    d = rs.resample(h, "2023-01-01 00:00:00", "2024-01-01 00:00:00", seeded=False).agg(F.count("*"), F.sum("Value")).first()
    assert tuple(d) == (365 * 86400 + 1, 365 * 86400.0 + 3)


def test_explode_span(spark):
    df = spark.createDataFrame([(0, 0), (5, 4), (-3, 9000), (4095, 4096)], "a long, b long")
    got = explode_span(df, F.col("a"), F.col("b"), "x").groupBy("a").agg(F.count("*"), F.min("x"), F.max("x")).collect()
    assert sorted(map(tuple, got)) == [(-3, 9004, -3, 9000), (0, 1, 0, 0), (4095, 2, 4095, 4096)]


def test_texts_out_of_range_and_offsets(spark):
    texts = ["500000000", "999999999", "9e18", "1e300", "-9e18", "44926,0", "2023-10-27T21:00:00+05:00", "2023-10-27T21:00:00.123-07:00",
             "2023-10-27T21:00", "27.10.2023 21:00", "27.10.2023T21:00:00Z", "1698440400000", "bad"]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = {r.raw: (r.DateTime, r.error) for r in tp.normalise_times(df).collect()}
    for t in texts[:5]:
        assert got[t] == (None, tp.ERR_INVALID_DATE), t
    assert got["44926,0"][0] == dt.datetime(2022, 12, 31)
    assert got["2023-10-27T21:00:00+05:00"][0] == dt.datetime(2023, 10, 27, 16)
    assert got["2023-10-27T21:00:00.123-07:00"][0] == dt.datetime(2023, 10, 28, 4, 0, 0, 123000)
    for t in ("2023-10-27T21:00", "27.10.2023 21:00", "27.10.2023T21:00:00Z", "1698440400000"):
        assert got[t][0] == dt.datetime(2023, 10, 27, 21), t
    assert got["bad"] == (None, tp.ERR_NOT_A_FLOAT)


def test_request_times_with_offsets():
    assert to_datetime("2024-01-10T00:00:00+05:00") == dt.datetime(2024, 1, 9, 19)
    assert to_datetime(dt.datetime(2024, 1, 10, tzinfo=dt.timezone(dt.timedelta(hours=-2)))) == dt.datetime(2024, 1, 10, 2)
    assert to_datetime("2024-01-10 00:00:00") == dt.datetime(2024, 1, 10)
