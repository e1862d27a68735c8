import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagscope.operators import chunked
from tagscope.operators import events as ev
from tagscope.sources import testdata as td
from tests import bruteforce as bf
from tests.conftest import SF_SMALL, hist

S, E = "2024-01-01 00:00:00", "2024-01-01 01:00:00"

CASES = [
    ("first0", "2024-01-01 00:00:10", 0), ("first0", "2024-01-01 00:00:20", 0), ("first0", "2024-01-01 00:00:30", 1),
    ("flip", "2024-01-01 00:00:10", 1), ("flip", "2024-01-01 00:05:00", 0), ("flip", "2024-01-01 00:06:00", 1),
    ("flip", "2024-01-01 00:07:00", 0), ("flip", "2024-01-01 00:08:00", 0),
    ("other", "2024-01-01 00:01:00", 2), ("other", "2024-01-01 00:02:00", 0), ("other", "2024-01-01 00:03:00", 2),
    ("before", "2023-12-31 23:59:00", 0), ("before", "2024-01-01 00:10:00", 0),
]


def test_down_up_cases(spark, small_chunks):
    h = hist(spark, CASES)
    down = sorted((r.TagName, r.DateTime) for r in ev.down_events(h, S, E).collect())
    up = sorted((r.TagName, r.DateTime) for r in ev.up_events(h, S, E).collect())
    assert down == bf.transitions(CASES, S, E, 0.0)
    assert up == bf.transitions(CASES, S, E, 1.0)
    assert ("before", bf.D("2024-01-01 00:10:00")) in down   # state before `from` is not seen
    assert [d for t, d in down if t == "flip"] == [bf.D("2024-01-01 00:05:00"), bf.D("2024-01-01 00:07:00")]


@pytest.mark.parametrize("use_chunks", [False, True])
def test_nth_event(spark, monkeypatch, use_chunks):
    if use_chunks:
        monkeypatch.setattr(chunked, "DEFAULT_CHUNK_SECONDS", 60)
    h = hist(spark, CASES)
    e = ev.down_events(h, S, E)
    assert [(r.TagName, r.DateTime) for r in ev.nth_event(e, 1).collect()] == [("flip", bf.D("2024-01-01 00:07:00"))]
    assert ev.nth_event(e, "bad").count() == ev.nth_event(e, 0).count() == 4
    assert ev.nth_event(e, 9).count() == 0


def test_chunked_lag_equals_plain_window(spark, small_chunks):
    h = td.state_history(spark, SF_SMALL)
    got = ev.with_previous(h).select("TagName", "DateTime", "prev_Value", "prev_DateTime")
    w = Window.partitionBy("TagName").orderBy("DateTime")
    want = h.select("TagName", "DateTime", F.lag("Value").over(w).alias("prev_Value"),
                    F.lag("DateTime").over(w).alias("prev_DateTime"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_running_sum_and_nth_row_vs_pandas(spark, small_chunks):
    h = td.history(spark, SF_SMALL)
    got = chunked.running_sum(h, ["TagName"], ["DateTime"], "Value", "total").toPandas()
    pdf = h.toPandas().sort_values(["TagName", "DateTime"])
    pdf["total"] = pdf.groupby("TagName")["Value"].cumsum()
    m = got.merge(pdf, on=["TagName", "DateTime"], suffixes=("", "_want"))
    assert len(m) == len(pdf) and ((m.total - m.total_want).abs() < 1e-6).all()
    third = chunked.nth_row(h, ["TagName"], ["DateTime"], 3).toPandas()
    want = pdf.groupby("TagName").nth(3)
    assert sorted(zip(third.TagName, third.DateTime)) == sorted(zip(want.TagName, want.DateTime))


def test_fill_forward_and_hold(spark, small_chunks):
    rows = [("A", "2024-01-01 00:00:00", 1), ("A", "2024-01-01 00:02:00", None), ("A", "2024-01-01 00:05:00", None),
            ("A", "2024-01-01 00:06:00", 4), ("A", "2024-01-01 00:09:00", None), ("B", "2024-01-01 00:00:00", None)]
    got = sorted((r.TagName, r.DateTime.minute, r.Value) for r in ev.hold_previous(hist(spark, rows)).collect())
    assert got == [("A", 0, 1.0), ("A", 2, 1.0), ("A", 5, 1.0), ("A", 6, 4.0), ("A", 9, 4.0), ("B", 0, None)]


def test_neighbour_next(spark, small_chunks):
    h = td.history(spark, SF_SMALL)
    got = chunked.neighbour(h, ["TagName"], "DateTime", ["DateTime"], direction=+1).toPandas()
    pdf = h.toPandas().sort_values(["TagName", "DateTime"])
    pdf["nxt"] = pdf.groupby("TagName")["DateTime"].shift(-1)
    m = got.merge(pdf, on=["TagName", "DateTime"])
    assert len(m) == len(pdf)
    assert ((m.next_DateTime == m.nxt) | (m.next_DateTime.isna() & m.nxt.isna())).all()
    assert isinstance(pd.__version__, str)


def test_adaptive_chunks_equal_plain_window(spark, monkeypatch):
    # tiny target: dense tags get 1-second-scale chunks, sparse ones wide chunks
    monkeypatch.setattr(chunked, "ADAPTIVE_TARGET_ROWS", 3)
    h = td.history(spark, SF_SMALL)
    got = ev.with_previous(h).select("TagName", "DateTime", "prev_Value")
    w = Window.partitionBy("TagName").orderBy("DateTime")
    want = h.select("TagName", "DateTime", F.lag("Value").over(w).alias("prev_Value"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    rs = chunked.running_sum(h, ["TagName"], ["DateTime"], "Value", "t").toPandas()
    pdf = h.toPandas().sort_values(["TagName", "DateTime"])
    pdf["t"] = pdf.groupby("TagName")["Value"].cumsum()
    m = rs.merge(pdf, on=["TagName", "DateTime"])
    assert len(m) == len(pdf) and ((m.t_x - m.t_y).abs() < 1e-6).all()
    widths = {r.TagName: r._w for r in chunked.chunk_widths(h, ["TagName"], "DateTime", 3).collect()}
    assert min(widths.values()) >= 1 and max(widths.values()) <= chunked.MAX_CHUNK_SECONDS


def test_hot_tag_is_split_into_bounded_chunks(spark, monkeypatch):
    """One tag holding every row: adaptive chunks keep each window partition small."""
    monkeypatch.setattr(chunked, "ADAPTIVE_TARGET_ROWS", 20)
    hot = td.history(spark, "/root/testdata/sf0.01").withColumn("TagName", F.lit("HOT"))
    d = chunked.with_chunk(hot, ["TagName"], "DateTime")
    sizes = d.groupBy("TagName", chunked.CK).count()
    total, biggest, parts = hot.count(), sizes.agg(F.max("count")).first()[0], sizes.count()
    assert parts > 100 and biggest <= 10 * 20 and biggest < total / 50
    got = ev.with_previous(hot).select("DateTime", "prev_DateTime")
    w = Window.partitionBy("TagName").orderBy("DateTime")
    want = hot.select("DateTime", F.lag("DateTime").over(w).alias("prev_DateTime"))
    assert got.exceptAll(want).count() == 0
