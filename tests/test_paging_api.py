"""Pages by located partitions; formats, rounding and the mark on requests."""
import json

import pytest
from pyspark.sql import functions as F

from tagscope.operators import paging as pg
from tagscope.operators import tree as tr
from tagscope.plans import api
from tagscope.sinks import export as exp
from tests.conftest import hist


def test_near_pages_against_slices(spark):
    df = spark.range(100).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("TagName")).repartition(5)
    names = [f"t{i:03d}" for i in range(100)]
    for per, p in ((23, 1), (23, 4), (23, 5), (23, 9), (7, 15), (7, 16), (100, 1), (100, 2), (1, 100), (1, 101)):
        at = min(p, -(-100 // per))
        assert [r.TagName for r in pg.page(df, ["TagName"], p, per).collect()] == names[(at - 1) * per:at * per], (per, p)
    assert pg.page(df, ["TagName"], 9, 23, clamp=False).count() == 0
    assert pg.page(df.limit(0), ["TagName"], 3).count() == 0


def test_page_50_000(spark):
    n = 1_300_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.lit(1).alias("same"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pager = pg.Pager(df, ["k"])
        assert (pager.total, pager.pages) == (n, -(-n // 23))
        assert max(stop - start for _, start, stop in pager.starts) < n / 2
        for p in (1, 50_000, pager.pages, pager.pages + 5):
            rows = pager.page(p)
            at = min(p, pager.pages)
            assert [r.k for r in rows.collect()] == list(range((at - 1) * 23, min(at * 23, n)))
            assert len({f.split("_part=")[1].split("/")[0] for f in rows.inputFiles()}) <= len(pager.starts)
            scanned = rows._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(_part" in scanned or "PartitionFilters: [_part" in scanned
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.k for r in pg.page(df, ["k"], 50_000).collect()] == list(range(49_999 * 23, 50_000 * 23))
    one_key = pg.Pager(spark.range(5000).select(F.lit("x").alias("k"), "id"), ["k"], 10)
    assert [r.id for r in one_key.page(300).collect()] == list(range(2990, 3000))


ROWS = [("A", "2024-01-01 00:00:00", 1.005), ("A", "2024-01-01 00:10:00", 2.125), ("B", "2024-01-01 00:05:00", -0.5)]


def test_formats_and_round(spark):
    h = hist(spark, ROWS)
    def lines(fmt, **kw):
        return sorted(r.value for r in api.get_tag(spark, h, "A,B", date="2024-01-01 01:00:00", guard=False, format=fmt, **kw).collect())
    assert lines("text") == ["A\t2024-01-01 00:10:00\t2,13", "B\t2024-01-01 00:05:00\t-0,5"]
    assert lines("text", round="1") == ["A\t2024-01-01 00:10:00\t2,1", "B\t2024-01-01 00:05:00\t-0,5"]
    assert [json.loads(x) for x in lines("json", round="none")] == [{"name": "A", "date": "2024-01-01 00:10:00", "value": 2.13},
                                                                  {"name": "B", "date": "2024-01-01 00:05:00", "value": -0.5}]
    assert "<Value>2,13</Value>" in lines("XML")[0]
    assert lines("csv", round=0) == ['"A","2024-01-01 00:10:00","2.0"', '"B","2024-01-01 00:05:00","-1.0"']
    assert json.loads(lines("grafana")[0]) == {"time": "2024-01-01T00:05:00Z", "data": [{"name": "B", "value": -0.5}]}
    with pytest.raises(ValueError):
        lines("html")


def test_guard_reads_the_given_mark(spark):
    h = hist(spark, ROWS)
    mark = spark.createDataFrame([("2024-01-01 00:10:00",)], "LoadMark string").select(F.col("LoadMark").cast("timestamp_ntz"))
    def at(when, **kw):
        return {r.TagName: r.Value for r in api.get_tag(spark, h, None, date=when, mark=mark, **kw).collect()}
    assert at("2024-01-01 00:10:00") == {"A": 2.125, "B": -0.5} and at("2024-01-01 00:10:01") == {"A": None, "B": None}
    tree = tr.SummaryTree(tr.tree_nodes(h))
    assert at("2024-01-01 00:10:00", tree=tree) == {"A": 2.125, "B": -0.5}
    n = api.get_tag(spark, h, "A", start="2024-01-01 00:00:00", end="2024-01-01 00:20:00", count=4, mark=mark)
    assert [r.Value for r in n.orderBy("DateTime").collect()] == [1.005, 1.005, 2.125, None]


def test_generic_result_as_headers_and_rows(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "x\"y").alias("s")).repartition(4)
    (w,) = exp.write_json_table(df, str(tmp_path / "t")).collect()
    doc = json.load(open(w.file))
    assert doc["headers"] == ["n", "s"] and len(doc["rows"]) == 1000
    assert sorted(doc["rows"], key=lambda r: int(r[0]))[:2] == [["0", "x\"y"], ["1", ""]]
