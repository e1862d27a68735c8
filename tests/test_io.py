import glob
import gzip
import json
import os
import tempfile

import pytest

from tagscope.plans import api
from tagscope.plans import templates as tpl
from tagscope.sinks import export as exp
from tagscope.sources import history as hs
from tagscope.sources import logs as lg
from tagscope.sources import testdata as td
from tagscope.streaming import ingest
from tests.conftest import SF_SMALL, hist

ROWS = [("A", "2024-01-01 00:00:00", 1.005), ("A", "2024-01-01 00:00:10", 2.5), ("B", "2024-01-01 00:00:00", float("nan"))]


def test_logs(spark):
    lines = ['{"time":"2024-01-01T00:00:07Z","level":"ERROR","msg":"boom"}',
             'time=2024-01-01T05:00:00+05:00 level=warn msg="quoted text"', "free text line", "",
             '{"other": 1}', "[1, 2]", "level=a level=b msg=x"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [tuple(r) for r in lg.parse_log_lines(df).collect()]
    assert len(got) == 6
    assert got[0][1:] == ("ERROR", "boom") and got[0][0].hour == 0
    assert got[1][0].hour == 0 and got[1][1:] == ("warn", "quoted text")
    assert got[2] == (None, "UNKNOWN", "free text line")
    assert got[3] == (None, None, None)                  # a JSON object without the keys
    assert got[4] == (None, "UNKNOWN", "[1, 2]")
    assert got[5][1:] == ("b", "x")


def test_exports(spark):
    h = hist(spark, ROWS)
    lines = sorted(r.value for r in exp.text_lines(h).collect())
    assert lines[0] == "A\t2024-01-01 00:00:00\t1" and lines[1] == "A\t2024-01-01 00:00:10\t2,5"
    js = {(r.name, r.date): r.value for r in exp.json_records(h).collect()}
    assert js[("B", "2024-01-01 00:00:00")] == 0.0
    by_time = {r.time: json.loads(r.json) for r in exp.grafana_by_time(h.filter("TagName = 'A'")).collect()}
    assert by_time["2024-01-01T00:00:00Z"]["data"] == [{"name": "A", "value": 1.0}]
    nan_json = json.loads(exp.grafana_by_time(h.filter("TagName = 'B'")).first().json)
    assert nan_json["data"] == [{"name": "B"}] or nan_json["data"] == [{"name": "B", "value": None}]
    assert "<TagName>A</TagName>" in exp.xml_rows(h).first().value
    out = tempfile.mkdtemp(prefix="tagscope-export-")
    for fmt in exp.FORMATS:
        exp.export(h, fmt, os.path.join(out, fmt))
        assert glob.glob(os.path.join(out, fmt, "part-*")) or glob.glob(os.path.join(out, fmt, "*.json"))
    xml = "".join(open(p).read() for p in glob.glob(os.path.join(out, "xml", "part-*")))
    assert "<data>" in xml and "<row>" in xml
    with pytest.raises(ValueError):
        exp.export(h, "html", os.path.join(out, "x"))


def test_templates(spark):
    td.history(spark, SF_SMALL).createOrReplaceTempView("history")
    t = tpl.template_table(spark, [("by_tag", "select TagName, count(*) n from history where TagName = '{tag}' group by TagName"),
                                   ("all", "select count(*) n from history"), ("other", "select 1")])
    assert sorted(r.Name for r in tpl.template_list(t, "by").collect()) == ["by_tag"]
    assert tpl.template_exec(spark, t, "by_tag", {"tag": "A20_WT_01"}).first().TagName == "A20_WT_01"
    assert tpl.template_exec(spark, t, "by_tag", {"tag": "x' or '1'='1"}).count() == 0   # bound, not spliced
    assert tpl.template_exec(spark, t, "all").first().n > 0
    with pytest.raises(KeyError):
        tpl.template_exec(spark, t, "by_tag", {})
    assert tpl.to_bound_sql("a = '{x}' and b = {y}") == ("a = :x and b = :y", ["x", "y"])
    t2 = tpl.template_table(spark, [("count_of", "select count(*) as n from {table} where TagName = '{tag}'")])
    n = tpl.template_exec(spark, t2, "count_of", {"table": "history", "tag": "A20_WT_01"}, identifiers=["table"]).first().n
    assert n == td.history(spark, SF_SMALL).filter("TagName = 'A20_WT_01'").count()
    assert tpl.exec_query(spark, "select :a + 1 as v", {"a": 1}).first().v == 2


def test_normalise_and_jdbc(spark):
    df = spark.createDataFrame([("t1", "2024-01-01 00:00:00", 1)], "t string, d string, v int")
    n = hs.normalize_history(df)
    assert n.columns == ["TagName", "DateTime", "Value"] and n.first().Value == 1.0
    two = spark.createDataFrame([("2024-01-01 00:00:00", 1.0)], "DataTime string, Value double")
    assert hs.normalize_history(two, tag="X").first().TagName == "X"
    with pytest.raises(ValueError):
        hs.normalize_history(two)
    with pytest.raises(ValueError):
        hs.normalize_history(spark.createDataFrame([(1,)], "a int"))
    o = hs.jdbc_options("mssql", "h", 1433, "Runtime", "u", "p", lower_bound="2024-01-01", upper_bound="2024-02-01")
    assert o["url"].startswith("jdbc:sqlserver://h:1433") and o["numPartitions"] == "64"
    with pytest.raises(ValueError):
        hs.jdbc_options("db2", "h", 1, "d", "u", "p")


def test_history_layout_roundtrip(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="tagscope-hist-"), "h")
    h = td.history(spark, SF_SMALL)
    hs.write_history(h, out)
    back = hs.read_history(spark, out)
    assert back.count() == h.count()
    assert "day=" in "".join(glob.glob(os.path.join(out, "*")))


def test_api_dispatch(spark):
    h = td.history(spark, SF_SMALL)
    assert api.get_tag(spark, h, "A20_WT_01, A20_WT_02", date="10.01.2024 00:00:00").count() == 2
    assert api.get_tag(spark, h, "A20_WT_01, A20_WT_02", date="10.01.2024 00:00:00", method="linear").count() == 2
    assert api.get_tag(spark, h, "A20_WT_01", date="10.01.2024 00:00:00", method="exact").count() == 0
    with pytest.raises(ValueError):
        api.get_tag(spark, h, "A20_WT_01", date="10.01.2024 00:00:00", method="nearest")
    n_tags = h.filter("DateTime <= '2024-01-01 23:00:00'").select("TagName").distinct().count()
    assert api.get_tag(spark, h, None, start="2024-01-01 00:00:00", end="2024-01-02 00:00:00", count=24).count() == n_tags * 24
    assert api.get_tag(spark, h, "A20_WT_01", start="2024-01-01 00:00:00", end="2024-01-02 00:00:00", group="AVG").count() == 1
    assert api.get_tag(spark, h, "A20_WT_01", start="2024-01-01 00:00:00", end="2024-01-02 00:00:00",
                       count=4, group="max").count() == 4
    assert api.get_tag(spark, h, "A20_WT_01", start="2024-01-01 00:00:00", end="2024-01-02 00:00:00").count() > 0
    with pytest.raises(ValueError):
        api.get_tag(spark, h, "x", date="12.31.2022 00:00:00")
    assert api.get_tag_list(h, "A20_WT_0*", page=1).count() == h.filter("TagName like 'A20_WT_0%'").select("TagName").distinct().count()
    assert api.get_down_dates(spark, td.state_history(spark, SF_SMALL), None, "2024-01-01 00:00:00",
                              "2024-02-01 00:00:00", count=0).count() > 0


def _gz(path, lines):
    with gzip.open(path, "wt") as fh:
        fh.write("\n".join(lines) + "\n")


def test_streaming_ingest(spark):
    base = tempfile.mkdtemp(prefix="tagscope-ingest-")
    src, sink, rej, ck = (os.path.join(base, x) for x in ("in", "sink", "rejects", "ckpt"))
    os.makedirs(src)
    _gz(os.path.join(src, "hs_1.json.gz"), ['{"TagName":"A","DateTime":"2024-01-01 00:00:00","Value":1.5}',
                                             '{"TagName":"B","DateTime":"2024-01-01 00:00:01","Value":2}',
                                             'not json at all'])
    _gz(os.path.join(src, "result_2.json.gz"), ['{"TagName":"A","DateTime":"2024-01-01 00:01:00","Value":3}',
                                                 '{"DateTime":"2024-01-01 00:01:00","Value":3}'])
    _gz(os.path.join(src, "av_1.json.gz"), ['{"DateTime":"2024-01-01 00:00:00","CertNum":"c1","Tare":1,"Brutto":2}'])
    _gz(os.path.join(src, "other.json.gz"), ['{"TagName":"Z","DateTime":"2024-01-01 00:00:00","Value":9}'])
    with open(os.path.join(src, "hs_broken.json.gz"), "wb") as fh:   # corrupt gzip: one reject, not fatal
        fh.write(gzip.compress(b'{"TagName":"Q","DateTime":"2024-01-01 00:00:00","Value":1}\n')[:10] + b"\x00junk" * 20)
    q = ingest.start_ingest(spark, src, sink, rej, ck)
    q.awaitTermination(120)
    assert ingest.read_ingested(spark, sink).count() == 3
    bad = spark.read.json(rej)
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "missing field", "unreadable file"]
    assert bad.filter("reason = 'unreadable file'").first().file.endswith("hs_broken.json.gz")
    assert ingest.load_mark(spark, sink).first().LoadMark.minute == 1
    q = ingest.start_ingest(spark, src, sink, rej, ck)          # nothing new: nothing added
    q.awaitTermination(120)
    assert ingest.read_ingested(spark, sink).count() == 3
    _gz(os.path.join(src, "hs_3.json.gz"), ['{"TagName":"C","DateTime":"2024-01-01 00:02:00","Value":4}'])
    q = ingest.start_ingest(spark, src, sink, rej, ck)
    q.awaitTermination(120)
    assert ingest.read_ingested(spark, sink).count() == 4
    from tagscope.operators import pointintime as pit
    h, r = ingest.read_ingested(spark, sink), ingest.read_ingested_tree(spark, sink)
    assert r.nodes.filter("parent = '2024-01'").count() == 3    # one row per (batch, tag, day)
    tags = ingest.read_ingested_dimension(spark, sink)
    assert sorted((x.TagName, x.source, x.records) for x in tags.collect()) == [("A", "hs", 1), ("A", "result", 1), ("B", "hs", 1), ("C", "hs", 1)]
    assert sorted(map(tuple, pit.value_at(h, "2024-01-02 00:00:00", tree=r).collect())) == \
        sorted(map(tuple, pit.value_at(h, "2024-01-02 00:00:00").collect()))
    # truck-scale drops go through the same job with their own schema
    tsink = os.path.join(base, "trucks")
    q = ingest.start_ingest(spark, src, tsink, os.path.join(base, "trej"), os.path.join(base, "tck"), kind="truck")
    q.awaitTermination(120)
    t = spark.read.parquet(tsink).first()
    assert (t.CertNum, t.Brutto) == ("c1", 2.0)


def test_truncated_drop_is_one_reject(spark):
    base = tempfile.mkdtemp(prefix="tagscope-truncated-")
    src, sink, rej, ck = (os.path.join(base, x) for x in ("in", "sink", "rejects", "ckpt"))
    os.makedirs(src)
    lines = [f'{{"TagName":"T{i}","DateTime":"2024-01-01 00:00:00","Value":{i * 7919 % 1000}}}' for i in range(3000)]
    whole = gzip.compress("\n".join(lines).encode())
    with open(os.path.join(src, "hs_cut.json.gz"), "wb") as fh:
        fh.write(whole[:len(whole) // 2])
    with open(os.path.join(src, "hs_two.json.gz"), "wb") as fh:      # two gzip members are one readable file
        fh.write(gzip.compress((lines[0] + "\n").encode()) + gzip.compress(lines[1].encode()))
    ingest.start_ingest(spark, src, sink, rej, ck, clean_source="archive").awaitTermination(120)
    assert sorted(r.TagName for r in ingest.read_ingested(spark, sink).collect()) == ["T0", "T1"]
    (bad,) = spark.read.json(rej).collect()
    assert bad.reason == "unreadable file" and bad.file.endswith("hs_cut.json.gz")
    _gz(os.path.join(src, "hs_next.json.gz"), [lines[2]])
    assert ingest.drain_ingest(spark, src, sink, rej, ck, clean_source="archive") == 1
    # finished drops move once a later step has begun, unreadable ones with them; none is lost
    assert {"hs_cut.json.gz", "hs_two.json.gz"} <= set(os.listdir(src + "_archive"))
    assert sorted(os.listdir(src + "_archive") + os.listdir(src)) == ["hs_cut.json.gz", "hs_next.json.gz", "hs_two.json.gz"]
    assert ingest.read_ingested(spark, sink).count() == 3
    with pytest.raises(ValueError):
        ingest.start_ingest(spark, src, sink, rej, ck, clean_source="delete")


def test_day_partition_pruning(spark):
    from tagscope.operators import pointintime as pit
    from tagscope.operators import resample as rs
    out = os.path.join(tempfile.mkdtemp(prefix="tagscope-prune-"), "h")
    hs.write_history(td.history(spark, SF_SMALL), out)
    h = hs.read_history(spark, out)
    df = rs.range_raw(h, "2024-01-05 00:00:00", "2024-01-06 00:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan
    want = td.history(spark, SF_SMALL).filter("DateTime >= '2024-01-05' and DateTime < '2024-01-06'").count()
    assert df.count() == want
    assert pit.value_at(h, "2024-01-10 00:00:00").count() == pit.value_at(td.history(spark, SF_SMALL), "2024-01-10 00:00:00").count()


def test_streaming_running_load_mark(spark):
    base = tempfile.mkdtemp(prefix="tagscope-mark-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    _gz(os.path.join(src, "hs_1.json.gz"), ['{"TagName":"A","DateTime":"2024-01-01 00:00:00","Value":1}',
                                             '{"TagName":"A","DateTime":"2024-01-03 00:00:00","Value":2}', "junk"])
    q = (ingest.running_load_mark(ingest.drop_stream(spark, src, os.path.join(base, "log"))).writeStream.outputMode("complete")
         .format("memory").queryName("tagscope_mark").option("checkpointLocation", os.path.join(base, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.sql("select LoadMark from tagscope_mark").first().LoadMark.day == 3


def test_checkpoint_dir_and_table_json(spark):
    from tagscope.session import checkpoint_dir
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Unset:
        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        checkpoint_dir(Unset)
    rows = [json.loads(r.value) for r in exp.json_table_rows(
        spark.createDataFrame([("a", 1, None)], "x string, n int, z double")).collect()]
    assert rows == [{"x": "a", "n": "1", "z": ""}]
    assert exp.table_text(spark.createDataFrame([("a", 1)], "x string, n int")).first().value == "a\t1"


def test_long_tag_list_semi_join(spark):
    from tagscope.operators import filters as flt
    h = td.history(spark, SF_SMALL)
    names = [f"A20_WT_{i:02d}" for i in range(3)] + [f"none_{i}" for i in range(1500)]
    got = flt.filter_tags(h, names)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == h.filter(h.TagName.isin(names[:3])).count()
    tags_df = spark.createDataFrame([("A20_WT_01",)], "TagName string")
    assert flt.filter_tags(h, tags_df).count() == h.filter("TagName = 'A20_WT_01'").count()


def test_api_up_dates_and_decode(spark):
    s = td.state_history(spark, SF_SMALL)
    ups = api.get_up_dates(spark, s, None, "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    first = api.get_up_dates(spark, s, None, "2024-01-01 00:00:00", "2024-02-01 00:00:00", count=0)
    assert ups.count() >= first.count() == ups.select("TagName").distinct().count()
    d = api.decode(spark.createDataFrame([("A20_WT_01",)], "TagName string")).first()
    assert (d.area, d.device_type_id, d.device_num) == ("20", "WT", "01")


def test_template_literals_and_functions(spark):
    t = tpl.template_table(spark, [
        ("like", "select count(*) as n from values ('x1'), ('x2'), ('y') as t(a) where a like '{x}%' and a <> '{q}' and a <> ':z'"),
        ("fn", "select {group} (a) as v from values (1), (5) as t(a) where a >= {lo}"),
        ("quote", "select concat('it''s {x}, ', '{x}') as v")])
    assert tpl.template_exec(spark, t, "like", {"x": "x", "q": "x2"}).first().n == 1
    assert tpl.template_exec(spark, t, "fn", {"group": "max", "lo": 0}).first().v == 5
    assert tpl.template_exec(spark, t, "quote", {"x": "o'k"}).first().v == "it's o'k, o'k"


def test_generic_results_and_nulls_in_files(spark):
    base = tempfile.mkdtemp(prefix="tagscope-export-")
    g = spark.createDataFrame([("a", 1), (None, 2)], "x string, n int")
    for fmt in ("json", "xml", "grafana", "csv", "text"):
        exp.export(g, fmt, os.path.join(base, fmt))
    assert sorted(spark.read.json(os.path.join(base, "json")).select("n", "x").collect()) == [("1", "a"), ("2", "")]
    h = hist(spark, [("A", "2024-01-01 00:00:00", None)])
    exp.export(h, "json", os.path.join(base, "null"))
    assert json.loads(spark.read.text(os.path.join(base, "null")).first().value)["value"] is None
