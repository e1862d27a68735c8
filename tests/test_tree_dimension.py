"""Summary tree, tag dimension, dealt-out grids and ordered documents."""
import datetime as dt
import json
import os
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tagscope.operators import aggregate as agg
from tagscope.operators import buckets as bk
from tagscope.operators import chunked
from tagscope.operators import pointintime as pit
from tagscope.operators import resample as rs
from tagscope.operators import tree as tr
from tagscope.sinks import export as exp
from tagscope.sources.history import read_history, write_history
from tagscope.streaming import dimension as dim
from tests.conftest import hist, rows_of


@pytest.fixture(scope="module")
def years(spark):
    """Samples over four years, some days and a year without any, ties, NULL values."""
    rng = random.Random(4)
    rows = []
    for tag, n in (("A", 300), ("B", 60), ("C", 1)):
        for _ in range(n):
            t = dt.datetime(2021, 1, 1) + dt.timedelta(seconds=rng.randrange(4 * 365 * 86400))
            if t.year != 2022:
                rows.append((tag, t.isoformat(sep=" "), rng.random()))
    rows += [("A", "2023-05-05 05:05:05", 1.0), ("A", "2023-05-05 05:05:05", 3.0), ("A", "2023-05-05 05:05:05", 2.0), ("B", "2023-12-31 23:59:59", None)]
    return hist(spark, rows).persist()


INSTANTS = ["2020-01-01 00:00:00", "2021-01-01 00:00:00", "2022-06-15 12:00:00", "2023-01-01 00:00:00", "2023-05-05 05:05:05",
            "2023-12-31 23:59:59", "2024-03-01 00:00:00", "2030-01-01 00:00:00"]


def plain_at(rows, at):
    """tag -> (last at or before, first at or after); ties take the largest value."""
    at, out = dt.datetime.fromisoformat(at), {}
    for tag in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == tag]
        key = lambda r: (r[1], r[2] is not None, r[2] or 0)
        before = max((r for r in mine if r[1] <= at), key=key, default=None)
        after = min((r for r in mine if r[1] >= at), key=lambda r: (r[1], r[2] is None, -(r[2] or 0)), default=None)
        out[tag] = (before, after)
    return out


def test_nearest_samples_against_plain(spark, years):
    rows = [tuple(r) for r in years.collect()]
    tree = tr.SummaryTree(tr.tree_nodes(years))
    for at in INSTANTS:
        got = {r.TagName: r for r in tr.at_instant(tr.around_source(years, [at], tree), at, after=True).collect()}
        for tag, (b, a) in plain_at(rows, at).items():
            r = got.get(tag)
            assert (None if b is None else b[1:]) == (None if r is None or r.b_DateTime is None else (r.b_DateTime, r.b_Value)), (tag, at)
            assert (None if a is None else a[1:]) == (None if r is None or r.a_DateTime is None else (r.a_DateTime, r.a_Value)), (tag, at)
        assert rows_of(pit.value_at(years, at, tree=tree)) == rows_of(spark.createDataFrame(
            [(t, b[1], b[2]) for t, (b, _) in plain_at(rows, at).items() if b], "a string, b timestamp_ntz, c double"))


def test_a_point_reads_few_nodes_and_one_day(spark, years, tmp_path):
    write_history(years, str(tmp_path / "h"))
    tr.write_tree(years, str(tmp_path / "t"))
    h, tree = read_history(spark, str(tmp_path / "h")), tr.read_tree(spark, str(tmp_path / "t"))
    for at in INSTANTS:
        rows = tr.around_source(h, [at], tree)
        files = {f.split("/t/")[1].split("/")[0] for f in rows.inputFiles() if "/t/" in f}
        assert rows.groupBy("TagName").count().agg(F.max("count")).first()[0] <= 4 + 11 + 30 + 4
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("PartitionFilters: [parent") == 2 and "PartitionFilters: [isnotnull(day" in plan, plan
        assert len(files) >= 1
    wide = pit.value_interpolated(h, "2024-03-01 00:00:00", tree=tree)
    assert rows_of(wide) == rows_of(pit.value_interpolated(years, "2024-03-01 00:00:00"))


def test_tree_merges_batches_replays_and_compaction(spark, years, tmp_path):
    path = str(tmp_path / "tree")
    parts = [years.filter(F.pmod(F.hash("DateTime"), F.lit(3)) == i) for i in range(3)]
    for batch, rows in [(0, parts[0]), (1, parts[1]), (1, parts[1]), (2, parts[2]), (0, parts[0])]:       # late and replayed
        tr.write_tree(rows, path, batch)
    want = sorted(map(str, tr.tree_nodes(years).collect()))
    assert sorted(map(str, tr.compacted(tr.read_tree(spark, path)).select("parent", *tr.NODE_COLUMNS).collect())) \
        == sorted(map(str, tr.tree_nodes(years).select("parent", *tr.NODE_COLUMNS).collect())) and len(want) > 0
    tr.compact(spark, path, str(tmp_path / "small"))
    small = tr.read_tree(spark, str(tmp_path / "small"))
    assert small.nodes.count() == tr.tree_nodes(years).count()
    tr.write_tree(parts[2], str(tmp_path / "small"), 2)              # a batch it already holds
    for at in INSTANTS:
        assert rows_of(pit.value_at(years, at, tree=tr.read_tree(spark, str(tmp_path / "small")))) == \
            rows_of(pit.value_at(years, at, tree=tr.SummaryTree(tr.tree_nodes(years))))


def test_seeded_operators_agree_with_and_without_tree(spark, years):
    tree = tr.SummaryTree(tr.tree_nodes(years))
    once = years.groupBy("TagName", "DateTime").agg(F.max("Value").alias("Value")).persist()
    otree = tr.SummaryTree(tr.tree_nodes(once))
    for a, b in [("2022-03-01 00:00:00", "2023-03-01 00:00:00"), ("2023-05-05 05:05:05", "2023-05-05 05:05:05")]:
        for mode in ("seeded", "cyclic"):
            assert rows_of(agg.aggregate(once, a, b, "avg", mode=mode, tree=otree), 6) == rows_of(agg.aggregate(once, a, b, "avg", mode=mode), 6)
        assert rows_of(agg.aggregate(once, a, b, "dif", tree=otree)) == rows_of(agg.aggregate(once, a, b, "dif"))
        assert rows_of(rs.resample(once, a, b, 86400, tree=otree)) == rows_of(rs.resample(once, a, b, 86400))
    assert tree.nodes.columns == ["parent", *tr.NODE_COLUMNS]


def plain_seeded(rows, a, b, step):
    """RNG2 slot by slot: in-range samples, the last value at or before each bound at
    that bound, mean per slot, held until the next one."""
    zero = dt.datetime(1970, 1, 1)
    lo, hi = (int((dt.datetime.fromisoformat(x) - zero).total_seconds()) for x in (a, b))
    out = []
    for tag in {r[0] for r in rows}:
        mine = sorted([(((r[1] - zero).total_seconds()), r[2]) for r in rows if r[0] == tag])
        pts = [p for p in mine if lo <= p[0] <= hi]
        for edge in (lo, hi):
            past = [p for p in mine if p[0] <= edge]
            if past:
                pts.append((edge, past[-1][1]))
        slots = {}
        for t, v in pts:
            slots.setdefault(int(t // step), []).append(v)
        mean = {s: (sum(x for x in v if x is not None) / len([x for x in v if x is not None]) if any(x is not None for x in v) else None)
                for s, v in slots.items()}
        held = None
        for s in range(min(mean), max(mean) + 1) if mean else []:
            held = mean.get(s, held) if s in mean else held
            out.append((tag, zero + dt.timedelta(seconds=s * step), None if held is None else round(held, 9)))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_seeded_series_against_plain(spark, small_chunks):
    rows = [("A", "2024-01-01 00:00:00.2", 1.0), ("A", "2024-01-01 00:00:00.7", 2.0), ("A", "2024-01-01 00:05:00", None), ("A", "2024-01-01 00:05:30", 4.0),
            ("A", "2024-01-01 00:20:00", 5.0), ("B", "2023-12-01 00:00:00", 7.0), ("C", "2024-01-01 00:10:00", 8.0), ("D", "2024-01-02 00:00:00", 9.0),
            ("E", "2023-12-31 23:59:59", None), ("F", "2024-01-01 00:00:00", 1.0), ("F", "2024-01-01 00:20:00", 3.0), ("F", "2024-01-01 00:19:59.5", 6.0)]
    h = hist(spark, rows)
    tree = tr.SummaryTree(tr.tree_nodes(h))
    data = [tuple(r) for r in h.collect()]
    for a, b, step in [("2024-01-01 00:00:00", "2024-01-01 00:20:00", 1), ("2024-01-01 00:00:00", "2024-01-01 00:20:00", 7),
                       ("2024-01-01 00:20:00", "2024-01-01 00:20:00", 1), ("2024-01-01 00:03:00", "2024-01-01 00:03:30", 60)]:
        for t in (None, tree):
            assert rows_of(rs.resample(h, a, b, step, tree=t)) == plain_seeded(data, a, b, step), (a, b, step, t)


def test_a_silent_tag_is_dealt_out(spark):
    """One tag without a sample for a month, at one second: no task makes it alone."""
    h = hist(spark, [("S", "2024-01-01 00:00:00", 1.0), ("S", "2024-02-01 00:00:00", 2.0), ("T", "2024-01-01 00:00:00", 3.0)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for df, n in ((rs.resample(h, "2024-01-01 00:00:00", "2024-02-01 00:00:00", 1, seeded=False), 31 * 86400 + 2),
                      (pit.values_cyclic(h, "2024-01-01 00:00:00", "2024-02-01 00:00:00", 1000), 2 * 31 * 86400)):
            per = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
            assert sum(per) == n and max(per) < 0.6 * n, per
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_filled_grid(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 5, None), ("b", 0, 2.0), ("b", 9, 3.0)], "k string, i long, v double")
    for size in (2, 100):
        got = {(r.k, r.i): (r.v, r._own) for r in chunked.filled_grid(df, ["k"], "i", 0, 9, size).collect()}
        assert len(got) == 20
        assert [got[("a", i)] for i in range(10)] == [(None, False)] * 3 + [(1.0, True), (1.0, False), (None, True)] + [(None, False)] * 4
        assert [got[("b", i)] for i in range(10)] == [(2.0, True)] + [(2.0, False)] * 8 + [(3.0, True)]


def test_many_buckets(spark):
    h = hist(spark, [("A", "2024-01-01 00:00:00", 1.0), ("A", "2024-01-01 12:00:00", 2.0), ("B", "2024-01-01 23:59:59", 3.0)])
    day = ("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    c = bk.buckets(h, *day, 86400, "count", mode="raw")
    assert tuple(c.agg(F.count("*"), F.sum("Value")).first()) == (2 * 86400, 3.0)
    d = bk.buckets(h, *day, 86400, "dif", tags="A, Z")
    assert {(r.TagName, r.Value): r["count"] for r in d.groupBy("TagName", "Value").count().collect()} == \
        {("A", 0.0): 86399, ("A", 1.0): 1, ("Z", None): 86400}


def test_dimension_replays_idle_runs_and_folds(spark, tmp_path):
    path = str(tmp_path / "dim")
    assert dim.read_dimension(spark, path).count() == 0
    one = hist(spark, [("A", "2024-01-01 00:00:00", 1.0), ("A", "2024-01-03 00:00:00", 1.0), ("B", "2024-01-01 00:00:00", 1.0), (None, "2024-01-09 00:00:00", 1.0)])
    late = hist(spark, [("A", "2023-01-01 00:00:00", 1.0), ("C", "2024-01-02 00:00:00", None)])
    dim.add_batch(one, path, 0)
    dim.add_batch(late, path, 1)
    def check():
        d = dim.read_dimension(spark, path)
        assert sorted((r.TagName, r.records, r.LoadMark.day) for r in d.collect()) == [("A", 3, 3), ("B", 1, 1), ("C", 1, 2)]
        assert dim.load_mark(d).first().LoadMark == dt.datetime(2024, 1, 3) and tuple(dim.totals(d).first()) == (3, 5)
        assert sorted(r.TagName for r in dim.tags(d).collect()) == ["A", "B", "C"]
    check()
    dim.add_batch(late, path, 1)                    # a replay
    dim.add_batch(one.limit(0), path, 2)            # an idle run
    check()
    dim.fold(spark, path, 0)
    check()
    dim.fold(spark, path, 2)
    dim.fold(spark, path, 1)
    check()
    dim.add_batch(hist(spark, [("A", "2024-05-01 00:00:00", 1.0)]), path, 3)
    assert dim.load_mark(dim.read_dimension(spark, path)).first().LoadMark == dt.datetime(2024, 5, 1)


def test_running_marks_survive_a_restart(spark, tmp_path):
    src, ck, out = (str(tmp_path / x) for x in ("in", "ck", "out"))
    schema = "TagName string, DateTime timestamp_ntz, Value double, source string"
    def step(rows):
        if rows:
            spark.createDataFrame([(t, dt.datetime.fromisoformat(d), 1.0, s) for t, d, s in rows], schema).coalesce(1).write.mode("append").json(src)
        seen = []
        q = (dim.running_marks(spark.readStream.schema(schema).json(src)).writeStream.outputMode("update")
             .foreachBatch(lambda df, i: seen.extend((r.TagName, r.source, r.records, r.LoadMark.day) for r in df.collect()))
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(120)
        return sorted(seen)
    os.makedirs(src)
    assert step([("A", "2024-01-02", "hs"), ("B", "2024-01-01", "hs")]) == [("A", "hs", 1, 2), ("B", "hs", 1, 1)]
    assert step([]) == []                                                                   # an idle run loses nothing
    assert step([("A", "2024-01-01", "hs"), ("A", "2024-01-05", "result")]) == [("A", "hs", 2, 2), ("A", "result", 1, 5)]   # late data


def test_ordered_documents(spark, tmp_path):
    rows = [(t, f"2024-01-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}", i / 4) for t in ("A", "b/ä \"x\"") for i in range(2500)]
    rows += [("N", "2024-01-01 00:00:00", None), ("N", "2024-01-01 00:00:01", float("nan")), ("N", "2024-01-01 00:00:02", -1234567.891)]
    h = hist(spark, rows).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = exp.write_grafana_series(h, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.doc, r.pieces) for r in written.collect()) == [("A", 2500), ("N", 3), ("b/ä \"x\"", 2500)]
    docs = {r.doc: json.loads(open(r.file).read()) for r in written.collect()}
    assert all(d["target"] == t for t, d in docs.items())
    assert docs["A"]["datapoints"] == [[round(i / 4 * 100 + 1e-9) / 100, 1704067200000 + i * 1000] for i in range(2500)]
    assert [v for v, _ in docs["N"]["datapoints"]] == [None, None, -1234567.89]
    maps = {r.doc: json.loads(open(r.file).read()) for r in exp.write_tag_time_maps(h, str(tmp_path / "m")).collect()}
    assert maps["A"]["A"]["2024-01-01 00:00:01"] == "0,25" and len(maps["A"]["A"]) == 2500
    assert list(maps["A"]["A"]) == sorted(maps["A"]["A"]) and maps["N"]["N"]["2024-01-01 00:00:00"] is None
    for r in exp.write_xml_documents(h, str(tmp_path / "x")).collect():
        got = ET.parse(r.file).getroot()
        assert got.tag == "data" and {e.findtext("TagName") for e in got} == {r.doc} and len(got) == r.pieces
        times = [e.findtext("DateTime") for e in got]
        assert times == sorted(times)
    assert not [f for f in os.listdir(tmp_path / "s") if f.startswith("_parts")]
    assert exp.write_grafana_series(h.limit(0), str(tmp_path / "e")).count() == 0


def test_instants_keep_their_fraction(spark):
    h = hist(spark, [("A", "2024-01-01 00:00:00.250", 1.0), ("B", "2024-01-01 00:00:00.25", 2.0), ("A", "2024-01-01 00:00:00", 3.0)])
    got = {r.time: json.loads(r.json)["data"] for r in exp.grafana_by_time(h).collect()}
    assert got == {"2024-01-01T00:00:00.25Z": [{"name": "A", "value": 1.0}, {"name": "B", "value": 2.0}],
                   "2024-01-01T00:00:00Z": [{"name": "A", "value": 3.0}]}
