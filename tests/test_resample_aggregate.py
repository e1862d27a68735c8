import datetime as dt

import pytest

from tagscope.operators import aggregate as agg
from tagscope.operators import resample as rs
from tests import bruteforce as bf
from tests.conftest import hist
from tests.test_pointintime import ROWS, random_rows

S, E = "2024-01-01 00:05:00", "2024-01-01 01:40:00"


@pytest.mark.parametrize("seeded", [True, False])
@pytest.mark.parametrize("step", [1, 60])
def test_resample_vs_bruteforce(spark, small_chunks, seeded, step):
    rows = random_rows(11)
    got = sorted((r.TagName, r.DateTime, round(r.Value, 9)) for r in
                 rs.resample(hist(spark, rows), S, E, step, seeded).collect())
    want = sorted((t, d, round(v, 9)) for t, d, v in bf.resample(rows, S, E, step, seeded))
    assert got == want


def test_resample_seeds_and_second_average(spark):
    rows = [("A", "2024-01-01 00:00:00", 1), ("A", "2024-01-01 00:00:03.2", 3), ("A", "2024-01-01 00:00:03.7", 5)]
    got = [(r.DateTime.second, r.Value) for r in
           rs.resample(hist(spark, rows), "2024-01-01 00:00:01", "2024-01-01 00:00:05", 1, True).orderBy("DateTime").collect()]
    # the seed at `to` is the last sample (5) stamped at second 5
    assert got == [(1, 1.0), (2, 1.0), (3, 4.0), (4, 4.0), (5, 5.0)]


def test_range_raw_bounds(spark):
    h = hist(spark, ROWS)
    assert rs.range_raw(h, "2024-01-01 00:10:00", "2024-01-01 01:00:00").count() == 3
    assert rs.range_raw(h, "2024-01-01 00:10:00", "2024-01-01 01:00:00", bounds="[]").count() == 4
    assert rs.range_raw(h, "2024-01-01 00:10:00", "2024-01-01 01:00:00", bounds="()").count() == 2
    assert rs.range_raw(h, "2024-01-01 00:10:00", "2024-01-01 01:00:00", tags="A, C").count() == 2


@pytest.mark.parametrize("group", ["avg", "sum", "min", "max", "count"])
@pytest.mark.parametrize("seeded", [False, True])
def test_filled_aggregate_equals_exploded(spark, small_chunks, group, seeded):
    rows = random_rows(12)
    got = {r.TagName: r.Value for r in agg.aggregate_filled(hist(spark, rows), S, E, group, seeded).collect()}
    want = bf.filled_agg(rows, S, E, group, seeded)
    assert set(got) == set(want)
    assert all(bf.isclose(got[t], want[t]) for t in want)


@pytest.mark.parametrize("group", ["avg", "sum", "min", "max", "count"])
def test_raw_aggregate(spark, group):
    rows = random_rows(13)
    got = {r.TagName: r.Value for r in agg.aggregate(hist(spark, rows), S, E, group, mode="raw").collect()}
    byt = bf.by_tag(rows)
    want = {t: bf.agg([v for d, v in s if bf.D(S) <= d < bf.D(E)], group) for t, s in byt.items()
            if any(bf.D(S) <= d < bf.D(E) for d, _ in s)}
    assert set(got) == set(want) and all(bf.isclose(got[t], want[t]) for t in want)


def test_cyclic_aggregates(spark):
    rows = random_rows(14)
    h = hist(spark, rows)
    series = bf.cyclic(rows, S, E, 60000)
    by = {}
    for t, d, v in series:
        by.setdefault(t, []).append(v)
    avg = {r.TagName: r.Value for r in agg.aggregate(h, S, E, "avg", mode="cyclic").collect()}
    hours = {r.TagName: r.Value for r in agg.aggregate(h, S, E, "count", mode="cyclic").collect()}
    for t, vs in by.items():
        assert bf.isclose(avg[t], sum(vs) / len(vs))
        assert bf.isclose(hours[t], len(vs) / 60.0)


def test_dif_last_and_interpolated(spark):
    h = hist(spark, ROWS)
    d = {r.TagName: r.Value for r in agg.aggregate(h, "2024-01-01 00:05:00", "2024-01-01 00:30:00", "dif").collect()}
    assert d["A"] == 6.0 and d["B"] is None
    di = {r.TagName: r.Value for r in agg.aggregate(h, "2024-01-01 00:05:00", "2024-01-01 00:15:00", "dif", mode="raw").collect()}
    want_to = 3 + (300 / 600.5) * 4
    assert di["A"] == pytest.approx(want_to - 2.0)


def test_avgm_modes(spark):
    rows = random_rows(15)
    h = hist(spark, rows)
    seeded = {r.TagName: r.Value for r in agg.aggregate(h, S, E, "avgm").collect()}
    want = bf.filled_agg(rows, S, E, "avg", seeded=True)
    assert all(bf.isclose(seeded[t], want[t]) for t in want)


def test_group_errors(spark):
    with pytest.raises(ValueError, match="group error"):
        agg.aggregate(hist(spark, ROWS), S, E, "median")


def test_sum_with_nulls_and_totals(spark):
    h = hist(spark, [("A", "2024-01-01 00:00:00", 1), ("A", "2024-01-01 00:00:01", None), ("A", "2024-01-01 00:00:02", 2)])
    r = agg.aggregate(h, "2024-01-01", "2024-01-01 00:01:00", "sum", mode="raw").first()
    assert r.Value == 3.0
    c = agg.aggregate(h, "2024-01-01", "2024-01-01 00:01:00", "count", mode="raw").first()
    assert c.Value == 2.0
    t = agg.totals(h).first()
    assert (t.tags, t.records) == (1, 3)


def test_labelled_from(spark):
    r = agg.average_labelled_from(hist(spark, ROWS), "2024-01-01 00:00:00", "2024-01-01 00:15:00").collect()
    assert {(x.TagName, x.DateTime, x.Value) for x in r} == {("A", dt.datetime(2024, 1, 1), 2.0)}


def test_empty_range_seed_only(spark):
    # every sample before `from`: the seeded series is the seed held to `to`
    rows = [("A", "2024-01-01 00:00:00", 4), ("A", "2024-01-01 00:00:30", 6)]
    h = hist(spark, rows)
    a, b = "2024-01-01 00:01:00", "2024-01-01 00:01:05"
    got = [(r.DateTime.second, r.Value) for r in rs.resample(h, a, b).orderBy("DateTime").collect()]
    assert got == [(0, 6.0), (1, 6.0), (2, 6.0), (3, 6.0), (4, 6.0), (5, 6.0)]
    assert rs.resample(h, a, b, seeded=False).count() == 0
    assert agg.aggregate(h, a, b, "avg", mode="filled").count() == 0
    assert agg.aggregate(h, a, b, "avg", mode="seeded").first().Value == 6.0
    assert agg.aggregate(h, a, b, "count", mode="raw").count() == 0


@pytest.mark.parametrize("where,want", [("from", [(0, 5.0), (1, 5.0), (2, 5.0)]), ("to", [(2, 5.0)])])
def test_one_sample_on_a_bound(spark, where, want):
    a, b = "2024-01-01 00:00:00", "2024-01-01 00:00:02"
    h = hist(spark, [("A", a if where == "from" else b, 5)])
    got = [(r.DateTime.second, r.Value) for r in rs.resample(h, a, b).orderBy("DateTime").collect()]
    assert got == want
    assert rs.range_raw(h, a, b).count() == (1 if where == "from" else 0)      # half-open
    assert rs.range_raw(h, a, b, bounds="[]").count() == 1


def test_two_tags_one_absent(spark):
    from tagscope.operators import pointintime as pit
    rows = [("A", "2024-01-01 00:00:00", 1), ("B", "2024-01-01 00:00:45", 2)]
    h = hist(spark, rows)
    got = sorted((r.TagName, r.DateTime.second, r.Value) for r in pit.values_at_instants(
        h, "2024-01-01 00:00:00", "2024-01-01 00:01:00", 4, tags="A, B, C").collect())
    assert got == [("A", 0, 1.0), ("A", 15, 1.0), ("A", 30, 1.0), ("A", 45, 1.0),
                   ("B", 0, None), ("B", 15, None), ("B", 30, None), ("B", 45, 2.0)]
