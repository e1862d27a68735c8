import datetime as dt
import random

import pytest

from tagscope.operators import pointintime as pit
from tests import bruteforce as bf
from tests.conftest import hist

ROWS = [
    ("A", "2024-01-01 00:00:00", 1), ("A", "2024-01-01 00:10:00", 3), ("A", "2024-01-01 00:20:00.5", 7),
    ("B", "2024-01-01 00:15:00", 10), ("B", "2024-01-01 01:00:00", 20),
    ("C", "2024-01-01 02:00:00", 5),
]


def random_rows(seed, tags=("A", "B", "C"), n=120, span_s=7200):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out, seen = [], set()
    for _ in range(n):
        t = rnd.choice(tags)
        d = base + dt.timedelta(microseconds=rnd.randrange(span_s * 1_000_000))
        if rnd.random() < 0.2:
            d = d.replace(microsecond=0)
        if (t, d) in seen:
            continue
        seen.add((t, d))
        out.append((t, d.isoformat(sep=" "), round(rnd.uniform(-5, 50), 2)))
    return out


def test_value_at_basic(spark):
    r = {x.TagName: (x.DateTime, x.Value) for x in pit.value_at(hist(spark, ROWS), "2024-01-01 00:15:00").collect()}
    assert r["A"] == (dt.datetime(2024, 1, 1, 0, 10), 3.0)       # sample keeps its own time
    assert r["B"] == (dt.datetime(2024, 1, 1, 0, 15), 10.0)      # exactly at the date
    assert "C" not in r                                           # no earlier sample


def test_value_at_guard(spark):
    h = hist(spark, ROWS)
    late = {x.TagName: x.Value for x in pit.value_at(h, "2024-01-02 00:00:00", guard=True).collect()}
    assert late == {"A": None, "B": None, "C": None}
    ok = {x.TagName: x.Value for x in pit.value_at(h, "2024-01-01 01:00:00", guard=True).collect()}
    assert ok == {"A": 7.0, "B": 20.0}


def test_value_exact(spark):
    r = pit.value_exact(hist(spark, ROWS), "2024-01-01 00:10:00").collect()
    assert [(x.TagName, x.Value) for x in r] == [("A", 3.0)]


def test_interpolation(spark):
    h = hist(spark, ROWS)
    r = {x.TagName: x.Value for x in pit.value_interpolated(h, "2024-01-01 00:05:00").collect()}
    assert r == {"A": 2.0}                                       # B has no earlier sample, C none
    exact = {x.TagName: x.Value for x in pit.value_interpolated(h, "2024-01-01 00:10:00").collect()}
    assert exact["A"] == 3.0
    mid = {x.TagName: x.Value for x in pit.value_interpolated(h, "2024-01-01 00:37:30").collect()}
    assert mid["B"] == pytest.approx(15.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_value_at_and_interp_random(spark, seed):
    rows = random_rows(seed)
    h = hist(spark, rows)
    for at in ["2024-01-01 00:30:00", "2024-01-01 01:59:59"]:
        got = {x.TagName: (x.DateTime, x.Value) for x in pit.value_at(h, at).collect()}
        assert got == bf.value_at(rows, at)
        gi = {x.TagName: x.Value for x in pit.value_interpolated(h, at).collect()}
        want = bf.interp(rows, at)
        assert set(gi) == set(want) and all(bf.isclose(gi[t], want[t]) for t in want)


@pytest.mark.parametrize("seed,n", [(4, 7), (5, 300), (6, 1)])
def test_instants_random(spark, seed, n):
    _instants_check(spark, seed, n)


@pytest.mark.parametrize("seed,n", [(4, 7), (5, 300)])
def test_instants_random_chunked_path(spark, small_chunks, seed, n):
    _instants_check(spark, seed, n)


def _instants_check(spark, seed, n):
    rows = random_rows(seed)
    got = sorted(tuple(r) for r in pit.values_at_instants(
        hist(spark, rows), "2024-01-01 00:10:00", "2024-01-01 01:56:39", n, chunk_size=5).collect())
    want = sorted(bf.instants(rows, "2024-01-01 00:10:00", "2024-01-01 01:56:39", n))
    assert got == want


def test_instants_errors(spark):
    h = hist(spark, ROWS)
    with pytest.raises(ValueError, match="empty"):
        pit.values_at_instants(h, "2024-01-01", "2024-01-02", 0)
    with pytest.raises(ValueError, match="less than one"):
        pit.values_at_instants(h, "2024-01-01", "2024-01-02", -3)


@pytest.mark.parametrize("seed", [7, 8])
def test_cyclic_random(spark, small_chunks, seed):
    rows = random_rows(seed)
    got = sorted(tuple(r) for r in pit.values_cyclic(
        hist(spark, rows), "2024-01-01 00:00:30", "2024-01-01 01:30:00", 60000, chunk_size=7).collect())
    assert got == sorted(bf.cyclic(rows, "2024-01-01 00:00:30", "2024-01-01 01:30:00", 60000))


def test_duplicates_collapse(spark):
    h = hist(spark, [("A", "2024-01-01 00:00:00", 1), ("A", "2024-01-01 00:00:00", 3)])
    r = pit.value_at(pit.collapse_duplicates(h), "2024-01-01 00:00:01").collect()
    assert r[0].Value == 2.0


def test_tree_gives_identical_asof(spark):
    from tagscope.operators import aggregate as agg
    from tagscope.operators import buckets as bk
    from tagscope.operators import resample as rs
    from tagscope.operators.tree import SummaryTree, compacted, tree_nodes
    from tagscope.sources import testdata as td
    from tests.conftest import SF_SMALL
    h = td.history(spark, SF_SMALL)
    half = h.filter("DateTime < '2024-01-13 12:00:00'")
    many = tree_nodes(h).unionByName(tree_nodes(half)).unionByName(tree_nodes(h))    # repeated and partial nodes are harmless
    assert sorted(map(tuple, compacted(SummaryTree(many)).collect())) == sorted(map(tuple, tree_nodes(h).collect()))
    r = SummaryTree(many)
    def same(a, b):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for at in ["2024-01-10 00:00:00", "2024-01-10 13:17:00", "2024-01-01 00:00:00"]:
        same(pit.value_at(h, at, tree=r), pit.value_at(h, at))
    a, b = "2024-01-12 06:00:00", "2024-01-14 18:30:00"
    same(rs.resample(h, a, b, 600, tree=r), rs.resample(h, a, b, 600))
    same(pit.values_at_instants(h, a, b, 50, tree=r), pit.values_at_instants(h, a, b, 50))
    same(pit.values_cyclic(h, a, b, 3600000, tree=r), pit.values_cyclic(h, a, b, 3600000))
    same(agg.aggregate(h, a, b, "dif", tree=r), agg.aggregate(h, a, b, "dif"))
    same(agg.aggregate(h, a, b, "avgm", tree=r), agg.aggregate(h, a, b, "avgm"))
    same(bk.buckets(h, a, b, 5, "dif", tree=r), bk.buckets(h, a, b, 5, "dif"))
    for at in ["2024-01-10 00:00:00", "2024-01-10 13:17:00", "2024-01-29 23:00:00"]:
        same(pit.value_interpolated(h, at, tree=r), pit.value_interpolated(h, at))
    same(agg.aggregate(h, a, b, "dif", mode="raw", tree=r), agg.aggregate(h, a, b, "dif", mode="raw"))


def test_more_instants_than_seconds(spark):
    rows = [("A", "2024-01-01 00:00:01.5", 1.0), ("A", "2024-01-01 00:00:02", 2.0)]
    got = sorted(tuple(r) for r in pit.values_at_instants(hist(spark, rows), "2024-01-01 00:00:00",
                                                          "2024-01-01 00:00:04", 10, chunk_size=3).collect())
    assert got == sorted(bf.instants(rows, "2024-01-01 00:00:00", "2024-01-01 00:00:04", 10))
