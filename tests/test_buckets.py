import datetime as dt

import pytest

from tagscope.operators import buckets as bk
from tests import bruteforce as bf
from tests.conftest import hist
from tests.test_pointintime import random_rows

S, E = "2024-01-01 00:05:00", "2024-01-01 01:40:07"


def as_map(df):
    return {(r.TagName, r.DateTime): r.Value for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        w = want[k]
        assert bf.isclose(got[k], float(w) if w is not None else None), (k, got[k], w)


@pytest.mark.parametrize("group", ["avg", "sum", "min", "max", "count"])
@pytest.mark.parametrize("bounds", ["[)", "[]"])
def test_buckets_raw(spark, group, bounds):
    rows = random_rows(21)
    mode = "raw" if bounds == "[)" else "closed_raw"
    same(as_map(bk.buckets(hist(spark, rows), S, E, 7, group, mode=mode)), bf.buckets_raw(rows, S, E, 7, group, bounds))


def test_edge_sample_in_two_closed_buckets(spark):
    # 2 buckets over 100 s: inner edge at 50 s
    rows = [("A", "2024-01-01 00:00:50", 4), ("A", "2024-01-01 00:00:10", 2)]
    h = hist(spark, rows)
    closed = sorted((r.DateTime.second, r.Value) for r in
                    bk.buckets(h, "2024-01-01 00:00:00", "2024-01-01 00:01:40", 2, "count", mode="closed_raw").collect())
    half = sorted((r.DateTime.second, r.Value) for r in
                  bk.buckets(h, "2024-01-01 00:00:00", "2024-01-01 00:01:40", 2, "count", mode="raw").collect())
    assert closed == [(40, 1.0), (50, 2.0)]   # right edges 00:00:50 and 00:01:40
    assert half == [(40, 1.0), (50, 1.0)]


def test_uneven_buckets_truncated_edges(spark):
    e = bf.edges("2024-01-01 00:00:00", "2024-01-01 23:59:50", 7)
    assert [(x - e[0]).total_seconds() for x in e] == [(i * 86390) // 7 for i in range(8)]
    rows = random_rows(22, span_s=86390)
    same(as_map(bk.buckets(hist(spark, rows), "2024-01-01 00:00:00", "2024-01-01 23:59:50", 7, "sum", mode="raw")),
         bf.buckets_raw(rows, "2024-01-01 00:00:00", "2024-01-01 23:59:50", 7, "sum", "[)"))


def test_disjoint_buckets_sum_to_whole(spark):
    rows = random_rows(23)
    h = hist(spark, rows)
    b = bk.buckets(h, S, E, 13, "count", mode="raw").groupBy("TagName").sum("Value").collect()
    whole = {t: len([1 for d, _ in s if bf.D(S) <= d < bf.D(E)]) for t, s in bf.by_tag(rows).items()}
    assert {r.TagName: r["sum(Value)"] for r in b} == {t: float(n) for t, n in whole.items() if n}


@pytest.mark.parametrize("group", ["avg", "sum", "min", "max", "count"])
def test_buckets_filled(spark, small_chunks, group):
    rows = random_rows(24)
    same(as_map(bk.buckets(hist(spark, rows), S, E, 5, group, mode="filled")), bf.buckets_filled(rows, S, E, 5, group))


def test_buckets_avgm(spark, small_chunks):
    rows = random_rows(25)
    same(as_map(bk.buckets(hist(spark, rows), S, E, 6, "avgm")), bf.buckets_avgm(rows, S, E, 6))


def test_buckets_dif(spark):
    rows = random_rows(26)
    got = as_map(bk.buckets_dif(hist(spark, rows), S, E, 4, chunk_size=2))
    e = bf.edges(S, E, 4)
    va = [bf.value_at(rows, x) for x in e]
    tags = {t for t, s in bf.by_tag(rows).items() if any(d <= e[-1] for d, _ in s)}
    want = {}
    for t in tags:
        for i in range(1, 5):
            a, b = va[i - 1].get(t), va[i].get(t)
            want[(t, e[i])] = None if a is None or b is None else b[1] - a[1]
    same(got, want)


def test_more_buckets_than_seconds(spark):
    rows = [("A", "2024-01-01 00:00:01", 1.0), ("A", "2024-01-01 00:00:02.5", 2.0)]
    got = as_map(bk.buckets(hist(spark, rows), "2024-01-01 00:00:00", "2024-01-01 00:00:03", 7, "count", mode="closed_raw"))
    want = bf.buckets_raw(rows, "2024-01-01 00:00:00", "2024-01-01 00:00:03", 7, "count", "[]")
    same(got, want)


@pytest.mark.parametrize("group", ["avg", "sum", "min", "max", "count"])
@pytest.mark.parametrize("n", [1, 5, 7])
def test_buckets_seeded_and_cyclic(spark, small_chunks, group, n):
    """Every bucket is what the single range of the same mode gives."""
    rows = random_rows(27)
    e = bf.edges(S, E, n)
    first = {t: min(d for d, _ in s) for t, s in bf.by_tag(rows).items()}
    seeded, cyclic = {}, {}
    for i in range(1, n + 1):
        one = bf.filled_agg(rows, e[i - 1], e[i], group, seeded=True)
        held = {}
        for t, _, v in bf.cyclic(rows, e[i - 1], e[i], 60000):
            held.setdefault(t, []).append(v)
        for t in first:
            if first[t] <= e[n]:
                seeded[(t, e[i])] = one.get(t, 0.0 if group == "count" else None)
            if first[t] < e[n]:
                v = bf.agg(held[t], group) if t in held else (0 if group == "count" else None)
                cyclic[(t, e[i])] = v / 60 if group == "count" else v
    h = hist(spark, rows)
    same(as_map(bk.buckets(h, S, E, n, group, mode="seeded")), seeded)
    got = as_map(bk.buckets(h, S, E, n, group, mode="cyclic"))
    same({k: v for k, v in got.items() if k in cyclic}, {k: v for k, v in cyclic.items() if k in got})
    assert {k[0] for k in got} == {t for t, _ in cyclic if any((t, x) in cyclic and cyclic[t, x] not in (None, 0) for x in e)}


def test_buckets_dif_interpolated(spark, small_chunks):
    rows = random_rows(28)
    e = bf.edges(S, E, 6)
    at = [bf.interp(rows, x) for x in e]
    got = as_map(bk.buckets(hist(spark, rows), S, E, 6, "dif", mode="raw"))
    want = {}
    for t in {t for t, _ in got}:
        for i in range(1, 7):
            a, b = at[i - 1].get(t), at[i].get(t)
            want[(t, e[i])] = None if a is None or b is None else b - a
    same(got, want)
    assert any(v is not None for v in want.values())


def test_modes_are_checked_and_asked_tags_complete(spark):
    rows = random_rows(29)
    h = hist(spark, rows)
    with pytest.raises(ValueError):
        bk.buckets(h, S, E, 3, "avg", mode="nonsense")
    tag = rows[0][0]
    for mode in ("raw", "filled", "seeded", "cyclic"):
        for group in ("avg", "count", "dif", "avgm"):
            got = as_map(bk.buckets(h, S, E, 3, group, mode=mode, tags=f"{tag},zzz"))
            assert {t for t, _ in got} == {tag, "zzz"} and len(got) == 6
            assert {v for (t, _), v in got.items() if t == "zzz"} == {0.0 if group == "count" else None}


def test_bucket_count_errors(spark):
    h = hist(spark, [("A", "2024-01-01 00:00:00", 1)])
    with pytest.raises(ValueError):
        bk.buckets(h, S, E, 0, "avg")
    assert dt.datetime  # keep import


@pytest.mark.parametrize("n,bounds", [(7, "[)"), (7, "[]"), (300, "[)"), (300, "[]"), (5999, "[]"), (6000, "[]")])
def test_fast_bucket_path_equals_general(spark, n, bounds):
    # offsets: every whole second of a 6000 s range plus random sub-second points
    import random
    from pyspark.sql import functions as F
    rnd = random.Random(n)
    T = 6000
    xs = [s * 1_000_000 for s in range(T + 1)] + [rnd.randrange(T * 1_000_000) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "_x long")
    if bounds == "[)":
        df = df.filter(F.col("_x") < T * 1_000_000)
    fast = bk.with_bucket_of(df, "_x", T, n, bounds).select("_x", F.explode("_bk").alias("i"))
    fast_col = df.select("_x", F.explode(bk.bucket_of("_x", T, n, bounds)).alias("i"))
    assert fast.exceptAll(fast_col).count() == 0
    slow = df.select("_x", F.explode(bk.bucket_members("_x", T, n, bounds)).alias("i"))
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0
