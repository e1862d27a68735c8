"""Results must not depend on the session time zone (NTZ end to end)."""

import pytest

from tagscope.functions import timeparse as tp
from tagscope.operators import aggregate as agg
from tagscope.operators import buckets as bk
from tagscope.operators import events as ev
from tagscope.operators import pointintime as pit
from tagscope.operators import resample as rs
from tests.conftest import hist

# wall times around the 2024-03-10 spring-forward gap (02:00-03:00) in New York, plus summer
ROWS = [("A", "2024-03-10 01:59:30", 1), ("A", "2024-03-10 02:15:00.25", 0), ("A", "2024-03-10 02:45:00", 1),
        ("A", "2024-03-10 03:10:00", 0), ("B", "2024-03-10 02:30:00", 5), ("B", "2024-07-01 12:00:00", 7),
        ("B", "2024-07-01 12:00:30", 8)]
TEXTS = ["2024-03-10 02:30:00", "10.03.2024 02:30", "2024-07-01T12:00:00", "2024-03-10T02:30:00+01:00", "45361,1"]


def _run_all(spark):
    h = hist(spark, ROWS)
    out = {
        "resample": rs.resample(h, "2024-03-10 01:59:00", "2024-03-10 03:20:00", 60),
        "instants": pit.values_at_instants(h, "2024-03-10 00:00:00", "2024-07-02 00:00:00", 9),
        "buckets": bk.buckets(h, "2024-03-10 00:00:00", "2024-07-02 00:00:00", 5, "count", mode="closed_raw"),
        "filled": agg.aggregate(h, "2024-03-10 01:00:00", "2024-03-10 04:00:00", "avg"),
        "down": ev.down_events(h, "2024-03-10 00:00:00", "2024-07-02 00:00:00"),
        "times": tp.normalise_times(spark.createDataFrame([(t,) for t in TEXTS], "raw string")),
    }
    return {k: sorted(map(tuple, v.collect()), key=str) for k, v in out.items()}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Almaty"])
def test_results_independent_of_session_zone(spark, small_chunks, zone):
    base = _run_all(spark)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        other = _run_all(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert other == base
    assert base["times"][0][1] is not None        # the gap wall time parses as written
