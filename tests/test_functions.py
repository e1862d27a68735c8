import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tagscope.functions import numbers as num
from tagscope.functions import tagdecode as dec
from tagscope.functions import timeparse as tp
from tagscope.sources import testdata as td
from tests.conftest import SF_SMALL

# FIXTURES section 2 (reference tests) and further probed inputs
CASES = [
    ("31.12.2022 00:00:00", dt.datetime(2022, 12, 31), None),
    ("10.11.2022  18:12:34", dt.datetime(2022, 11, 10, 18, 12, 34), None),
    ("44926,0", dt.datetime(2022, 12, 31), None),
    ("44875.7587268519", dt.datetime(2022, 11, 10, 18, 12, 34), None),
    ("", None, "date is not valid"),
    ("12.31.2022 00:00:00", None, "date is not valid"),
    ("2019-01-01", None, "not a float"),
    ("1698440400000", dt.datetime(2023, 10, 27, 21), None),
    ("2023-10-27T21:00:00Z", dt.datetime(2023, 10, 27, 21), None),
    ("2023-10-27T21:00:00+05:00", dt.datetime(2023, 10, 27, 16), None),
    ("27.10.2023 21:00", dt.datetime(2023, 10, 27, 21), None),
    ("2023-10-27T21:00:00.250-01:00", dt.datetime(2023, 10, 27, 22, 0, 0, 250000), None),
]


def test_timestamp_cases(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "raw string")
    got = {r.raw: (r.DateTime, r.error) for r in tp.normalise_times(df).collect()}
    for raw, want_t, want_e in CASES:
        assert got[raw] == (want_t, want_e), raw


def test_timestamp_fixture_roundtrip(spark):
    d = tp.normalise_times(td.raw_times(spark, SF_SMALL)).join(
        td.table(spark, SF_SMALL, "events").select("event_id", "ts"), "event_id")
    d = d.persist()
    kinds = td.RAW_TIME_KINDS
    k = F.col("event_id") % (len(kinds) + 2 + len(td.RAW_TIME_BAD) + 1)
    for i, (pattern, digits, _, _) in enumerate(kinds):
        unit = 60_000_000 if ":ss" not in pattern else 10 ** (6 - digits)
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        same = F.unix_micros(F.col("DateTime").cast("timestamp")) == us - us % unit
        assert d.filter((k == i) & ~F.coalesce(same, F.lit(False))).count() == 0, pattern
    n = len(kinds)
    assert d.filter((k == n + 1) & (F.col("DateTime") != F.timestamp_millis(F.expr("unix_millis(cast(ts as timestamp))")).cast("timestamp_ntz"))).count() == 0
    bad = (k >= n + 2) & (k < n + 2 + len(td.RAW_TIME_BAD))
    assert d.filter(bad & (F.col("DateTime").isNotNull() | (F.col("error") != "date is not valid"))).count() == 0
    assert d.filter((k == n + 2 + len(td.RAW_TIME_BAD)) & (F.col("error") != "not a float")).count() == 0
    # the 8-decimal Excel serial lands within a second of the event time
    assert d.filter((k == n) & (F.abs(F.unix_micros(F.col("DateTime").cast("timestamp")) -
                                      F.unix_micros(F.col("ts").cast("timestamp"))) > 1_000_000)).count() == 0


@pytest.mark.parametrize("v,r,want,text", [
    (1.005, 2, 1.0, "1"), (-1.005, 2, -1.0, "-1"), (0.125, 2, 0.13, "0,13"), (-0.125, 2, -0.13, "-0,13"),
    (2.5, 0, 3.0, "3"), (-2.5, 0, -3.0, "-3"), (12000000.0, 2, 12000000.0, "12000000"), (100.0, 0, 100.0, "100"),
    (1234.5678, 3, 1234.568, "1234,568"),
])
def test_round_and_decimal_comma(spark, v, r, want, text):
    row = spark.range(1).select(num.round_half_away(F.lit(v), r).alias("x")).select(
        "x", num.decimal_comma(F.col("x")).alias("t")).first()
    assert row.x == want and row.t == text


def test_parse_round():
    assert num.parse_round("3") == 3 and num.parse_round("x") == 2 and num.parse_round(None) == 2


def python_decode(name, classifier=dec.DEFAULT_CLASSIFIER):
    """The decoding rules in plain Python (file order, later class wins)."""
    out = {}
    for cls in classifier.values():
        rx = re.compile(cls["regex"])
        m = rx.search(name)
        if not m:
            continue
        groups = [m.group(0)] + [g or "" for g in m.groups()]
        for f, spec in cls["on_match"].items():
            g, val = int(spec.get("group", 0)), spec.get("value")
            if isinstance(val, str) and g == -1:
                out[f] = val
            elif isinstance(val, dict) and g != -1 and g + 1 < len(groups):
                out[f] = val.get(groups[g + 1], groups[g + 1])
            elif g != -1 and g + 1 < len(groups):
                out[f] = groups[g + 1]
            else:
                out[f] = ""
    return out


def test_decode_matches_python_rules(spark):
    names = td.tag_names(spark, SF_SMALL)
    got = dec.decode_tags(names).collect()
    assert len(got) > 100
    for r in got:
        d = r.asDict()
        want = python_decode(d.pop("tag_name"))
        assert {k: v for k, v in d.items() if v is not None} == want


def test_decode_custom_classifier_and_units(spark):
    cls = {"kind": {"regex": r"^(\w)_", "on_match": {"kind": {"group": 0, "value": {"P": "pump"}}, "fixed": {"group": -1, "value": "x"}}}}
    df = spark.createDataFrame([("P_1",), ("Q_2",), ("zz",)], "TagName string")
    got = {r.tag_name: (r.kind, r.fixed) for r in dec.decode_tags(df, cls).collect()}
    assert got == {"P_1": ("pump", "x"), "Q_2": ("Q", "x"), "zz": (None, None)}
    u = {r.tag_name: (r.unit, r.description) for r in dec.tag_units(spark.createDataFrame(
        [("A20_WT_01",), ("A20_07_URS_",), ("zzz",), ("A10_SPEED_X",)], "TagName string")).collect()}
    assert u["A20_WT_01"] == ("t", "WT No 01 (20)")          # codes mean what the caller says
    texts = dec.with_texts([("area_descr", "20", "mill"), ("device_type", "WT", "scale"), ("tag_descr", "URS", "runs"), ("no_field", "x", "y")])
    named = {r.tag_name: r.description for r in dec.tag_units(spark.createDataFrame([("A20_WT_01",), ("A20_07_URS_",)], "TagName string"), texts).collect()}
    assert named == {"A20_WT_01": "Scale No 01 (mill)", "A20_07_URS_": "Process value (mill) - runs"}
    assert dec.DEFAULT_CLASSIFIER["area"]["on_match"]["area_descr"]["value"] == {}
    assert u["A20_07_URS_"][0] == "" and u["zzz"] == ("—", "Process value")
    assert u["A10_SPEED_X"][0] == "rpm"
