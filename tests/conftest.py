import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tagscope.operators import chunked  # noqa: E402
from tagscope.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="tagscope-tests", shuffle_partitions=4)
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tagscope-test-ckpt-"))
    yield s


@pytest.fixture
def small_chunks(monkeypatch):
    """Force many chunk edges (60 s chunks) to exercise the cross-chunk carry."""
    monkeypatch.setattr(chunked, "DEFAULT_CHUNK_SECONDS", 60)
    yield 60


def hist(spark, rows):
    """rows: (tag, 'YYYY-MM-DD HH:MM:SS[.ffffff]', value)"""
    import datetime as dt
    data = [(t, dt.datetime.fromisoformat(d), None if v is None else float(v)) for t, d, v in rows]
    return spark.createDataFrame(data, "TagName string, DateTime timestamp_ntz, Value double")


def rows_of(df, ndigits=9):
    out = []
    for r in df.collect():
        out.append(tuple(round(x, ndigits) if isinstance(x, float) else x for x in r))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))
