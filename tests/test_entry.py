import importlib.util
import os

from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_and_catalog(spark):
    m = load_entry()
    df = m.entry(spark)
    assert df.count() > 0 and df.columns == ["TagName", "DateTime", "Value"]
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40


def test_every_query_runs_small(spark):
    m = load_entry()
    for name, fn in m.queries().items():
        df = fn(spark, SF_SMALL)
        df.write.format("noop").mode("overwrite").save()
