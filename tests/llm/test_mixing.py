import duckdb
import pytest

from tagscope.llm import mixing, queries
from tagscope.llm.common import table
from tests.llm.conftest import SF, odd_rows


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Water-filling by rounds: clamp whoever is above, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        out = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        above = [s for s in free if out[s] > cap * sizes[s]]
        if not above:
            return fixed | out
        fixed |= {s: float(cap * sizes[s]) for s in above}


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    want = fill({s: sum(r["size"] for r in rs) for s, rs in by.items()}) if by else {}
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in rs) == pytest.approx(want[s], abs=1)
        assert all(0 <= r.taken <= 3 * r["size"] for r in rs)


def test_odd_rows_and_clashing_names(docs):
    m = mixing.mix(docs(odd_rows())).select("doc_id", "source", "size", "target", "taken").collect()
    assert len(m) == len(odd_rows())
    check(m)
    assert mixing.mix(docs([])).count() == 0
    mixed = mixing.mixed_documents(docs(odd_rows()))
    assert mixed.columns == docs([]).columns
    assert {r["size"] for r in mixed.collect()} == {"x0"}


def test_clamping_and_chunks(docs, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 7)
    rows = [(i, "w " * (1 + i % 9), "en", "tiny" if i % 40 == 0 else "big" if i % 3 else "aaa", 0) for i in range(200)]
    a = mixing.mix(docs(rows)).select("doc_id", "source", "size", "target", "taken").collect()
    check(a)
    b = mixing.mix(docs(rows[::-1]).repartition(5)).select("doc_id", "source", "size", "target", "taken").collect()
    assert sorted(a) == sorted(b)


def test_all_sources_empty(docs):
    m = mixing.mix(docs([(1, None, None, "a", 0), (2, "", None, "b", 0)])).collect()
    assert [r.taken for r in m] == [0, 0] and all(r.target == 0 for r in m)


def test_repeats(docs):
    rows = [(i, "w " * 10, "en", "a" if i < 2 else "b", 0) for i in range(20)]
    m = {r.doc_id: r.taken for r in mixing.mix(docs(rows)).collect()}
    n = [r.doc_id for r in mixing.mixed_documents(docs(rows)).collect()]
    for i, t in m.items():
        assert abs(n.count(i) - t / 10) <= 0.5


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(queries.MIX_SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op3_mix_sources(spark, SF).collect())
    assert len(got) == table(spark, SF, "documents").count()
    assert [(a, b, c, e) for a, b, c, _, e in got] == [(a, b, c, e) for a, b, c, _, e in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
