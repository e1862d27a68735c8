import numpy as np
from pyspark.sql import functions as F

from tagscope.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def plain(rows, top=20, every=20):
    """Best score of each id against each query id, in double precision."""
    ok = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            best = {}
            for i, x in ok:
                if i != q and len(x) == len(v):
                    best[i] = max(best.get(i, -np.inf), (x * v).sum())
            out[q] = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:top]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def search(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], SCHEMA)
    return found(ann.search(df, F.col("vec_id") % 20 == 0, **kw))


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(130)]
    rows += [(200 + i, [1.0] * 8) for i in range(30)] + [(0, rows[0][1])]                   # ties and a repeated row
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan")] + [1.0] * 7), (360, [None] + [1.0] * 7), (None, [1.0] * 8),
             (380, [float("inf")] * 8), (400, [1.0, 2.0])]
    got, want = search(spark, rows), plain(rows)
    want.pop(400)                                                                           # not as long as most
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in got:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_few_and_none(spark):
    assert search(spark, []) == {}
    assert search(spark, [(0, [1.0, 2.0])]) == {}
    assert search(spark, [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (20, [0.5, 0.0])]) == {0: [(1, 2.0), (20, 0.5)], 20: [(1, 1.0), (0, 0.5)]}


def test_recall_with_many_lists_and_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 60)
    monkeypatch.setattr(ann, "CELL_ROWS", 25)
    monkeypatch.setattr(ann, "SEED_ROWS", 64)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[500:1000] = x[500] + 0.05 * rng.normal(size=(500, 32))                                 # a hot cluster
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = search(spark, rows), plain(rows)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)


def test_scan_abandons_but_keeps_the_best():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(5, 64))
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    ids = np.arange(2000)
    for i, got, scores in ann.scan(q, np.full(5, -1), np.full(5, -np.inf), x, ids, turn):
        want = np.lexsort((ids, -(x @ q[i])))[:20]
        assert len(set(got) & set(want)) >= 19 and np.allclose(scores, x[got] @ q[i])


def recall(spark, rows):
    got = search(spark, rows)
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    hits = 0
    for q, v in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & {i for i, _ in v})
    assert len(got) == sum(ids % 20 == 0)
    return hits / (20 * len(got))


def test_recall_comes_from_the_lists(spark, monkeypatch):
    """The given vectors (sf0.1), with the seeds a small part of them, and without any."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    monkeypatch.setattr(ann, "SEED_ROWS", 256)
    assert recall(spark, rows) >= 0.95
    monkeypatch.setattr(ann, "SEED_ROWS", 0)
    assert recall(spark, rows) >= 0.95


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = found(queries.op2_nearest_vectors(spark, sf))
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    hits = 0
    for q, v in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & {i for i, _ in v})
    assert len(got) == sum(ids % 20 == 0) and hits >= 0.9 * 20 * len(got)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_scan_keeps_rows_that_are_all_near():
    """Near copies, vectors far off the origin, opposite ones, lengths of all scales: a threshold
    close to |q| * |x| abandons none of the nearest."""
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    ids = np.arange(1500)
    noise = rng.normal(size=(1500, 64))
    for x in (unit(unit(rng.normal(size=(1, 64))) + 0.02 * noise), noise + 5, np.abs(noise), noise * np.exp(2 * rng.normal(size=(1500, 1))),
              noise * 1e-9, np.repeat(noise[:50], 30, 0)):
        for q in (x[:5], -x[:5]):
            s = q @ x.T
            s[np.arange(5), np.arange(5)] = -np.inf
            want = -np.sort(-s, axis=1)[:, :20]
            seeds = -np.sort(-s[:, :600], axis=1)[:, 19]                                    # a first threshold
            for floor in (np.full(5, -np.inf), seeds, want[:, 19]):
                got = {i: (found, scores) for i, found, scores in ann.scan(q, ids[:5], floor, x, ids, turn)}
                for i in range(5):
                    assert i not in got[i][0] and np.allclose(got[i][1], (x[got[i][0]] * q[i]).sum(1), rtol=1e-12)
                near = sum((scores >= want[i, 19] - 1e-9 * abs(want[i, 19])).sum() for i, (_, scores) in got.items())
                assert near >= 99


def test_scan_ties_repeats_and_ends():
    """Ties at the threshold go to the smaller id, a repeated id counts once with its best row."""
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    v = rng.normal(size=32)
    x = np.concatenate([np.repeat(v[None], 700, 0), 2 * v[None], np.zeros((0, 32))])
    ids = np.r_[np.arange(700, 0, -1), 9]
    ((i, got, scores),) = ann.scan(v[None], np.array([3]), np.array([v @ v]), x, ids, turn)
    assert i == 0 and got.tolist() == [9, 1, 2, *range(4, 9), *range(10, 22)] and np.allclose(scores, [2 * (v @ v)] + 19 * [v @ v])
    assert list(ann.scan(v[None], np.array([3]), np.array([np.inf]), x, ids, turn)) == []
    assert list(ann.scan(v[None], np.array([3]), np.array([-np.inf]), x[:1], np.array([3]), turn)) == []
    many = rng.normal(size=(600, 32))                                                       # more queries than one group
    assert [i for i, _, _ in ann.scan(many, np.arange(600), np.full(600, -np.inf), many, np.arange(600), turn)] == list(range(600))


def test_recall_on_other_rows(spark, monkeypatch):
    """Rows in a few narrow groups, off the origin, and queries unlike the other rows, with few seeds and
    tables larger than what the lists are fitted and the probes are chosen on."""
    monkeypatch.setattr(ann, "SEED_ROWS", 64)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 1000)
    monkeypatch.setattr(ann, "TEST_ROWS", 1000)
    monkeypatch.setattr(ann, "LONG_ROWS", 100)
    monkeypatch.setattr(ann, "LIST_ROWS", 100)
    rng = np.random.default_rng(6)
    noise, asks = rng.normal(size=(4000, 64)), np.arange(4000) % 20 == 0
    groups = unit(unit(rng.normal(size=(40, 64)))[rng.integers(0, 40, 4000)] + 0.05 * noise)
    strange = np.where(asks[:, None], 0.01 * rng.normal(size=(4000, 64)), groups)
    long = np.where(rng.random((4000, 1)) < 0.008, 100, 1) * unit(noise)
    for x in (groups, noise + 5, strange, long):
        assert recall(spark, [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]) >= 0.9
