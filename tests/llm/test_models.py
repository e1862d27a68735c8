import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagscope.llm import hashed, quality_gbdt, quality_rules, queries, toxicity
from tagscope.llm.textgrid import Block, blocks
from tests.llm.conftest import SF, odd_rows

SF_MODEL = "/root/testdata/sf0.1"


def rule_counts(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return [len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


TEXTS = ["", None, " \n\n ", "a", "a b a b a b a b", "x\ny\nx\n \n\nx", "ß é 漢字 |#|", "a b c\na b c\nq a b c d", "same line\nsame line\r\nsame line",
         "w " * 5000, "\x0b\x0ca\x1cb\xa0c\x85", "\n".join(["l1", "l2"] * 50)]


def test_rule_counts():
    for limit in (1, 40, 1 << 20):
        got = [row for _, _, b in blocks(pa.array(TEXTS), limit) for row in quality_rules.counts(b).tolist()]
        assert got == [rule_counts(t) for t in TEXTS]


def test_statistics_do_not_depend_on_neighbours():
    alone = np.concatenate([quality_gbdt.statistics(b) for _, _, b in blocks(pa.array(TEXTS), 1)])
    together = np.concatenate([quality_gbdt.statistics(b) for _, _, b in blocks(pa.array(TEXTS))])
    assert np.isfinite(alone).all() and np.allclose(alone, together) and alone.shape[1] == len(quality_gbdt.STATS)
    w = np.random.default_rng(0).normal(size=(hashed.DIM, 2))
    families = tuple(range(6))
    a, b = (np.concatenate([hashed.scores(x, families, w) for _, _, x in blocks(pa.array(TEXTS), n)]) for n in (1, 1 << 20))
    assert np.allclose(a, b)
    c = np.array([[(w[i, m] * v).sum() for m in (0, 1)] for _, _, x in blocks(pa.array(TEXTS)) for i, v in hashed.rows(x, families)])
    assert np.allclose(a, c)


def test_trees_learn_and_flat_traversal_agrees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    forest = quality_gbdt.fit_trees(x, y, trees=30)
    assert ((forest.score(x) > 0.5) == (y > 0)).mean() > 0.97

    def walk(row):
        total = forest.prior
        inner = forest.feature.shape[1]
        for f, lim, val in zip(forest.feature, forest.limit, forest.value):
            node = 0
            while node < inner:
                node = 2 * node + 1 + (row[f[node]] > lim[node])
            total += val[node - inner]
        return total

    assert np.allclose(forest.raw(x[:50]), [walk(r) for r in x[:50]])
    for none in (np.zeros(0), np.ones(4)):
        assert quality_gbdt.fit_trees(x[:len(none)], none).score(x[:3]).shape == (3,)
    assert quality_gbdt.Forest(forest.feature, forest.limit, forest.value, 0.0).score(x[:0]).shape == (0,)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 0), (6, 0, 1), (7, None, None), (None, 0, 1), (6, 1, 1), (99, 0, 0)]])
def test_odd_rows(spark, docs, labels):
    df, marks = docs(odd_rows()), labels_of(spark, labels)
    q = quality_gbdt.classify(df, marks).collect()
    assert len(q) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in q)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in q)
    kept = quality_gbdt.keep_good(df, marks)
    assert kept.columns == df.columns and {r.score for r in kept.collect()} <= {"x3"}
    assert kept.count() == sum(r.predicted for r in q)
    rules = quality_rules.apply_rules(df, quality_rules.fit(df, marks)).collect()
    assert sorted([r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in rules) == sorted(rule_counts(r[1]) for r in odd_rows())
    t = toxicity.score_documents(df, toxicity.fit(df, marks)).collect()
    assert len(t) == len(odd_rows()) and all(0 <= r.p_toxic <= 1 for r in t)
    none = docs([])
    assert quality_gbdt.classify(none, marks).count() == quality_rules.apply_rules(none, quality_rules.fit(none, marks)).count() == 0
    assert toxicity.score_documents(none, toxicity.fit(none, marks)).count() == 0


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(label) - n1)


def held(spark, df, score, label):
    marks = spark.read.parquet(f"{SF_MODEL}/labels.parquet").toPandas()
    m = df.toPandas().merge(marks, on="doc_id")
    m = m[[zlib.crc32(str(i).encode()) % 3 == 1 for i in m.doc_id]]
    return m[score].to_numpy(float), m[label].to_numpy(int), m


def test_quality_held_out(spark):
    s, y, m = held(spark, queries.op4_quality_trees(spark, SF_MODEL), "score", "quality")
    assert auc(s, y) > 0.99 and m.held_out.all() and ((s >= 0.5) == y).mean() > 0.98


def test_toxicity_held_out(spark):
    s, y, m = held(spark, queries.op6_toxicity_chain(spark, SF_MODEL), "p_toxic", "toxic")
    assert m.flagged[y == 1].mean() > 0.85 and m.flagged[y == 0].mean() < 0.03


def test_rules_held_out(spark):
    df = queries.op8_quality_rules(spark, SF_MODEL)
    s, y, m = held(spark, df, "probability", "quality")
    assert auc(s, y) > 0.99
    # calibrated: in the mean the probability is the share of good texts
    assert abs(s.mean() - y.mean()) < 0.05
    assert not m.kept[m.base_failed].any()


def test_scores_see_the_text_only(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    base = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality_gbdt.fit(base, labels)
    rows = [(i, "some words of prose. " * 9, lang, src, 0) for i, (lang, src) in enumerate([("en", "a"), ("de", "b"), (None, None)])]
    assert len({r.score for r in quality_gbdt.score_documents(docs(rows, extra=False), forest).collect()}) == 1
    again = quality_gbdt.fit(base.repartition(7), labels.repartition(3))
    assert np.array_equal(again.limit, forest.limit) and np.array_equal(again.value, forest.value)


def test_platt_scale():
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000) * 3
    y = (rng.uniform(size=4000) < hashed.sigmoid(0.5 * z - 1)).astype(float)
    a, b = hashed.fit_scale(z, y)
    assert abs(a - 0.5) < 0.06 and abs(b + 1) < 0.15
    assert hashed.fit_scale(z[:3], np.ones(3)) == (1.0, 0.0)


def test_empty_block():
    b = Block([])
    assert quality_rules.counts(Block([b""])).tolist() == [[0] * 5] and b.n == 0
