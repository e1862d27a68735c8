import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagscope.llm import queries, ranked_search as rs
from tests.llm.conftest import SF, odd_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    """Every item against every document, by the contract's formula."""
    counted = [(d, Counter(t)) for d, text in docs if (t := terms_of(text))]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        asked, scored = Counter(terms_of(text)), []
        for d, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def result(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "漢字", "it", "s", "x" * 300]
    def text(n):
        return " ".join(rng.choice(words[:1 + int(len(words) * rng.random() ** 2)]) + rng.choice(["", ".", "'s", "\n"]) for _ in range(n))
    docs = [(i // 2 if i % 9 == 0 else i, text(rng.choice([0, 1, 5, 40, 300]))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(None, docs[7][1]), (None, None)]
    items = [(i, text(rng.choice([1, 4, 20, 60]))) for i in range(25)]
    items += [(90, items[3][1]), (91, items[3][1] + " " + items[4][1]), (3, items[3][1]), (92, ""), (93, None), (None, "w1 w1 w2"), (94, "nowhere")]
    return docs, items


def frames(spark, corpus):
    return (spark.createDataFrame(corpus[0], "doc_id long, text string").repartition(5),
            spark.createDataFrame(corpus[1], "item_id long, text string"))


def test_against_every_pair(spark, corpus):
    assert result(rs.search(*frames(spark, corpus))) == plain(*corpus)


def test_small_blocks_slices_and_merges(spark, corpus, monkeypatch):
    monkeypatch.setattr(rs, "CELLS", 1500)
    monkeypatch.setattr(rs, "KEPT_ROWS", 10)
    assert result(rs.search(*frames(spark, corpus), k=7, slice_terms=100)) == plain(*corpus, k=7)


def test_items_share_nodes(spark, corpus):
    terms = rs.item_terms(frames(spark, corpus)[1].withColumn("item", F.monotonically_increasing_id()))
    elements, nodes, uses = (x.toArrow() for x in rs.mine(terms))
    wanted = sum(r.k for r in terms.collect())
    assert len(uses) < wanted / 2                                    # sums per item, of nodes and of single elements
    assert max(nodes.column("items").to_pylist()) > 5 and max(nodes.column("depth").to_pylist()) <= rs.BAND
    # a plan is exact: every item's nodes hold each of its elements once
    plan = rs.Plan(elements, nodes, uses)
    held = {}
    for r in terms.collect():
        held.setdefault(r["item"], Counter())[r.term.encode()] = r.k
    for i, item in enumerate(plan.items):
        got = Counter()
        stop = plan.item_first[i + 1] if i + 1 < len(plan.items) else len(plan.item_nodes)
        for n in plan.item_nodes[plan.item_first[i]:stop]:
            while n >= 0:
                got[plan.node_class[n]] += 1
                n = plan.node_parent[n]
        assert max(got.values()) == 1
        back = Counter()
        for t, no in plan.terms.items():
            lo = plan.term_first[no]
            back[t] = sum(plan.term_class[j] in got for j in range(lo, lo + plan.term_count[no]))
        assert +back == held[item]


def test_pieces_of_long_texts(monkeypatch):
    raw = ("añb cc 12 " * 500 + "z" * 300).encode()
    whole = rs.count_terms(raw, {b"cc": 0, "añb".encode(): 1})
    monkeypatch.setattr(rs, "PIECE_BYTES", 7)
    assert rs.count_terms(raw, {b"cc": 0, "añb".encode(): 1}) == whole == (1501, Counter({b"cc": 500, "añb".encode(): 500}))


def test_query_on_whole_tables(spark):
    read = {t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, "text").collect()]
            for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))}
    assert result(queries.QUERIES["op12_ranked_search"](spark, SF)) == plain(read["documents"], read["benchmark"])


def test_odd_rows_and_empty_tables(spark, docs):
    rows, items = odd_rows(), [(1, "one two three"), (2, "w1x1 w5x5 ONE"), (2, None)]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("x")).withColumn("doc_id", F.lit(5))
    df = docs(rows).withColumn("item", F.lit("y")).withColumn("rank", F.lit("z")).withColumn("terms", F.lit("t"))
    assert result(rs.search(df, asked)) == plain([r[:2] for r in rows], items)
    assert result(rs.search(docs([]), asked)) == Counter()
    assert result(rs.search(df, asked.limit(0))) == Counter()
    assert pa.types.is_int64(rs.search(df, asked).select("score").toArrow().schema.field("score").type)
