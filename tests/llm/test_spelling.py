import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagscope.llm import common, queries, spelling
from tests.llm.conftest import SF, odd_rows


def plain_vocabulary(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1:]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 5}


def plain_groups(vocab):
    """(word, form, root, n, n_near, form_n) by trying every edit in a set."""
    letters = sorted({c for w in vocab for c in w})
    out = {}
    for w, n in vocab.items():
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = [e for e in edits if e != w and e in vocab]
        best = min(near, key=lambda e: (-vocab[e], e), default=None)
        form = best if best is not None and vocab[best] >= 5 * n else None
        out[w] = (form, n, len(near), vocab.get(form))
    rows = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, k, m))
    return rows


def plain(rows):
    return plain_groups(plain_vocabulary(rows))


def result(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def noisy():
    """Texts of words with misspellings, long words, chains of forms and ties."""
    rng = random.Random(11)
    base = ["library", "spelling", "variant", "éclairé", "straße", "neighbour", "aabbccdd", "zzzzzzz", "x" * 80, "y" * 200 + "z"]
    texts = []
    for i in range(400):
        words = []
        for _ in range(60):
            w = rng.choice(base[:1 + rng.randrange(len(base))])
            if rng.random() < 0.3:
                p, c = rng.randrange(len(w)), rng.choice("abcéz")
                w = rng.choice([w[:p] + w[p + 1:], w[:p] + c + w[p:], w[:p] + c + w[p + 1:]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        texts.append((i, " ".join(words)))
    chain = "chainsa " * 5 + "chainsb " * 25 + "chainsbb " * 125 + "chainsbbb " * 700 + "tieword " * 5 + "tiewore " * 30 + "tieworf " * 30
    return texts + [(10_000, chain)]


def test_against_all_edits(spark, noisy):
    want = plain(noisy)
    assert sum(r[1] is not None for r in want) > 20 and sum(r[2] != r[1] and r[1] is not None for r in want) > 0
    df = spark.createDataFrame(noisy, "doc_id long, text string").repartition(6)
    assert result(spelling.spelling_groups(df)) == want


def test_slices_of_the_vocabulary_change_nothing(spark, noisy):
    df = spark.createDataFrame(noisy, "doc_id long, text string")
    assert result(spelling.spelling_groups(df, max_filter_bytes=200)) == plain(noisy)


def test_small_pieces_of_positions(spark, noisy, monkeypatch):
    words = sorted(plain_vocabulary(noisy))
    monkeypatch.setattr(spelling, "EDITS_AT_ONCE", 100)
    layout = spelling.Filters(Counter(min(len(w), spelling.LAST_SHARD) for w in words))
    layout.lanes = spelling._set_bits(spark.createDataFrame([(w,) for w in words], "word string"),
                                      spelling.Filters(Counter(min(len(w), spelling.LAST_SHARD) for w in words)), 0)
    alphabet = spelling.np.array(sorted({ord(c) for w in words for c in w}), spelling.np.uint8)
    found = set()
    for at, letters in spelling._grouped(words):
        for row, texts in spelling._near_candidates(letters, alphabet, layout, 0):
            found |= {tuple(sorted((words[at[i]], t))) for i, t in zip(row, texts) if t in set(words)}
    want = {tuple(sorted((w, e))) for w in words for i in range(len(w)) for e in
            {w[:i] + w[i + 1:]} | {w[:i] + chr(c) + w[i + 1:] for c in alphabet} if e != w and e in set(words)}
    assert found == want


def test_filters_keep_false_positives_low(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(20_000)})
    shards = {9: len(words)}
    layout = spelling.Filters(shards)
    layout.lanes = spelling._set_bits(spark.createDataFrame([(w,) for w in words], "word string"), spelling.Filters(shards), 0)
    def hit(ws):
        letters = spelling.np.frombuffer("".join(ws).encode(), spelling.np.uint8).reshape(len(ws), 9)
        return len(layout.hits(spelling._final(spelling._raw(letters), 9), 9, 0))
    assert hit(words) == len(words)
    assert hit(["".join(rng.choice("ijklmnop") for _ in range(9)) for _ in range(20_000)]) < 200


def test_query_on_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.QUERIES["op11_spelling_groups"](spark, SF)) == plain(rows)


def test_odd_rows_and_empty_table(spark, docs):
    rows = odd_rows() + [(None, "repeated " * 7, None, None, None)] * 2
    df = docs(rows).withColumn("word", F.lit("w")).withColumn("form", F.lit("f")).withColumn("run", F.lit("r"))
    assert result(spelling.spelling_groups(df)) == plain([r[:2] for r in rows])
    assert result(spelling.spelling_groups(docs([]))) == set()


def test_staged_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    df = spark.createDataFrame([(i, "spelling spelling spellings") for i in range(30)], "doc_id long, text string")
    assert {r.word for r in spelling.spelling_groups(df).collect()} >= {"spelling", "spellings"}
    assert list(tmp_path.iterdir()) and common.clear_staged(spark) >= 2
    assert list(tmp_path.iterdir()) == []
