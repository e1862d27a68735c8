import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tagscope.llm import bpe_automaton as bpe
from tagscope.llm import queries
from tests.llm.conftest import SF, odd_rows


@pytest.fixture(scope="module")
def both():
    path = queries.vocabulary()
    return bpe.load(path), Tokenizer.from_file(path)


def same(both, text):
    mine, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids, text
    assert mine.run(text) == (len(ids), " ".join(map(str, ids)), theirs.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("text", [
    "", " \n ", "a", "It's they'll I'VE 'S", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|><|", "ΑΣ Σ ΟΔΟΣ", "İstanbul ŉ ǅ",
    "é ẛ̣ ﬁ Å", "漢字かな한글", "🙂👍🏽 ​ x\x85y\xa0z\x1cq", "1234.5e-6 ½ Ⅻ", "a" * 5000, "x!" * 3000, "\x00\x7f"])
def test_texts(both, text):
    same(both, text)


def test_random_texts(both):
    rng = random.Random(5)
    parts = list("abehinrst'’.,!0129 \n\tΣςİIéÉ漢🙂\x1c\xa0") + ["<|endoftext|>", "'re", "tion", "ing", "the", "|>"]
    for _ in range(3000):
        same(both, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))))


def test_small_caches(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    monkeypatch.setattr(bpe, "KEPT_STATES", 5)
    same(both, "several different words make the small caches roll over several times " * 5)


def test_automaton_accepts_only_bpe_sequences():
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("ab", "a")]
    labels = {s: i for i, s in enumerate(["a", "b"] + [x + y for x, y in merges])}
    machine = bpe.Automaton(labels, merges)

    def plain(word):
        parts = list(word)
        for x, y in merges:
            i = 0
            while i + 1 < len(parts):
                if parts[i] == x and parts[i + 1] == y:
                    parts[i:i + 2] = [x + y]
                i += 1
        return parts

    def paths(word, before=None):
        if not word:
            yield []
        for s, i in labels.items():
            if word.startswith(s) and (before is None or machine.arc(before, i)):
                for rest in paths(word[len(s):], i):
                    yield [s, *rest]

    for n in range(1, 9):
        for k in range(2 ** n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert list(paths(word)) == [plain(word)], word


def test_documents(spark, docs, both):
    got = bpe.encode_documents(docs(odd_rows()), queries.vocabulary()).collect()
    assert len(got) == len(odd_rows())
    texts = sorted((r[1] or "" for r in odd_rows()))
    want = sorted(both[1].encode(t, add_special_tokens=False).ids for t in texts)
    assert sorted(r.ids for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded == both[1].decode(r.ids, skip_special_tokens=False) == both[0].decode(r.ids)
    assert bpe.encode_documents(docs([]), queries.vocabulary()).count() == 0


def test_query(spark, both):
    rows = {r.doc_id: r for r in queries.op10_bpe_automaton(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = both[1].encode(d.text, add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
