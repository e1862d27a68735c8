import io
import random
import struct
import zlib
from collections import Counter

import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagscope.llm import queries, token_frames as tf
from tests.llm.conftest import SF, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def written(docs, frame_ids):
    sink = io.BytesIO()
    w = tf.FrameWriter(sink, frame_ids)
    for doc_id, ids in docs:
        w.add(doc_id, packed(ids))
    w.close()
    return sink.getvalue()


@pytest.mark.parametrize("frame_ids", [1, 3, 7, 1000])
def test_file_round_trip(frame_ids):
    rng = random.Random(frame_ids)
    docs = [(None, [5])] + [(i, [rng.randrange(1 << 32) for _ in range(rng.choice([0, 1, 2, 30]))]) for i in range(-3, 40)]
    raw = written(docs, frame_ids)
    file = tf.FrameReader(Source(raw))
    assert [None if n else int(d) for d, n in zip(file.doc_ids, file.none)] == [d for d, _ in docs]
    assert [file.ids(i) for i in range(len(docs))] == [packed(ids) for _, ids in docs]
    # the file is a plain zstandard stream too
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(packed(ids) for _, ids in docs)


def test_one_document_reads_only_its_frames():
    raw = written([(i, [i] * 10) for i in range(1000)], 100)
    file = tf.FrameReader(Source(raw))
    assert file.ids(557) == packed([557] * 10) and file.frames_read == 1


def test_damaged_files_are_refused():
    raw = written([(i, list(range(50))) for i in range(20)], 64)
    bad = bytearray(raw)
    bad[len(zstandard.ZstdCompressor(level=tf.LEVEL).compress(packed(range(64)))) // 2] ^= 0xFF
    file = tf.FrameReader(Source(bytes(bad)))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        file.ids(0)
    assert file.ids(19) == packed(range(50))          # other frames can still be read
    for broken in (raw[:-1], raw[1:], b"x" * 40):
        with pytest.raises(ValueError):
            tf.FrameReader(Source(broken))


@pytest.mark.parametrize("text", [
    "", " ", "  two  blanks ", "a b c d e", "it's we'll I 'S don't", "x <|endoftext|> y<|endoftext|>", "line\n\n next \t tab",
    "É é ñ 漢字 かな 🙂 ok", "1 2 3.4 5,6", "a " * 2000, "x" * 5000, "\x00 \x85 \x1c z", "end ", "ab. Cd; ef! gh? ɏ ɐ x"])
def test_ids_are_the_librarys(text):
    plain = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert tf.Encoder(PATH).encode([text, text]) == [packed(plain)] * 2


def test_random_texts_and_small_cache(monkeypatch):
    monkeypatch.setattr(tf.Encoder, "CACHED", 50)
    rng, theirs, mine = random.Random(3), Tokenizer.from_file(PATH), tf.Encoder(PATH)
    parts = list("abcé 漢   \n\t.,!'’0189") + ["<|endoftext|>", " the", "'re", " ing", " ", "ß", "Ā"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(8)]
        assert mine.encode(texts) == [packed(theirs.encode(t, add_special_tokens=False).ids) for t in texts]


def expected(rows):
    """(doc_id, start, n_tokens, crc32) by the library, one row after another."""
    theirs, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    return out


def test_query_against_the_library(spark):
    got = [tuple(r) for r in queries.QUERIES["op13_token_frames"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)


def test_odd_rows(spark, docs, tmp_path):
    df = docs(odd_rows()).withColumn("ids", F.lit(1)).withColumn("start", F.lit(2)).repartition(5)
    got = tf.documents_to_frames(df, str(tmp_path / "a"), PATH, frame_ids=100).collect()
    want = expected([(r[0], r[1]) for r in odd_rows()])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, zlib.crc32(r.ids)) for r in got) \
        == sorted((w[0] is not None, w[0] or 0, w[2], w[3]) for w in want)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(g.n_tokens for g in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
    # only asked documents; a repeated id gives all its rows
    some = tf.read_frames(spark, str(tmp_path / "a"), [1, 7, 999]).collect()
    assert sorted(r.doc_id for r in some) == [1, 1, 7]
    assert {(r.doc_id, r.start, r.ids) for r in some} <= {(r.doc_id, r.start, r.ids) for r in got}


def test_one_id_spreads_over_partitions(spark, tmp_path):
    df = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = tf.ordered_texts(df).select(F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = Counter(r.p for r in parts).values()
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_empty_table_overwrite_and_refusal(spark, docs, tmp_path):
    path = str(tmp_path / "set")
    assert tf.documents_to_frames(docs([]), path, PATH).count() == 0
    with pytest.raises(Exception, match="already holds"):
        tf.documents_to_frames(docs(odd_rows()), path, PATH)
    assert tf.documents_to_frames(docs(odd_rows()), path, PATH, mode="overwrite").count() == len(odd_rows())
    assert tf.documents_to_frames(docs(odd_rows()[:1]), path, PATH, mode="overwrite").count() == 1
    assert len(list((tmp_path / "set").glob("*.zst"))) == 1       # files of the earlier set are gone


def test_given_ids(spark, tmp_path):
    df = spark.createDataFrame([(i, bytearray(packed(range(i)))) for i in range(5)], "doc_id long, ids binary").coalesce(1)
    tf.write_frames(df, str(tmp_path / "g"))
    assert [(r.doc_id, r.start, bytes(r.ids)) for r in tf.read_frames(spark, str(tmp_path / "g")).orderBy("doc_id").collect()] \
        == [(i, sum(range(i)), packed(range(i))) for i in range(5)]
    with pytest.raises(Exception, match="take the columns"):
        df.withColumnRenamed("ids", "text").write.format(tf.FORMAT).option("path", str(tmp_path / "h")).mode("append").save()


def test_other_tokenizers_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some words it's <|endoftext|> here"
    assert tf.Encoder(path).encode([text]) == [packed(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)]
    assert pa.types.is_binary(tf.ARROW_SCHEMA.field("ids").type)
