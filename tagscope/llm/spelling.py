"""Spelling variants by Bloom-guided neighbourhoods: operator 11.

A vocabulary is counted over all texts.  Two of its words are near if they differ
by exactly one inserted, deleted or replaced code point; a word's form is its most
frequent near word, where that is clearly more frequent.

The near words are found without comparing words with each other:

1. The vocabulary is written into blocked Bloom filters, one shard per word length
   (lengths from ``LAST_SHARD`` on share one).  A word sets ``BITS`` bits of one
   block of 512.
2. The filters go to all executors.  Every word's edits are hashed from the word's
   own hash (one multiplication an edit) and probed in the shard of their length.
   Deletions find the pairs of lengths that differ; of the replacements of one
   position only those by a larger letter are made, so each pair is found once,
   from its longer or smaller word.
3. Only positives become texts and are shuffled to a join with the vocabulary,
   which removes the filters' errors.

Broadcast size: a filter takes ``BITS_PER_WORD`` bits a word and never more than
``MAX_FILTER_BYTES``: a vocabulary beyond that is cut by hash into as many slices as
needed, each with filters of its own, and every word's edits are probed in all of
them.  The result is the same.

Defined cases: null texts hold no words; a null id reads "null" in the rule that
deletes a code point; repeated rows count each; an empty table gives an empty
result; other columns are not read, so their names cannot clash.  Words of any
length take part; long words are probed in pieces of positions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagscope.llm.common import id_key, staged
from tagscope.llm.textgrid import BYTE_HASH, U, mixed, powers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, FORM_RATIO, DELETE_EVERY = 6, 5, 5, 199   # fixed values: the contract's
LAST_SHARD = 64
BITS_PER_WORD, BITS, BLOCK = 16, 7, 512
MAX_FILTER_BYTES = 32 << 20
EDITS_AT_ONCE = 1 << 20
_STEP = 0x9E3779B97F4A7C15
PAIRS = "word string, n long, near string"


# ---- vocabulary ---------------------------------------------------------------------

def _one_dropped(doc_id: Column, run: Column) -> Column:
    """The run, without one code point where the id's and run's crc32 says so."""
    h = F.crc32(F.concat(id_key(doc_id), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DELETE_EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))) \
        .otherwise(run)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least 6 code points and 5 occurrences over all texts.

    Runs shorter than a word are never made rows; counting combines in each task
    before the shuffle, so a frequent word costs one row a task."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))
    words = docs.select(F.col(doc_id).alias("id"), F.explode(runs).alias("run")).select(_one_dropped(F.col("id"), F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


# ---- hashes of words and of their edits ----------------------------------------------

def _grouped(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, letters as a matrix) for the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer("".join([words[i] for i in at]).encode("latin-1"), np.uint8).reshape(len(at), n)


def _raw(letters: np.ndarray) -> np.ndarray:
    return (BYTE_HASH[letters] * powers(letters.shape[1])).sum(axis=1, dtype=U)


def _final(raw: np.ndarray, length: int) -> np.ndarray:
    return mixed(raw + U(length * _STEP & 0xFFFFFFFFFFFFFFFF))


class Filters:
    """Where a word's bits lie; with ``lanes`` also the bits themselves."""

    def __init__(self, words_of_shard: dict[int, int], slices: int = 1):
        self.slices = slices
        self.blocks = np.zeros(LAST_SHARD + 1, np.int64)
        for shard, n in words_of_shard.items():
            self.blocks[shard] = max(1, math.ceil(n / slices * BITS_PER_WORD / BLOCK))
        self.offset = np.cumsum(self.blocks) - self.blocks
        self.lanes: np.ndarray | None = None

    def slice_of(self, h: np.ndarray) -> np.ndarray:
        return (h & U(0xFFFF)) % U(self.slices)

    def block(self, h: np.ndarray, length: int) -> np.ndarray:
        shard = min(length, LAST_SHARD)
        return ((h >> U(32)) * U(self.blocks[shard]) >> U(32)).astype(np.int64) + self.offset[shard]

    def bit(self, h2: np.ndarray, i: int) -> np.ndarray:
        return (h2 >> U(9 * i)) & U(511)

    def hits(self, h: np.ndarray, length: int, slice_no: int) -> np.ndarray:
        """Places of the hashes whose bits are all set."""
        if not self.blocks[min(length, LAST_SHARD)]:
            return np.zeros(0, np.int64)
        at = np.arange(len(h)) if self.slices == 1 else np.flatnonzero(self.slice_of(h) == slice_no)
        h = h[at]
        base, h2 = self.block(h, length) * 8, mixed(h ^ U(_STEP))
        for i in range(BITS):
            b = self.bit(h2, i)
            ok = (self.lanes[base + (b >> U(6)).astype(np.int64)] >> (b & U(63))) & U(1) == 1
            at, base, h2 = at[ok], base[ok], h2[ok]
        return at


def _set_bits(words: DataFrame, layout: Filters, slice_no: int) -> np.ndarray:
    """All lanes of one slice's filters.  The driver receives the filters only
    (one row per used block), at most ``MAX_FILTER_BYTES`` of bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, letters in _grouped(batch.column(0).to_pylist()):
                h = _final(_raw(letters), letters.shape[1])
                h = h[layout.slice_of(h) == slice_no]
                if not len(h):
                    continue
                block, inverse = np.unique(layout.block(h, letters.shape[1]), return_inverse=True)
                bits, h2 = np.zeros((len(block), 8), U), mixed(h ^ U(_STEP))
                for i in range(BITS):
                    b = layout.bit(h2, i)
                    np.bitwise_or.at(bits, (inverse, (b >> U(6)).astype(np.int64)), U(1) << (b & U(63)))
                yield pa.RecordBatch.from_arrays([pa.array(block), *[pa.array(bits[:, k].view(np.int64)) for k in range(8)]],
                                                 names=["block", *[f"l{k}" for k in range(8)]])

    rows = words.select("word").mapInArrow(run, "block long, " + ", ".join(f"l{k} long" for k in range(8))) \
        .groupBy("block").agg(*[F.bit_or(f"l{k}").alias(f"l{k}") for k in range(8)]).toArrow()
    lanes = np.zeros((int(layout.blocks.sum()), 8), U)
    at = rows.column("block").to_numpy()
    for k in range(8):
        lanes[at, k] = rows.column(f"l{k}").to_numpy().view(U)
    return lanes.reshape(-1)


def _texts(letters: np.ndarray) -> list[str]:
    n, flat = letters.shape[1], letters.tobytes().decode("latin-1")
    return [flat[i:i + n] for i in range(0, len(flat), n)]


def _near_candidates(letters: np.ndarray, alphabet: np.ndarray, filters: Filters, slice_no: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows of ``letters``, candidate texts): edits that pass the filters."""
    count, length = letters.shape
    step = powers(length)
    terms = BYTE_HASH[letters] * step
    raw = terms.sum(axis=1, dtype=U)
    # deletions: all letters behind the gap move by one; a repeated letter is deleted once
    before = np.cumsum(terms, axis=1, dtype=U) - terms
    shifted = BYTE_HASH[letters[:, 1:]] * step[:length - 1]
    behind = np.zeros((count, length), U)
    behind[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=U)[:, ::-1]
    row, at = np.nonzero(np.diff(letters, axis=1, prepend=np.uint8(0)) != 0)
    hit = filters.hits(_final((before + behind)[row, at], length - 1), length - 1, slice_no)
    if len(hit):
        kept = np.ones((len(hit), length), bool)
        kept[np.arange(len(hit)), at[hit]] = False
        yield row[hit], _texts(letters[row[hit]][kept].reshape(len(hit), length - 1))
    # replacements by a larger letter, a piece of positions at a time
    width = max(1, EDITS_AT_ONCE // (len(alphabet) * count))
    for lo in range(0, length, width):
        part = letters[:, lo:lo + width]
        row, at, new = np.nonzero(alphabet[None, None, :] > part[:, :, None])
        old = part[row, at]
        at = at + lo
        h = raw[row] + (BYTE_HASH[alphabet[new]] - BYTE_HASH[old]) * step[at]
        hit = filters.hits(_final(h, length), length, slice_no)
        if len(hit):
            changed = letters[row[hit]]
            changed[np.arange(len(hit)), at[hit]] = alphabet[new[hit]]
            yield row[hit], _texts(changed)


def near_pairs(words: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n): every pair of near words once.

    ``words`` (word, n) is read several times, so pass a staged table."""
    spark = words.sparkSession
    shards = {r["shard"]: r["n"] for r in words.groupBy(F.least(F.char_length("word"), F.lit(LAST_SHARD)).alias("shard"))
              .agg(F.count("*").alias("n")).collect()}                 # at most 59 rows
    letters = words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()    # at most 90 rows
    alphabet = np.array(sorted(ord(r["c"]) for r in letters if r["c"]), np.uint8)
    slices = max(1, math.ceil(sum(shards.values()) * BITS_PER_WORD / 8 / max_filter_bytes))
    dealt = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    found = None
    for slice_no in range(slices):
        layout = Filters(shards, slices)
        layout.lanes = _set_bits(words, Filters(shards, slices), slice_no)
        sent = spark.sparkContext.broadcast(layout)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, slice_no=slice_no) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for at, letters in _grouped(names):
                    some = max(1, EDITS_AT_ONCE // (letters.shape[1] * len(alphabet)))
                    for lo in range(0, len(at), some):
                        for row, texts in _near_candidates(letters[lo:lo + some], alphabet, sent.value, slice_no):
                            row = at[lo + row]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([names[i] for i in row], pa.string()), pa.array(counts[row]), pa.array(texts, pa.string())],
                                names=["word", "n", "near"])

        part = dealt.mapInArrow(run, PAIRS)
        found = part if found is None else found.unionByName(part)
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(exact, "near").select("word", "n", "near", "near_n")


# ---- forms and roots -------------------------------------------------------------------

def _roots(forms: DataFrame, n_max: int) -> DataFrame:
    """(word, root) for words that have a form, by doubling.  Each step multiplies
    the count by 5 at least, so a chain is at most log5(n_max / 5) long."""
    longest = max(1, math.ceil(math.log(max(n_max, MIN_COUNT) / MIN_COUNT, FORM_RATIO)))
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = staged(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return roots


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n."""
    words = staged(vocabulary(docs, doc_id, text), "spelling-words")
    pairs = near_pairs(words, max_filter_bytes)
    # each pair counts for both of its words; a word has at most as many rows here as it has edits
    both = pairs.select(F.explode(F.array(
        F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("other_n")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), "other")).alias("best"))
    near = words.join(best, "word", "left").withColumn("form_n", -F.col("best.k")) \
        .withColumn("clear", F.coalesce(F.col("form_n") >= FORM_RATIO * F.col("n"), F.lit(False))) \
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(F.col("clear"), F.col("best.other")).alias("form"), F.when(F.col("clear"), F.col("form_n")).alias("form_n"))
    near = staged(near, "spelling-near")
    n_max = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(near.filter(F.col("form").isNotNull()), n_max)
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
