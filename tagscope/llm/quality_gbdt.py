"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagscope.llm import hashed
from tagscope.llm.common import Renamed, held_out
from tagscope.llm.textgrid import Block, blocks

MAX_TRAIN_ROWS = 20_000   # labelled rows the trees are fitted on, at most
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
MIN_HESSIAN = 2.0
L2 = 1.0

BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "blank": b" \t", "newline": b"\n", "stop": b".", "comma": b",", "bang": b"!?", "quote": b"\"'`", "bar": b"|",
    "hash": b"#", "star": b"*", "money": b"$", "percent": b"%", "amp": b"&", "angle": b"<>", "brace": b"{}[]()",
    "slash": b"/\\", "under": b"_=+~^@", "colon": b":;", "dash": b"-", "high": bytes(range(128, 256)),
}
STATS = ("log_words", "log_bytes", "word_length", "word_length_spread", "longest_word", "words_a_line", "log_lines",
         "repeated_lines", "empty_lines", "distinct_words", "top_word", "same_as_before", "repeated_pairs", "repeated_triples",
         "upper_words", "no_letter_words", "symbol_end_words", *BYTE_CLASSES)


def statistics(block: Block) -> np.ndarray:
    """Statistics of each text, one row of ``STATS`` per text."""
    n, words = block.n, block.n_words
    per_word, per_byte = np.maximum(words, 1), np.maximum(block.size, 1)
    length = (block.word_stop - block.word_start).astype(float)
    doc = block.word_doc

    def by_doc(values, owner=doc):
        return np.bincount(owner, values, n) if len(owner) else np.zeros(n)

    mean = by_doc(length) / per_word
    spread = np.sqrt(np.maximum(by_doc(length * length) / per_word - mean * mean, 0))
    longest, top = np.zeros(n), np.zeros(n)
    hashes = block.word_hashes()
    times = block.repeats(hashes, doc)
    if len(doc):
        np.maximum.at(longest, doc, length)
        np.maximum.at(top, doc, times)
    line, line_doc, worded = block.lines()
    n_lines = np.bincount(line_doc, minlength=n)
    line_times = block.repeats(line, line_doc)
    same = np.zeros(len(doc), bool)
    if len(doc) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    windows = []
    for k in (2, 3):
        h, at = block.word_windows(hashes, k)
        windows.append(by_doc((block.repeats(h, doc[at]) > 1).astype(float), doc[at]) / per_word)
    kinds = np.zeros((256, len(BYTE_CLASSES)), bool)
    for j, members in enumerate(BYTE_CLASSES.values()):
        kinds[list(members), j] = True
    running = {}
    for j, name in enumerate(BYTE_CLASSES):
        running[name] = block.count_where(kinds[block.data, j]) - (1 if name == "newline" else 0)
    is_upper, is_lower = kinds[block.data, 0], kinds[block.data, 1] | kinds[block.data, len(BYTE_CLASSES) - 1]
    sums = [np.concatenate([[0], np.cumsum(m)]) for m in (is_upper, is_lower)]
    upper, lower = (s[block.word_stop] - s[block.word_start] for s in sums)
    letter_end = np.zeros(256, bool)
    letter_end[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.,;:") + list(range(128, 256))] = True
    odd_end = ~letter_end[block.data[block.word_stop - 1]] if len(doc) else np.zeros(0, bool)
    columns = [
        np.log1p(words), np.log1p(block.size), mean, spread, longest, words / np.maximum(n_lines, 1), np.log1p(n_lines),
        by_doc((line_times > 1) & worded, line_doc) / np.maximum(n_lines, 1), by_doc(~worded, line_doc) / np.maximum(n_lines, 1),
        by_doc(1 / np.maximum(times, 1)) / per_word, top / per_word, by_doc(same) / per_word, *windows,
        by_doc((upper > 1) & (lower == 0)) / per_word, by_doc((upper == 0) & (lower == 0)) / per_word, by_doc(odd_end) / per_word,
        *[running[name] / per_byte for name in BYTE_CLASSES]]
    return np.stack(columns, 1).astype(float)


@dataclass(frozen=True)
class Forest:
    """Complete trees of equal depth, flattened: inner node i of a tree has the
    children 2i+1 and 2i+2, and leaves follow the inner nodes."""
    feature: np.ndarray      # (trees, inner nodes)
    limit: np.ndarray        # (trees, inner nodes): left when the value is <= limit
    value: np.ndarray        # (trees, leaves)
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values: all trees of all rows go down together."""
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.limit[tree, node])
        return self.prior + self.value[tree, node - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return hashed.sigmoid(self.raw(x)) if len(x) else np.zeros(0)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees on logistic loss.  Values are put into at most ``BINS``
    quantile bins once; every level sums gradients by (node, feature, bin) in
    one histogram and splits each node where the gain is largest (ties: first
    feature, lowest limit).  Both kinds of label weigh the same in total."""
    n, f = x.shape
    inner, leaves = 2 ** depth - 1, 2 ** depth
    empty = Forest(np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)), 0.0)
    if not n or y.min() == y.max():
        return Forest(empty.feature, empty.limit, empty.value, 0.0 if not n else (3.0 if y.max() else -3.0))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    limits = np.full((f, BINS), np.inf)
    for j, e in enumerate(edges):
        limits[j, :len(e)] = e
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    z = np.zeros(n)
    out_f, out_l, out_v = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    cell = binned + np.arange(f) * BINS
    for t in range(trees):
        p = hashed.sigmoid(z)
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            flat = (cell + ((node - first) * f * BINS)[:, None]).ravel()
            gs, hs = (np.bincount(flat, np.repeat(v, f), width * f * BINS).reshape(width, f, BINS).cumsum(2) for v in (g, h))
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs ** 2 / (hs + L2) + (ga - gs) ** 2 / (ha - hs + L2) - ga ** 2 / (ha + L2)
            gain[(hs < MIN_HESSIAN) | (ha - hs < MIN_HESSIAN) | np.isinf(limits)[None]] = 0
            best = gain.reshape(width, -1).argmax(1)
            split = gain.reshape(width, -1).max(1) > 1e-9
            at = np.arange(first, first + width)
            out_f[t, at] = np.where(split, best // BINS, 0)
            out_l[t, at] = np.where(split, limits[best // BINS, best % BINS], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), out_f[t, node]] > out_l[t, node])
        leaf = node - inner
        gl, hl = (np.bincount(leaf, v, leaves) for v in (g, h))
        out_v[t] = -rate * gl / (hl + L2)
        z += out_v[t][leaf]
    return Forest(out_f, out_l, out_v, 0.0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality") -> Forest:
    """Fit on at most ``max_rows`` labelled rows that are not held out.  Only
    statistics of the text enter; without labels of both kinds the score is
    constant."""
    sample = hashed.labelled_rows(docs, labels, F.col(label), max_rows, doc_id, text)
    everything = np.arange(len(STATS))
    features, y = hashed.collect_features(sample, lambda block: [(everything, row) for row in statistics(block)], max_rows)
    return fit_trees(np.array([v for _, v in features]).reshape(len(y), len(STATS)), y)


def score_documents(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every column of ``docs`` that the caller keeps, plus ``score`` (0 to 1)
    and ``predicted`` (1 if score >= 0.5).

    Null text counts as empty and gets the score of an empty text.  Rows are
    scored one by one, so repeated rows agree; ids are not read.  Columns called
    score or predicted are replaced.  The whole text counts, however long.
    """
    kept = docs.drop("score", "predicted")

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        # the trees see float32, as they did in training
        parts = [forest.score(statistics(block).astype(np.float32).astype(float)) for _, _, block in blocks(texts)]
        pa.default_memory_pool().release_unused()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return kept.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    forest = fit(docs, labels, doc_id=doc_id, text=text)
    scored = score_documents(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), forest)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged."""
    names = Renamed(docs)
    forest = fit(docs, labels, doc_id=doc_id, text=text)
    return names.back(score_documents(names.df, forest, names.name(doc_id), names.name(text)).where("predicted = 1"))
