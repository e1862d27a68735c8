"""Hashed word and character n-grams with logistic regression, and the bounded
sample of labelled rows that models are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagscope.llm.common import held_out
from tagscope.llm.textgrid import LETTER, LOWER, STEPS, U, Block, blocks, mixed

BITS = 18
DIM = 1 << BITS
# Families of n-grams: name -> seed.  Each family's counts are divided by their
# sum in the text, so a text is scored by the mean weight of its n-grams.
WORDS, PAIRS, HEADS, CHARS3, CHARS4, STEMS = range(6)
SCALE = 12.0


def ngrams(block: Block, families: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash bucket, text) of every n-gram, one pair of arrays per family."""
    words = block.word_hashes(lower=True)
    for family in families:
        if family == WORDS:
            h, owner = words, block.word_doc
        elif family == PAIRS:
            h, at = block.word_windows(words, 2)
            same = words[at] == words[at + 1]
            h, owner = np.where(same, U(12345), h), block.word_doc[at]
        elif family == STEMS:   # words without their punctuation
            h, owner = block.word_hashes(lower=True, kept=LETTER), block.word_doc
        elif family == HEADS:   # first bytes of longer words
            long = block.word_stop - block.word_start >= 5
            at = block.word_start[long]
            h, owner = _bytes(LOWER[block.data], at, 5), block.word_doc[long]
        else:
            n = 3 if family == CHARS3 else 4
            owner = np.repeat(np.arange(block.n), np.maximum(block.size - n + 1, 0))
            first = np.cumsum(np.maximum(block.size - n + 1, 0)) - np.maximum(block.size - n + 1, 0)
            at = np.arange(len(owner)) - first[owner] + block.start[owner]
            h = _bytes(block.data, at, n)
        yield (mixed(h + STEPS[8 + family]) & U(DIM - 1)).astype(np.int64), owner


def _bytes(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(at), U)
    for i in range(n):
        h += data[at + i].astype(U) << U(8 * i)
    return mixed(h)


def rows(block: Block, families: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse features (bucket, value) of each text."""
    found = list(ngrams(block, families))
    out = []
    for i in range(block.n):
        total = np.zeros(0)
        index: list[np.ndarray] = []
        value: list[np.ndarray] = []
        for bucket, owner in found:
            lo, hi = np.searchsorted(owner, [i, i + 1])
            if hi > lo:
                b, c = np.unique(bucket[lo:hi], return_counts=True)
                index.append(b)
                value.append(c * (SCALE / (hi - lo)))
        b = np.concatenate(index) if index else np.zeros(0, np.int64)
        total = np.concatenate(value) if value else total
        out.append((b, total))
    return out


def scores(block: Block, families: tuple[int, ...], weights: np.ndarray) -> np.ndarray:
    """Scaled mean weights of each text's n-grams: (texts, models)."""
    out = np.zeros((block.n, weights.shape[1]))
    for bucket, owner in ngrams(block, families):
        if len(owner):
            n = np.bincount(owner, minlength=block.n)
            for m in range(weights.shape[1]):
                out[:, m] += np.bincount(owner, weights[bucket, m], block.n) * (SCALE / np.maximum(n, 1))
    return out


class Sparse:
    """Training rows as one long list of (row, bucket, value), with dense extras."""

    def __init__(self, features: list[tuple[np.ndarray, np.ndarray]], least_rows: int = 1):
        """Buckets that occur in fewer than ``least_rows`` rows are left out."""
        self.n = len(features)
        if least_rows > 1 and features:
            often = np.bincount(np.concatenate([b for b, _ in features]), minlength=DIM) >= least_rows
            features = [(b[often[b]], v[often[b]]) for b, v in features]
        self.row = np.repeat(np.arange(self.n), [len(b) for b, _ in features])
        bucket = np.concatenate([b for b, _ in features]) if features else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in features]) if features else np.zeros(0)
        self.used, self.column = np.unique(bucket, return_inverse=True)   # only buckets that occur

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], len(self.used))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, dense: np.ndarray | None = None, l2: float = 1e-4,
                 steps: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(bucket weights, dense weights, intercept) by Adam on the whole sample;
    rows of weight 0 are left out."""
    dense = np.zeros((x.n, 0)) if dense is None else dense
    k, d = len(x.used), dense.shape[1]
    p = np.zeros(k + d + 1)
    total = max(weight.sum(), 1e-9)
    prior = np.clip((weight * y).sum() / total, 1e-3, 1 - 1e-3)
    p[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        z = x.times(p[:k]) + dense @ p[k:k + d] + p[-1]
        r = weight * (sigmoid(z) - y) / total
        g = np.concatenate([x.back(r) + l2 * p[:k], dense.T @ r + l2 * p[k:k + d], [r.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.5 * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
    full = np.zeros(DIM)
    full[x.used] = p[:k]
    return full, p[k:k + d], float(p[-1])


def fit_scale(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic calibration of scores (Newton steps);
    targets are pulled in by the counts so that separable scores stay finite."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        s = p * (1 - p)
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        h = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def labelled_rows(docs: DataFrame, labels: DataFrame, label: Column, max_rows: int, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """At most ``max_rows`` labelled rows (id, text, label) that are not held
    out, those with the smallest id hashes; of several labels of an id the
    largest counts.  The bound is on rows only: texts stay whole."""
    chosen = labels.where(label.isNotNull() & ~held_out(F.col(doc_id))) \
        .groupBy(F.col(doc_id).alias("_label_id")).agg(F.max(label.cast("int")).alias("_label")) \
        .orderBy(F.xxhash64("_label_id"), "_label_id").limit(max_rows)
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")) \
        .join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).select("_id", "_text", "_label")


def collect_features(sample: DataFrame, describe: Callable[[Block], list[tuple[np.ndarray, np.ndarray]]],
                     max_rows: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features (bucket, value) and labels of the sample, computed by the
    executors; in the order of the id hash, so refits agree.  At most
    ``max_rows`` rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in blocks(batch.column(1)):
                got = describe(block)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[lo:hi].cast(pa.string()), batch.column(2)[lo:hi].cast(pa.int32()),
                    pa.array([b.astype(np.int32).tobytes() for b, _ in got], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())],
                    names=["id", "label", "bucket", "value"])

    got = sample.mapInArrow(run, "id string, label int, bucket binary, value binary") \
        .orderBy(F.xxhash64("id"), "id", F.xxhash64("bucket", "value")).limit(max_rows).toArrow()
    features = [(np.frombuffer(b.as_py(), np.int32).astype(np.int64), np.frombuffer(v.as_py(), np.float32).astype(float))
                for b, v in zip(got.column("bucket"), got.column("value"), strict=True)]
    return features, got.column("label").to_numpy().astype(float)
