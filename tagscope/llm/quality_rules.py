"""Quality rules: counted facts about a text plus a calibrated n-gram model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagscope.llm import hashed
from tagscope.llm.textgrid import Block, blocks

FAMILIES = (hashed.WORDS, hashed.PAIRS, hashed.CHARS3, hashed.CHARS4)
MAX_TRAIN_ROWS = 2500     # labelled rows the model is fitted on, at most
KEEP_AT = 0.5             # fixed threshold on the calibrated probability
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"     # fixed value
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RuleModel:
    weights: np.ndarray       # (DIM, 1)
    intercept: float
    slope: float
    shift: float

    def probability(self, block: Block) -> np.ndarray:
        z = hashed.scores(block, FAMILIES, self.weights)[:, 0] + self.intercept
        return hashed.sigmoid(self.slope * z + self.shift)


def counts(block: Block) -> np.ndarray:
    """The rule counts of each text, in the order of ``COUNTS``."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    line, owner, worded = block.lines()
    line, owner = line[worded], owner[worded]
    lines = np.bincount(owner, minlength=block.n)
    distinct = np.bincount(np.unique(np.stack([owner.astype(np.uint64), line]), axis=1)[0].astype(np.int64), minlength=block.n) \
        if len(line) else np.zeros(block.n, np.int64)
    windows, at = block.word_windows(block.word_hashes(), 3)
    found = at[block.repeats(windows, block.word_doc[at]) > 1]
    covered = np.zeros(len(block.word_doc) + 2, bool)
    for i in range(3):
        covered[found + i] = True
    repeated = np.bincount(block.word_doc[covered[:len(block.word_doc)]], minlength=block.n)
    return np.stack([block.n_words, block.word_chars(), block.count_where(symbol[block.data]), lines - distinct, repeated], 1)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality") -> RuleModel:
    """Fit on at most ``max_rows`` labelled rows that are not held out; every
    fifth of them calibrates the probability instead.  Without labels of both
    kinds the model says 1 for every text."""
    sample = hashed.labelled_rows(docs, labels, F.col(label), max_rows, doc_id, text)
    features, y = hashed.collect_features(sample, lambda block: hashed.rows(block, FAMILIES), max_rows)
    if not len(y) or y.min() == y.max():
        return RuleModel(np.zeros((hashed.DIM, 1), np.float32), 40.0, 1.0, 0.0)
    x = hashed.Sparse(features)
    train = np.arange(len(y)) % 5 != 0
    if y[train].min() == y[train].max() or y[~train].min() == y[~train].max():
        train[:] = True
    balance = np.where(y > 0, 1 / y.mean(), 1 / (1 - y.mean()))
    w, _, b = hashed.fit_logistic(x, y, balance * train)
    checked = ~train if not train.all() else train
    z = x.times(w[x.used]) + b
    slope, shift = hashed.fit_scale(z[checked], y[checked])
    return RuleModel(w.astype(np.float32)[:, None], b, slope, shift)


def apply_rules(docs: DataFrame, model: RuleModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, probability, kept.

    Words are runs of anything but blanks, over the whole text.  A line counts
    as repeated when it holds a word and equals an earlier line; a word as
    repeated when a three-word window around it occurs twice or more.  Null
    text counts as empty: all counts 0, base_failed.  Ids may be null or
    repeat; other columns are not read.  Scored block by block in Arrow batches.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in blocks(batch.column(1)):
                c = counts(block)
                failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])
                p = model.probability(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], *[pa.array(c[:, i]) for i in range(c.shape[1])], pa.array(failed),
                     pa.array(p), pa.array(~failed & (p >= KEEP_AT))],
                    names=["doc_id", *COUNTS, "base_failed", "probability", "kept"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, ", ".join([f"doc_id {id_type}", *[f"{c} long" for c in COUNTS], "base_failed boolean, probability double, kept boolean"]))
