"""Toxicity by a classifier chain over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagscope.llm import hashed
from tagscope.llm.common import held_out
from tagscope.llm.textgrid import Block, blocks

FAMILIES = (hashed.STEMS, hashed.HEADS)
MAX_TRAIN_ROWS = 5000     # labelled rows the chain is fitted on, at most
FOLDS = 3
L2 = 5e-4
LEAST_ROWS = 8            # n-grams of fewer sample rows are not learned (fewer in small samples)
TOXIC_AT = 0.5
# Categories in chain order.  Labels tell toxic from not; a labelled toxic text
# belongs to a category when it holds one of its words, and to "coded" when it
# holds none of any list.  The last link is the label itself.
LEXICON = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser"),
    "degrading": ("trash", "pathetic", "disgusting", "worthless", "scum"),
}
CHAIN = (*LEXICON, "coded", "toxic")


@dataclass(frozen=True)
class Chain:
    """Link k is linear in the n-grams and in the probabilities of links before k."""
    weights: np.ndarray          # (DIM, links)
    earlier: list[np.ndarray]    # link k: k weights
    intercept: np.ndarray

    def probabilities(self, block: Block) -> np.ndarray:
        base = hashed.scores(block, FAMILIES, self.weights)
        p = np.zeros_like(base)
        for k, w in enumerate(self.earlier):
            p[:, k] = hashed.sigmoid(base[:, k] + p[:, :k] @ w + self.intercept[k])
        return p


def category_labels(text, toxic):
    """Column expressions of the category labels of one labelled text."""
    hits = {c: text.rlike("(?i)\\b(" + "|".join(words) + ")") for c, words in LEXICON.items()}
    any_hit = None
    for h in hits.values():
        any_hit = h if any_hit is None else any_hit | h
    return {**{c: (h & (toxic == 1)) for c, h in hits.items()}, "coded": ~any_hit & (toxic == 1), "toxic": toxic == 1}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Chain:
    """Fit the chain on at most ``max_rows`` labelled rows that are not held
    out.  The probabilities a later link learns from are out of fold: each row's
    earlier links were fitted on the other folds.  A link without both kinds of
    label answers its prior."""
    sample = hashed.labelled_rows(docs, labels, F.col(label), max_rows, doc_id, text)
    marks = category_labels(F.coalesce("_text", F.lit("")), F.col("_label"))
    packed = sum((m.cast("int") * (1 << k) for k, m in enumerate(marks.values())), F.lit(0))
    features, bits = hashed.collect_features(sample.withColumn("_label", packed.cast("int")),
                                             lambda block: hashed.rows(block, FAMILIES), max_rows)
    y = np.stack([(bits.astype(int) >> k) & 1 for k in range(len(CHAIN))], 1).astype(float) if len(bits) else np.zeros((0, len(CHAIN)))
    weights, earlier, intercept = np.zeros((hashed.DIM, len(CHAIN)), np.float32), [], np.full(len(CHAIN), -40.0)
    x = hashed.Sparse(features, max(2, min(LEAST_ROWS, len(y) // 200)))
    fold = np.arange(len(y)) % FOLDS
    known = np.zeros((len(y), 0))
    for k in range(len(CHAIN)):
        target, fresh = y[:, k], np.zeros(len(y))
        if len(target) and target.min() < target.max():
            balance = np.where(target > 0, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
            for f in range(FOLDS):
                w, d, b = hashed.fit_logistic(x, target, balance * (fold != f), known, l2=L2)
                z = x.times(w[x.used]) + known @ d + b
                fresh[fold == f] = hashed.sigmoid(z[fold == f])
            w, d, b = hashed.fit_logistic(x, target, balance, known, l2=L2)
            weights[:, k], intercept[k] = w, b
            earlier.append(d)
        else:
            earlier.append(np.zeros(k))
            if len(target) and target.max() > 0:
                intercept[k] = 40.0
        known = np.column_stack([known, fresh])
    return Chain(weights, earlier, intercept)


def score_documents(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, p_<category> in chain order and
    flagged (p_toxic >= 0.5).

    Null text counts as empty; an empty text gets what the intercepts give.
    Ids may be null (held out) or repeat, other columns are not read, whole
    texts count however long.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in blocks(batch.column(1)):
                p = chain.probabilities(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], *[pa.array(p[:, k]) for k in range(len(CHAIN))], pa.array(p[:, -1] >= TOXIC_AT)],
                    names=["doc_id", *[f"p_{c}" for c in CHAIN], "flagged"])

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, ", ".join([f"doc_id {id_type}", *[f"p_{c} double" for c in CHAIN], "flagged boolean"]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *[f"p_{c}" for c in CHAIN], "flagged")
