"""Ranked lexical search for many items at once: operator 12.

Every item's text is a query over all documents; items share work:

1. **Mining.** The k-th occurrence of a term in an item is an element.  Elements
   that occur in exactly the same items form a class.  Classes whose item sets have
   the same smallest hash lie together and are cut into bands of ``BAND`` by falling
   item count; the part of a band that an item holds is one of its patterns.  Equal
   patterns of several items, and equal beginnings of patterns, are one node each.
2. **Accumulators.** A document's partial score is computed once per class, then
   once per node: the node of a shorter beginning plus one class.
3. **Combination.** An item's score is the sum over its patterns' nodes, so what
   items share is added up once per document.

All of an item's elements are in exactly one of its patterns, so the sum is the
item's full score.  The mining runs as grouped aggregates over the items' terms;
what the tasks need of it (terms, classes, nodes) is broadcast.  Its size is bounded:
items are dealt by hash into slices of about ``SLICE_TERMS`` terms (one slice for all
but very large item tables), each evaluated over the documents' postings of its own
terms.

Documents are tokenised once per slice; the postings of the items' terms go to a
table in the shared folder.  A document is scored where its postings lie.  Each task
keeps the k best documents of every item, and two grouped steps (first by item and a
share of the tasks) take the k best of all, so no group grows with the documents.

Defined cases: null texts hold no terms; documents without terms count neither in N
nor in L; every row is a document, and an item, of its own, also when it repeats an
id; ties go to the smaller doc_id, null last; items without terms, or without a
document above 0, have no rows; empty tables give an empty result; other columns are
not read.  Ids of documents are integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagscope.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"       # fixed value: the term rule
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")                # the same over UTF-8 bytes
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
TOP = 20
BAND = 8
SLICE_TERMS = 1 << 18
PIECE_BYTES = 4 << 20
CELLS = 1 << 21             # of the largest matrix of a block of documents
SALTS = 1024
KEPT_ROWS = 1 << 18


# ---- mining the items -----------------------------------------------------------------

def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, k): an item's terms with the number of their occurrences."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM_RE), F.lit(0))
    return items.select("item", F.explode(terms).alias("term")).groupBy("item", "term").agg(F.count("*").alias("k"))


def mine(terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements, nodes, uses) of the query-sharing graph.

    elements: term, class — one row per element.
    nodes:    node, parent (null: none), class, depth, items (how many share it).
    uses:     item, node — the nodes whose sum is the item's score.
    """
    element = terms.select("item", "term", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("occurrence"))
    grouped = element.groupBy("term", "occurrence").agg(
        F.bit_xor(F.xxhash64("item", F.lit(1))).alias("a"), F.bit_xor(F.xxhash64("item", F.lit(2))).alias("b"),
        F.min(F.xxhash64("item", F.lit(3))).alias("least"), F.count("*").alias("n"))
    elements = grouped.withColumn("class", F.xxhash64("a", "b", "n"))
    # bands: classes of one least hash, by falling number of items
    classes = elements.groupBy("class").agg(F.first("least").alias("least"), F.first("n").alias("n"))
    order = Window.partitionBy("least").orderBy(F.desc("n"), "class")
    banded = classes.withColumn("place", F.row_number().over(order) - 1).withColumn("band", F.floor(F.col("place") / BAND))
    held = element.join(elements.select("term", "occurrence", "class"), ["term", "occurrence"]).select("item", "class").distinct()
    pattern = held.join(banded, "class").groupBy("item", "least", "band") \
        .agg(F.sort_array(F.collect_list(F.struct("place", "class"))).alias("p")) \
        .select("item", F.col("p.class").alias("p"))                      # at most BAND classes
    nodes = pattern.groupBy("p").agg(F.count("*").alias("n")) \
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda d: F.slice("p", F.lit(1), d))).alias("q"), "n") \
        .groupBy("q").agg(F.sum("n").alias("items")) \
        .select(F.xxhash64("q").alias("node"), F.when(F.size("q") > 1, F.xxhash64(F.slice("q", F.lit(1), F.size("q") - 1))).alias("parent"),
                F.element_at("q", -1).alias("class"), F.size("q").alias("depth"), "items")
    return elements.select("term", "class"), nodes, pattern.select("item", F.xxhash64("p").alias("node"))


class Plan:
    """The graph as arrays: terms with their classes, nodes by depth, items' nodes."""

    def __init__(self, elements: pa.Table, nodes: pa.Table, uses: pa.Table):
        classes = np.unique(elements.column("class").to_numpy())
        texts = sorted(set(elements.column("term").to_pylist()))
        self.terms = {t.encode(): i for i, t in enumerate(texts)}
        number = np.array([self.terms[t.encode()] for t in elements.column("term").to_pylist()], np.int64)
        order = np.argsort(number, kind="stable")
        self.term_class = np.searchsorted(classes, elements.column("class").to_numpy())[order]
        self.term_count = np.bincount(number, minlength=len(texts))       # elements of each term
        self.term_first = np.cumsum(self.term_count) - self.term_count
        self.n_classes = len(classes)
        depth = nodes.column("depth").to_numpy()
        order = np.argsort(depth, kind="stable")
        key = nodes.column("node").to_numpy()[order]
        by_key = np.argsort(key)
        place = {int(k): int(i) for k, i in zip(key[by_key], by_key)}
        self.levels = np.searchsorted(depth[order], np.arange(1, (depth.max() if len(depth) else 0) + 2))
        self.node_class = np.searchsorted(classes, nodes.column("class").to_numpy()[order])
        parents = nodes.column("parent").to_pylist()
        self.node_parent = np.array([place.get(parents[i], -1) for i in order], np.int64)
        self.n_nodes = len(key)
        item = uses.column("item").to_numpy()
        order = np.argsort(item, kind="stable")
        self.items, self.item_first = np.unique(item[order], return_index=True)
        self.item_nodes = np.array([place[int(k)] for k in uses.column("node").to_numpy()[order]], np.int64)
        self.weights: np.ndarray | None = None                            # of each term, once df is known

    def scores(self, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int) -> np.ndarray:
        """(items x documents) scores from the postings' gains of a block."""
        times = self.term_count[term]
        flat = np.repeat(self.term_first[term], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        per_class = np.zeros((self.n_classes, n_docs), np.int64)
        np.add.at(per_class, (self.term_class[flat], np.repeat(doc, times)), np.repeat(gain, times))
        acc = np.empty((self.n_nodes, n_docs), np.int64)
        for lo, hi in zip(self.levels[:-1], self.levels[1:]):
            acc[lo:hi] = per_class[self.node_class[lo:hi]]
            if lo:                                                        # deeper than the first level
                acc[lo:hi] += acc[self.node_parent[lo:hi]]
        return np.add.reduceat(acc[self.item_nodes], self.item_first, axis=0)


# ---- postings ---------------------------------------------------------------------------

def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``PIECE_BYTES``, cut between terms."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        gap = _GAP.search(raw, at + PIECE_BYTES)
        if gap is None:
            break
        yield raw[at:gap.start()]
        at = gap.start()
    yield raw[at:] if at else raw


def count_terms(raw: bytes, terms: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of all terms of a text, and the counts of those in ``terms``."""
    n, found = 0, Counter()
    for piece in pieces(raw):
        words = _TERM.findall(piece.lower())       # bytes: only A-Z change
        n += len(words)
        found.update(filter(terms.__contains__, words))
    return n, found


def postings(docs: DataFrame, plan) -> DataFrame:
    """Per document with a term: doc_id, n (terms), terms and tfs (of the items' terms)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = plan.value.terms
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    n, found = count_terms(text.as_buffer().to_pybytes(), terms) if text.is_valid else (0, {})
                    if n:
                        rows.append((doc_id, n, [terms[t] for t in found], list(found.values())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


# ---- scores -------------------------------------------------------------------------------

class Best:
    """The k best documents of each item so far: (item, score, null mark, doc_id)."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.floor = np.zeros(n_items, np.int64)      # scores below (or 0) cannot enter any more
        self.rows = np.zeros((0, 4), np.int64)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, scores: np.ndarray, doc_ids: np.ndarray, none: np.ndarray) -> None:
        item, doc = np.nonzero((scores > 0) & (scores >= self.floor[:, None]))
        self.parts.append(np.stack([item, scores[item, doc], none[doc], doc_ids[doc]], axis=1))
        self.held += len(item)
        if self.held > KEPT_ROWS + 2 * len(self.rows):
            self.merge()

    def merge(self) -> None:
        rows = np.concatenate([self.rows, *self.parts])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        self.rows = rows[np.arange(len(rows)) - first < self.k]
        item, n = np.unique(self.rows[:, 0], return_counts=True)
        last = np.cumsum(n) - 1
        full = n == self.k
        self.floor[item[full]] = self.rows[last[full], 1]
        self.parts, self.held = [], 0


def best_of_tasks(held: DataFrame, plan, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        best = Best(len(p.items), k)
        block = max(1, CELLS // max(p.n_nodes, p.n_classes, len(p.item_nodes), 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                term, tf = part.column("terms").flatten().to_numpy(), part.column("tfs").flatten().to_numpy()
                length = part.column("terms").value_lengths().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), length)
                m = 100 - 25 + (25 * part.column("n").to_numpy() * n_docs) // n_terms
                gain = p.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                ids = part.column("doc_id")
                best.add(p.scores(doc, term, gain, part.num_rows), ids.fill_null(0).to_numpy(),
                         ids.is_null().to_numpy(zero_copy_only=False))
        best.merge()
        rows = best.rows
        for lo in range(0, len(rows), 10_000):
            r = rows[lo:lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(p.items[r[:, 0]]), pa.array(r[:, 3], mask=r[:, 2] == 1), pa.array(r[:, 1])],
                                             names=["item", "doc_id", "score"])

    return held.mapInArrow(run, "item long, doc_id long, score long")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_slice(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    elements, nodes, uses = mine(item_terms(items))
    plan = Plan(elements.toArrow(), nodes.toArrow(), uses.toArrow())      # bounded by the slice
    sent = spark.sparkContext.broadcast(plan)
    held = staged(postings(docs, sent), "search-postings")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.ln((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).toArrow()
    plan.weights = np.zeros(len(plan.terms), np.int64)
    plan.weights[df.column("term").to_numpy()] = df.column("w").to_numpy()
    best = best_of_tasks(held, spark.sparkContext.broadcast(plan), n_docs, n_terms, k)
    salted = _first(best.withColumn("salt", F.spark_partition_id() % SALTS), ["item", "salt"], k)
    return _first(salted.drop("rank", "salt"), ["item"], k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", slice_terms: int = SLICE_TERMS) -> DataFrame:
    """Each item's k best documents: item_id, rank, doc_id, score."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = staged(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
                   .withColumn("item", F.monotonically_increasing_id()), "search-items")
    terms = asked.agg(F.sum(F.regexp_count("text", F.lit(TERM_RE)))).first()[0] or 0
    slices = max(1, -(-terms // slice_terms))
    found = None
    for s in range(slices):
        part = _search_slice(rows, asked if slices == 1 else asked.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == s), k)
        found = part if found is None else found.unionByName(part)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
