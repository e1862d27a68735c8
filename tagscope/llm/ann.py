"""Approximate nearest neighbours by inner product: inverted lists, scanned
with adaptive use of dimensions.

All vectors are turned by one random rotation, so any prefix of the dimensions
is a random sample of the whole.  Inside each probed list the inner products
grow by column blocks; after each block a hypothesis test compares the partial
product with the query's current 20th best: a candidate x of cosine c with the
query q is c * q and a part across q whose direction is random, so its partial
product is c * a, a being the share of |q|^2 in the columns so far, and a chance
part of deviation sqrt((1 - c^2) * a * (1 - a) / (dims - 1)), both times
|q| * |x|.  A candidate whose product is more than ``Z`` deviations below what
the 20th best would show is abandoned; this holds for any rows, near copies
too.  Survivors are scored again on the original vectors.

Every row is indexed.  The model is fitted on bounded samples: rotation and
centroids on ``SAMPLE_ROWS`` rows and the ``LONG_ROWS`` longest ones, and the
number of lists to probe is the smallest that finds ``COVERAGE`` of the true
neighbours of ``PROBE_QUERIES`` of the queries, among ``TEST_ROWS`` rows the
centroids have not seen and the longest (small tables: among all rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagscope.llm.common import staged

SAMPLE_ROWS = 16_000      # rows the lists are fitted on, at most
TEST_ROWS = 16_000        # further rows among which the number of probes is chosen, at most
LONG_ROWS = 1024          # longest rows, which win by inner product, added to both, at most
SEED_ROWS = 4096          # of them, rows every query is compared with for a first threshold
PROBE_QUERIES = 256       # queries for which the number of probes is chosen, at most
LIST_ROWS = 400           # rows a list should have, about
MAX_LISTS = 2048
CELL_ROWS = 2048          # vectors, and queries, that meet in one cell, about
COVERAGE = 0.97
COLUMNS = 16              # dimensions added between two tests
SCAN_ROWS = 512           # candidates between two updates of the threshold
SCAN_QUERIES = 256        # queries scanned together
PAIRS = 4096              # pairs whose columns are gathered at once
FEW = 0.125               # share of pairs left below which only these are multiplied
Z = 4.0
TOP = 20


@dataclass(frozen=True)
class Lists:
    """Centroids live in the space with one more coordinate, sqrt(longest^2 -
    |x|^2), where nearest by distance is largest by inner product."""
    rotation: np.ndarray
    centroids: np.ndarray
    longest: float
    probes: int
    seed_ids: np.ndarray
    seeds: np.ndarray

    def extended(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared, but for |x|^2, to every centroid."""
        return (self.centroids ** 2).sum(1) - 2 * (x @ self.centroids.T)


def valid_vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v: array<double>) of the vectors that take part: id and vector not
    null, no null or non-finite component, not zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.select(F.col(vec_id).alias("id"), v.alias("v")) \
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))


def norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, c: a + c * c))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=float).reshape(-1, dims)


def sampled(rows: DataFrame, dims: int, n: int, *order: Column) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the first ``n`` rows, by ``order`` and a hash."""
    got = rows.orderBy(*order, F.xxhash64("id", "v"), "id").limit(n).toArrow()
    return np.asarray(got.column("id").combine_chunks()), matrix(got.column("v"), dims)


def fit(vectors: DataFrame, asked: DataFrame, dims: int, total: int, longest: float, top: int = TOP) -> Lists:
    """Fit the lists on the rows with the smallest hashes and the longest."""
    # twice as many rows as needed are ordered, not the first of every partition
    n = SAMPLE_ROWS + TEST_ROWS
    some = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(2 * n / total * (1 << 30))
    ids, x = sampled(vectors.where(some), dims, n)
    if len(x) < min(n, total):
        ids, x = sampled(vectors, dims, n)
    query_ids, q = sampled(asked, dims, PROBE_QUERIES)
    if total > len(x):
        long_ids, long = sampled(vectors, dims, LONG_ROWS, norm("v").desc())
        new = ~np.isin(long_ids, ids)
        long_ids, long = long_ids[new], long[new]
    else:
        long_ids, long = ids[:0], x[:0]
    return fitted(ids, x, long_ids, long, query_ids, q, total, longest, top)


def fitted(ids: np.ndarray, x: np.ndarray, long_ids: np.ndarray, long: np.ndarray, query_ids: np.ndarray, q: np.ndarray,
           total: int, longest: float, top: int = TOP) -> Lists:
    """The model from ``SAMPLE_ROWS`` rows and test rows after them (x), the
    longest rows and queries."""
    dims = x.shape[1]
    rng = np.random.default_rng(7)
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    learned = np.concatenate([x[:SAMPLE_ROWS], long])
    k = max(1, min(MAX_LISTS, total // LIST_ROWS, len(learned)))
    model = Lists(rotation, np.zeros((1, dims + 1)), longest, 1, ids[:SEED_ROWS], x[:SEED_ROWS])
    ext = model.extended(learned)
    centroids = ext[rng.choice(len(ext), k, replace=False)]
    for _ in range(8 if k > 1 else 1):
        near = ((centroids ** 2).sum(1) - 2 * ext @ centroids.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, ext[:, j], k) for j in range(dims + 1)], 1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    model = Lists(rotation, centroids, longest, 1, model.seed_ids, model.seeds)
    # rows the centroids were fitted on lie nearer to them than others do
    skip = SAMPLE_ROWS if total > len(x) and len(x) > SAMPLE_ROWS else 0
    test_ids, test = np.concatenate([ids[skip:], long_ids]), np.concatenate([x[skip:], long])
    own = model.distances(model.extended(test)).argmin(1)
    place = model.distances(np.column_stack([q, np.zeros(len(q))])).argsort(1, kind="stable").argsort(1)
    needed = []
    for i in range(len(q)):
        other = np.flatnonzero(test_ids != query_ids[i])
        at = other[best(test_ids[other], exact(q[i], test[other]), top)]
        needed.extend(place[i, own[at]].tolist())
    needed.sort()
    probes = needed[min(len(needed) - 1, int(np.ceil(COVERAGE * len(needed))))] + 1 if needed else 1
    return Lists(rotation, centroids, longest, probes, model.seed_ids, model.seeds)


def best(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Positions of the best ``top`` distinct ids: score down, then id up."""
    order = np.lexsort((ids, -scores))
    first = np.unique(ids[order], return_index=True)[1]
    return order[np.sort(first)][:top]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, each row summed in the same way."""
    return (x * q).sum(1)


def least(limit: np.ndarray, share: np.ndarray, dims: int) -> np.ndarray:
    """The least partial product, by |q| * |x|, that a candidate of the cosine
    ``limit`` or more shows, but for ``Z`` deviations, in columns that hold
    ``share`` of |q|^2."""
    chance = np.sqrt(share * np.maximum(1 - share, 0)) * min(1.0, Z / np.sqrt(max(dims - 1, 1)))
    # c * share - sqrt(1 - c^2) * chance falls with c down to ``lowest`` and grows after it
    lowest = -share / np.maximum(np.hypot(share, chance), 1e-300)
    c = np.clip(limit, lowest, 1)
    return np.where(limit > 1, np.inf, c * share - np.sqrt(1 - c * c) * chance)


def merged(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of every owner's best ``top`` distinct ids, in the order of
    owner, score down, id up, and their ranks from 0."""
    order = np.lexsort((-scores, ids, owner))
    o, i = owner[order], ids[order]
    order = order[np.r_[True, (o[1:] != o[:-1]) | (i[1:] != i[:-1])][:len(order)]]
    order = order[np.lexsort((ids[order], -scores[order], owner[order]))]
    o = owner[order]
    rank = np.arange(len(o)) - np.searchsorted(o, o)
    return order[rank < top], rank[rank < top]


def scan(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, rotation: np.ndarray,
         top: int = TOP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, ids, scores): the best ``top`` of one cell for each
    query, those that reach the query's floor."""
    dims = x.shape[1]
    stops = [*range(COLUMNS, dims, COLUMNS), dims]
    xr, x_length = x @ rotation, np.sqrt((x * x).sum(1))
    names, place = np.unique(ids, return_inverse=True)
    for first in range(0, len(queries), SCAN_QUERIES):
        q = queries[first:first + SCAN_QUERIES]
        own = query_ids[first:first + SCAN_QUERIES]
        qr, q_length = q @ rotation, np.sqrt((q * q).sum(1))
        shares = np.cumsum(qr * qr, 1) / np.maximum((qr * qr).sum(1), 1e-300)[:, None]
        limit = np.array(floor[first:first + SCAN_QUERIES], float)
        kept, kept_at, scores = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for lo in range(0, len(x), SCAN_ROWS):
            rows = slice(lo, lo + SCAN_ROWS)
            lengths = q_length[:, None] * x_length[None, rows]
            with np.errstate(all="ignore"):
                cosine = limit[:, None] / lengths - 1e-9            # less what rounding may change
                # written so that a product that is no number stays
                i, j = np.nonzero(~(cosine > 1) & (own[:, None] != ids[None, rows]))
                sums = np.zeros(lengths.shape)
                for start, stop in zip([0, *stops[:-1]], stops):
                    if not len(i):
                        break
                    if len(i) > FEW * sums.size:
                        sums += qr[:, start:stop] @ xr[rows, start:stop].T
                    else:
                        for at in range(0, len(i), PAIRS):
                            a, b = i[at:at + PAIRS], j[at:at + PAIRS]
                            sums[a, b] += (qr[a, start:stop] * xr[lo + b, start:stop]).sum(1)
                    share = shares[i, stop - 1] if stop < dims else np.ones(len(i))
                    stay = ~(sums[i, j] < lengths[i, j] * least(cosine[i, j], share, dims))
                    i, j = i[stay], j[stay]
            if not len(i):
                continue
            s = np.concatenate([(q[i[at:at + PAIRS]] * x[lo + j[at:at + PAIRS]]).sum(1) for at in range(0, len(i), PAIRS)])
            kept, kept_at, scores = np.concatenate([kept, i]), np.concatenate([kept_at, place[lo + j]]), np.concatenate([scores, s])
            at, rank = merged(kept, kept_at, scores, top)
            kept, kept_at, scores = kept[at], kept_at[at], scores[at]
            full = rank == top - 1
            limit[kept[full]] = np.maximum(limit[kept[full]], scores[full])
        starts = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1]][:len(kept)])
        for a, b in zip(starts, [*starts[1:], len(kept)]):
            yield first + int(kept[a]), names[kept_at[a:b]], scores[a:b]


def search(table: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` marks (a
    condition on ``vec_id``), the ``top`` nearest found among all rows of
    another id, by inner product in double precision; nearest first, ties to
    the smaller id; all candidates, if there are fewer.

    Vectors that are null, zero, of a null id, hold null or non-finite
    components, or are not as long as most, take no part.  Rows that repeat an
    id count as one candidate with its best score, and as one query.  An empty
    table gives no rows.  Other columns are not read.  Lists larger than
    ``CELL_ROWS`` are dealt by id to several cells, lists that more queries
    probe have their vectors meet the queries in several groups.
    """
    spark = table.sparkSession
    id_type = table.schema[vec_id].dataType.simpleString()
    schema = f"query_id {id_type}, vec_id {id_type}, score double"
    vectors = valid_vectors(table, vec_id, vector)
    lengths = vectors.groupBy(F.size("v").alias("dims")).agg(
        F.count("*").alias("n"), F.max(norm("v")).alias("longest")) \
        .orderBy(F.desc("n"), "dims").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id " + id_type + ", rank int, vec_id " + id_type + ", score double")
    dims, total, longest = lengths[0]
    vectors = vectors.where(F.size("v") == dims)
    asked = vectors.withColumnRenamed("id", vec_id).where(is_query).withColumnRenamed(vec_id, "id")
    model = fit(vectors, asked, dims, total, longest, top)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            near = model.distances(model.extended(x)).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], names=["id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                q, ids = matrix(part.column(1), dims), np.asarray(part.column(0))
                lists = np.argsort(model.distances(np.column_stack([q, np.zeros(len(q))])), axis=1, kind="stable")[:, :model.probes]
                floor, near_ids, near_scores = [], [], []
                for i in range(len(q)):
                    other = model.seed_ids != ids[i]
                    s = exact(q[i], model.seeds[other])
                    at = best(model.seed_ids[other], s, top)
                    near_ids.append(model.seed_ids[other][at])
                    near_scores.append(s[at])
                    floor.append(s[at[-1]] if len(at) == top else -np.inf)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(floor, pa.float64()), pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32())),
                    pa.array([a.tolist() for a in near_ids], pa.list_(part.schema.field(0).type)),
                    pa.array([a.tolist() for a in near_scores], pa.list_(pa.float64()))],
                    names=["id", "v", "floor", "lists", "seed_ids", "seed_scores"])

    placed = staged(vectors.mapInArrow(assign, f"id {id_type}, v array<double>, list int"), "ann-lists")
    queries = staged(asked.mapInArrow(
        probe, f"id {id_type}, v array<double>, floor double, lists array<int>, seed_ids array<{id_type}>, seed_scores array<double>"),
        "ann-queries")
    probes = queries.select("id", "v", "floor", F.explode("lists").alias("list"))

    # how finely each list is dealt: one row per list, at most MAX_LISTS of them
    n_rows, n_asks = placed.groupBy("list").agg(F.count("*").alias("rows")), probes.groupBy("list").agg(F.count("*").alias("asks"))
    deal = n_rows.join(n_asks, "list").select(
        "list", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("chunks"), F.ceil(F.col("asks") / CELL_ROWS).cast("int").alias("groups"))
    deal = F.broadcast(deal)

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    cell = ["list", "chunk", "group"]
    left = placed.join(deal, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")) \
        .withColumn("group", every("groups")).select(*cell, "id", "v")
    right = probes.join(deal, "list").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")) \
        .withColumn("chunk", every("chunks")).select(*cell, "id", "v", "floor")

    def meet(vs: pa.Table, qs: pa.Table) -> pa.Table:
        kind = vs.schema.field("id").type
        out: tuple[list, list, list] = ([], [], [])
        if vs.num_rows and qs.num_rows:
            ids, query_ids = np.asarray(vs.column("id").combine_chunks()), np.asarray(qs.column("id").combine_chunks())
            for i, found, scores in scan(matrix(qs.column("v"), dims), query_ids, np.asarray(qs.column("floor").combine_chunks()),
                                         matrix(vs.column("v"), dims), ids, model.rotation, top):
                out[0].append(np.repeat(query_ids[i], len(found)))
                out[1].append(found)
                out[2].append(scores)
        empty = np.zeros(0, np.int64)
        return pa.table([pa.array(np.concatenate(out[0]) if out[0] else empty, kind), pa.array(np.concatenate(out[1]) if out[1] else empty, kind),
                         pa.array(np.concatenate(out[2]) if out[2] else np.zeros(0), pa.float64())], names=["query_id", "vec_id", "score"])

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, schema)
    seeds = queries.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("seed_ids", "seed_scores")).alias("s")) \
        .select("query_id", F.col("s.seed_ids").alias("vec_id"), F.col("s.seed_scores").alias("score"))
    each = found.unionByName(seeds).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select("query_id", "rank", "vec_id", "score")
