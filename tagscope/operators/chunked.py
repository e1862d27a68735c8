"""Skew-safe sequential helpers: previous/next row, forward fill, running sum, n-th row.

A plain ``Window.partitionBy('TagName')`` sends a whole tag to one task; a tag
holding a third of a 100 TB history would then be a single task.  Every helper
here instead partitions by ``(keys, chunk)`` (a time slice by default), does
the sequential step inside each chunk, and repairs the chunk edges from a
per-chunk summary table.  The summary has one row per non-empty chunk, so the
only window that spans a whole tag runs over ``span / chunk`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagscope.functions.timecols import epoch_seconds_trunc

DEFAULT_CHUNK_SECONDS = 3600
CK = "_ck"

# Adaptive chunking (off when None): each key gets its own chunk width so its
# densest hour holds about this many rows per chunk.
ADAPTIVE_TARGET_ROWS: int | None = None
MAX_CHUNK_SECONDS = 86400
CONF_TARGET_ROWS = "spark.tagscope.chunkTargetRows"


def chunk_seconds() -> int:
    """Current chunk width (module setting, read at plan-build time)."""
    return DEFAULT_CHUNK_SECONDS


def time_chunk(col: str | Column, seconds: int | None = None) -> Column:
    """Chunk number of a timestamp: ``floor(epoch seconds / width)``.  Any
    monotone function of time is a valid chunking, so the cheap truncated
    epoch seconds are used."""
    seconds = seconds or chunk_seconds()
    return F.floor(epoch_seconds_trunc(col) / F.lit(seconds)).cast("long")


def index_chunk(col: str | Column, size: int = 4096) -> Column:
    """Chunk number of an integer position (bucket or instant index)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(size)).cast("long")


def _default_chunk(order: Sequence[str], chunk: Column | None) -> Column:
    return chunk if chunk is not None else time_chunk(order[0])


def adaptive_target(df: DataFrame) -> int | None:
    """Rows per chunk for adaptive chunking: the session setting
    ``spark.tagscope.chunkTargetRows`` wins over the module default."""
    v = df.sparkSession.conf.get(CONF_TARGET_ROWS, None)
    return int(v) if v else ADAPTIVE_TARGET_ROWS


SPAN = 4096


def explode_span(df: DataFrame, lo: Column, hi: Column, out: str, deal: Sequence[str] | None = None) -> DataFrame:
    """One row per integer from ``lo`` to ``hi`` (none when ``hi < lo``), in two
    steps, so that no row ever holds an array longer than ``SPAN`` or the span
    divided by ``SPAN``.  (``explode_outer`` of sequences that are never empty: plain
    ``explode`` infers a filter on their size and makes each twice.)  With ``deal`` the pieces are dealt out by these columns
    and their number between the steps, so that a long span is not one task's work."""
    d = df.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).filter(F.col("_lo") <= F.col("_hi"))
    piece = F.sequence(F.floor(F.col("_lo") / SPAN), F.floor(F.col("_hi") / SPAN))
    d = d.withColumn("_piece", F.explode_outer(piece))
    if deal is not None:
        d = d.repartition(*deal, "_piece")
    own = F.sequence(F.greatest(F.col("_lo"), F.col("_piece") * SPAN), F.least(F.col("_hi"), F.col("_piece") * SPAN + SPAN - 1))
    return d.withColumn(out, F.explode_outer(own)).drop("_lo", "_hi", "_piece")


def forward_runs(d: DataFrame, keys: Sequence[str], order: str, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Each row with the next row's ``order`` (and ``carry`` columns) of its key as
    ``next_<column>``, in two parts: the rows that have a successor in their own chunk,
    and the last row of every chunk (``next_`` is NULL on a key's last row).  The
    second part also has ``_first``: a key's least ``order`` on its first chunk's row,
    NULL on the others.

    ``d`` holds the chunk column and is partitioned by (keys, chunk), see
    ``shuffled_by_chunk``.  The second part has one row per chunk and comes from a
    window over those alone; no join puts the parts together."""
    keys = list(keys)
    cols = [c for c in d.columns if c not in keys and c != CK]
    new = [order, *carry]
    w = Window.partitionBy(*keys, CK).orderBy(order)
    inside = d.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in new]) \
        .filter(F.col(f"next_{order}").isNotNull()).select(*keys, *cols, *[f"next_{c}" for c in new])
    edges = d.groupBy(*keys, CK).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_row"),
                                     F.min_by(F.struct(*new), F.col(order)).alias("_begin"))
    over = Window.partitionBy(*keys).orderBy(CK)
    tail = edges.select(*keys, *[F.col("_row")[c].alias(c) for c in cols], F.lead("_begin").over(over).alias("_next"),
                        F.when(F.lag(F.lit(1)).over(over).isNull(), F.col("_begin")[order]).alias("_first"))
    return inside, tail.select(*keys, *cols, *[F.col("_next")[c].alias(f"next_{c}") for c in new], "_first")


def filled_grid(df: DataFrame, keys: Sequence[str], order: str, lo: int, hi: int, size: int = 4096) -> DataFrame:
    """A row for every whole number from ``lo`` to ``hi`` (all of ``order`` lie there)
    of each key: the columns of ``df`` and ``_own``.  Numbers without a row of ``df``
    have ``_own`` false and the other columns of the row before them (NULL before the
    first)."""
    keys = list(keys)
    inside, tail = forward_runs(shuffled_by_chunk(df, keys, order, index_chunk(order, size)), keys, order)
    cols = [c for c in df.columns if c not in keys and c != order]
    nxt = f"next_{order}"
    own = F.struct(F.col(order).cast("long").alias("_from"), F.coalesce(nxt, F.lit(hi + 1)).cast("long").alias("_to"),
                   F.lit(True).alias("_own"), *cols)
    before = F.struct(F.lit(lo).cast("long").alias("_from"), F.col("_first").cast("long").alias("_to"), F.lit(False).alias("_own"),
                      *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols])
    far = tail.select(*keys, F.inline(F.when(F.col("_first") > lo, F.array(before, own)).otherwise(F.array(own))))
    far = explode_span(far, F.col("_from"), F.col("_to") - 1, "_at", deal=keys)
    near = inside.select(*keys, F.col(order).cast("long").alias("_from"), F.lit(True).alias("_own"), *cols,
                         F.explode_outer(F.sequence(F.col(order).cast("long"), F.col(nxt).cast("long") - 1)).alias("_at"))
    names = [*keys, "_from", "_at", "_own", *cols]
    out = near.select(*names).unionByName(far.select(*names))
    return out.select(*keys, F.col("_at").alias(order), *cols, (F.col("_own") & (F.col("_at") == F.col("_from"))).alias("_own"))


def shuffled_by_chunk(df: DataFrame, keys: Sequence[str], order: str, chunk: Column | None = None) -> DataFrame:
    """Rows with their chunk, hash-partitioned once by ``(keys, chunk)``.

    Both the chunk-edge summary (an aggregate whose distribution this already
    satisfies) and the windowed main pass read this one exchange, which Spark
    reuses: the input is scanned and shuffled once.  Rows with a NULL key are
    dropped (they belong to no series); filtering them here also keeps both
    branches identical, since a join would otherwise add that filter to one side.
    """
    d = with_chunk(df, keys, order, chunk)
    for k in keys:
        d = d.filter(F.col(k).isNotNull())
    return d.repartition(*keys, CK)


def chunk_widths(df: DataFrame, keys: Sequence[str], order: str, target_rows: int) -> DataFrame:
    """Per key: a chunk width (s) putting ~``target_rows`` of its densest hour in one chunk."""
    hour = F.floor(epoch_seconds_trunc(order) / F.lit(3600))
    peak = df.groupBy(*keys, hour.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.max("_n").alias("_peak"))
    w = F.least(F.lit(MAX_CHUNK_SECONDS).cast("long"),
                F.greatest(F.lit(1).cast("long"), F.floor(F.lit(3600.0 * target_rows) / F.col("_peak")).cast("long")))
    return peak.select(*keys, w.alias("_w"))


def with_chunk(df: DataFrame, keys: Sequence[str], order: str, chunk: Column | None = None) -> DataFrame:
    """``df`` plus the chunk column: explicit, adaptive per key, or fixed width."""
    target = adaptive_target(df)
    if chunk is not None or target is None:
        return df.withColumn(CK, _default_chunk([order], chunk))
    # one row per key; broadcast or shuffled as its size at run time says
    j = df.join(chunk_widths(df, keys, order, target), list(keys), "left")
    ck = F.floor(epoch_seconds_trunc(order) / F.coalesce(F.col("_w"), F.lit(DEFAULT_CHUNK_SECONDS))).cast("long")
    return j.withColumn(CK, ck).drop("_w")


def neighbour(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
              direction: int = -1, chunk: Column | None = None, prefix: str | None = None) -> DataFrame:
    """Add, per row, the values of ``cols`` on the previous (``direction=-1``)
    or next (``+1``) row of the same key ordered by the column ``order``.

    New columns are named ``prefix + col`` (default ``prev_`` / ``next_``);
    they are NULL on the first / last row of a key.  ``order`` must be unique
    within a key.  The chunk-edge summary keeps the whole edge row, so that it
    reads exactly the columns of the main pass and both share one exchange.
    """
    prefix = prefix if prefix is not None else ("prev_" if direction < 0 else "next_")
    return neighbours(df, keys, order, {direction: (list(cols), prefix)}, chunk)


def neighbours(df: DataFrame, keys: Sequence[str], order: str, wanted: dict[int, tuple[list[str], str]],
               chunk: Column | None = None) -> DataFrame:
    """``neighbour`` in one or both directions at once: ``wanted`` maps -1
    and/or +1 to (columns, prefix)."""
    keys = list(keys)
    d = shuffled_by_chunk(df, keys, order, chunk)
    row = F.struct(*[F.col(c) for c in d.columns if c not in keys and c != CK])
    names = {-1: "_eprev", 1: "_enext"}
    pick = {-1: F.max_by, 1: F.min_by}
    shift = {-1: F.lag, 1: F.lead}
    edges = d.groupBy(*keys, CK).agg(*[pick[k](row, F.col(order)).alias(names[k]) for k in wanted])
    ws = Window.partitionBy(*keys).orderBy(CK)
    carry = edges.select(*keys, CK, *[shift[k](names[k]).over(ws).alias(names[k]) for k in wanted])
    w = Window.partitionBy(*keys, CK).orderBy(order)
    j = d.join(carry, [*keys, CK], "left")
    # one window pass: the in-chunk neighbours and one chunk-edge marker a direction
    inside = [shift[k](F.lit(1)).over(w).isNull().alias(f"_edge{names[k]}") for k in wanted]
    inside += [shift[k](c).over(w).alias(f"_s{names[k]}{i}") for k, (cols, _) in wanted.items() for i, c in enumerate(cols)]
    j = j.select("*", *inside)
    new = [F.when(F.col(f"_edge{names[k]}"), F.col(names[k]).getField(c)).otherwise(F.col(f"_s{names[k]}{i}")).alias(prefix + c)
           for k, (cols, prefix) in wanted.items() for i, c in enumerate(cols)]
    return j.select(*[F.col(c) for c in df.columns], *new)


def fill_forward(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], present: str,
                 chunk: Column | None = None) -> DataFrame:
    """Rows where ``present`` is false take ``cols`` from the last earlier row
    of their key where it is true (NULL when there is none)."""
    keys, cols = list(keys), list(cols)
    d = shuffled_by_chunk(df, keys, order, chunk)
    o = F.when(F.col(present), F.col(order))
    edges = d.groupBy(*keys, CK).agg(F.max(o).alias("_eo"),
                                     *[F.max_by(F.col(c), o).alias(f"_e{i}") for i, c in enumerate(cols)])
    before = Window.partitionBy(*keys).orderBy(CK).rowsBetween(Window.unboundedPreceding, -1)
    last_edge = F.last(F.when(F.col("_eo").isNotNull(), F.struct(*[F.col(f"_e{i}") for i in range(len(cols))])),
                       ignorenulls=True).over(before)
    carry = edges.select(*keys, CK, last_edge.alias("_carry"))
    j = d.join(carry, [*keys, CK], "left")
    w = (Window.partitionBy(*keys, CK).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = F.last(F.when(F.col(present), F.struct(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(cols)])),
                    ignorenulls=True).over(w)
    filled = F.coalesce(inside, F.col("_carry"))
    rest = [F.col(c) for c in df.columns if c not in cols]
    return j.select(*rest, *[filled[f"_e{i}"].alias(c) for i, c in enumerate(cols)])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, out: str,
                chunk: Column | None = None) -> DataFrame:
    """Cumulative sum of ``col`` per key in ``order`` (NULLs count as 0)."""
    keys, order = list(keys), list(order)
    d = shuffled_by_chunk(df, keys, order[0], chunk) if len(order) == 1 else \
        df.withColumn(CK, _default_chunk(order, chunk)).repartition(*keys, CK)
    totals = d.groupBy(*keys, CK).agg(F.sum(col).alias("_tot"))
    before = Window.partitionBy(*keys).orderBy(CK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, CK, F.coalesce(F.sum("_tot").over(before), F.lit(0.0)).alias("_carry"))
    j = d.join(carry, [*keys, CK], "left")
    w = (Window.partitionBy(*keys, CK).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.coalesce(F.sum(col).over(w), F.lit(0.0)) + F.col("_carry")
    return j.select(*[F.col(c) for c in df.columns], total.alias(out))


def nth_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
            chunk: Column | None = None) -> DataFrame:
    """Row number ``n`` (0-based) of each key in ``order``; keys with fewer rows vanish.

    Counts per chunk locate the one chunk holding the row, so only that chunk
    of each key is ranked.
    """
    keys, order = list(keys), list(order)
    if n < 0:
        n = 0
    d = shuffled_by_chunk(df, keys, order[0], chunk) if len(order) == 1 else \
        df.withColumn(CK, _default_chunk(order, chunk)).repartition(*keys, CK)
    counts = d.groupBy(*keys, CK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(CK).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, CK, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    target = starts.filter((F.col("_start") <= n) & (F.lit(n) < F.col("_start") + F.col("_n"))).select(*keys, CK, "_start")
    j = d.join(target, [*keys, CK], "inner")
    w = Window.partitionBy(*keys, CK).orderBy(*order)
    ranked = j.withColumn("_rn", F.row_number().over(w) + F.col("_start"))
    return ranked.filter(F.col("_rn") == n + 1).select(*[F.col(c) for c in df.columns])
