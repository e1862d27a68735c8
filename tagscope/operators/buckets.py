"""N equal buckets over a range (AGG10-11).

Edges are ``from + (i*T) div N`` seconds, i = 0..N; bucket i (1-based) spans
``[e(i-1), e(i)]`` with the bound kind of the series and is labelled with its
right edge.  A sample finds its buckets by arithmetic: a handful of candidate
numbers around ``x*N/T`` are generated and filtered by exact integer edge
tests, so a sample on an inner edge of a closed bucket lands in both buckets
and no range join is needed.  Empty buckets are added to the reduced rows of each
tag (at most N of them), so the samples are read once.

Every mode is the series a single range of that mode would give, bucket by
bucket: ``raw`` samples in ``[)``, ``closed_raw`` in ``[]``, ``filled`` the
1-second series of the closed bucket, ``seeded`` the same with the last known
values at both edges, ``cyclic`` the held value every minute from the left edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagscope.functions.timecols import US, add_seconds, div, epoch_us, epoch_us_value, seconds_between
from tagscope.operators import pointintime as pit
from tagscope.operators.aggregate import MODES, check_group, raw_agg, weighted_agg
from tagscope.operators.chunked import explode_span, filled_grid, forward_runs, index_chunk, neighbour, shuffled_by_chunk
from tagscope.operators.filters import asked_names, filter_range, filter_tags
from tagscope.operators.resample import fill_runs
from tagscope.operators.tree import SummaryTree, asof_source


def _check_n(n):
    if n is None or n == 0:
        raise ValueError("count is empty")
    if n < 1:
        raise ValueError("count is less than one")


def bucket_members(x_us: str, T: int, n: int, bounds: str) -> F.Column:
    """Array of the 1-based buckets containing a point ``x_us`` µs after ``from``."""
    lo_op = ">=" if bounds[0] == "[" else ">"
    hi_op = "<=" if bounds[1] == "]" else "<"
    if T == 0:
        cond = f"{x_us} {lo_op} 0 and {x_us} {hi_op} 0"
        return F.expr(f"case when {cond} then sequence(1L, {n}L) else array() end")
    lo = f"greatest(1L, cast(floor({x_us} / {US}D * {n} / {T}) as bigint) - 1)"
    hi = f"least({n}L, cast(floor(({x_us} / {US}D + 1) * {n} / {T}) as bigint) + 1)"
    edge = lambda i: f"(({i}) * {T}L div {n}L) * {US}L"
    test = f"{x_us} {lo_op} {edge('b - 1')} and {x_us} {hi_op} {edge('b')}"
    return F.expr(f"case when {lo} <= {hi} then filter(sequence({lo}, {hi}), b -> {test}) else array() end")


def _complete(agg: DataFrame, n: int, tags=None, empty: float | None = None) -> DataFrame:
    """``TagName, i, _v`` for i = 1..N of every tag (every asked one, when the
    request lists tags); buckets without a row get ``empty``.

    The gaps between a tag's rows are found with the chunked lead over the bucket
    numbers and exploded, so the work follows the number of result rows.  An asked
    tag starts with a row for a bucket 0, so one without samples is all gap."""
    rows = agg.select("TagName", F.col("i").cast("long").alias("i"), F.col("_v").cast("double").alias("_v"))
    if tags is not None:
        zero = asked_names(agg.sparkSession, tags).select("TagName", F.lit(0).cast("long").alias("i"), F.lit(None).cast("double").alias("_v"))
        rows = rows.unionByName(zero)
    full = filled_grid(rows, ["TagName"], "i", 0 if tags is not None else 1, n).filter(F.col("i") >= 1)
    return full.select("TagName", "i", F.when(F.col("_own"), F.col("_v")).otherwise(F.lit(empty).cast("double")).alias("_v"))


def _label(df: DataFrame, start, T: int, n: int, value) -> DataFrame:
    right = add_seconds(start, F.floor(F.col("i") * F.lit(T) / F.lit(n)).cast("long"))
    return df.select("TagName", right.alias("DateTime"), value.cast("double").alias("Value"))


def _edge_us(i: str, T: int, n: int) -> str:
    """SQL for the µs offset of edge ``i``: ``(i*T div N)`` seconds, exact integers."""
    return f"((({i}) * {T}L) div {n}L) * {US}L"


def with_bucket_of(df: DataFrame, x_us: str, T: int, n: int, bounds: str) -> DataFrame:
    """Fast path (``N <= T``, bounds ``[)`` or ``[]``): add ``_bk``, the array of
    the 1 or 2 buckets of ``x_us``, without a lambda, so it stays in generated code.

    The estimate ``floor(x*N/T) + 1`` is corrected exactly against the integer
    edges (two rounds of +-1 cover the estimate's rounding and the truncated
    edge); a point on an inner edge of closed buckets also gets the bucket on
    its left.  Each step is its own column, so no expression is repeated.
    """
    d = df.withColumn("_bk", F.expr(f"cast(floor({x_us} / {US}D * {n} / {T}) as bigint) + 1"))
    for _ in range(2):
        d = d.withColumn("_bk", F.expr(f"case when {x_us} < {_edge_us('_bk - 1', T, n)} then _bk - 1 "
                                       f"when {x_us} >= {_edge_us('_bk', T, n)} then _bk + 1 else _bk end"))
    d = d.withColumn("_bk", F.expr(f"least(greatest(_bk, 1L), {n}L)"))
    if bounds == "[]":
        return d.withColumn("_bk", F.expr(f"case when _bk > 1 and {x_us} = {_edge_us('_bk - 1', T, n)} "
                                          f"then array(_bk - 1, _bk) else array(_bk) end"))
    return d.withColumn("_bk", F.array("_bk"))


def bucket_of(x_us: str, T: int, n: int, bounds: str) -> F.Column:
    """Column form of ``with_bucket_of`` (for tests and one-off use)."""
    c = f"cast(floor({x_us} / {US}D * {n} / {T}) as bigint) + 1"
    for _ in range(2):
        c = (f"(case when {x_us} < {_edge_us(f'({c}) - 1', T, n)} then ({c}) - 1 "
             f"when {x_us} >= {_edge_us(c, T, n)} then ({c}) + 1 else ({c}) end)")
    c = f"least(greatest({c}, 1L), {n}L)"
    if bounds == "[]":
        return F.expr(f"case when {c} > 1 and {x_us} = {_edge_us(f'{c} - 1', T, n)} "
                      f"then array({c} - 1, {c}) else array({c}) end")
    return F.expr(f"array({c})")


def _explode_buckets(rows: DataFrame, start, T: int, n: int, bounds: str) -> DataFrame:
    x = rows.withColumn("_x", epoch_us("DateTime") - F.lit(epoch_us_value(start)))
    if 0 < n <= T and bounds in ("[)", "[]"):
        # never empty: explode_outer avoids the inferred size(_bk) > 0 filter,
        # which Catalyst would push down by inlining every step of _bk
        return with_bucket_of(x, "_x", T, n, bounds).withColumn("i", F.explode_outer("_bk")).drop("_x", "_bk")
    x = x.withColumn("_bk", bucket_members("_x", T, n, bounds))
    return x.withColumn("i", F.explode("_bk")).drop("_x", "_bk")


def buckets_raw(history: DataFrame, start, end, n: int, group: str, tags=None, bounds: str = "[)") -> DataFrame:
    """AGG10 over raw samples: ``group`` per bucket (count of an empty bucket is 0)."""
    _check_n(n)
    g = check_group(group)
    T = seconds_between(start, end)
    rows = filter_range(filter_tags(history, tags), start, end, bounds).select("TagName", "DateTime", "Value")
    b = _explode_buckets(rows, start, T, n, bounds).select("TagName", "i", "Value")
    agg = b.groupBy("TagName", "i").agg(raw_agg(g).alias("_v"))
    return _label(_complete(agg, n, tags, 0.0 if g == "count" else None), start, T, n, F.col("_v"))


def _edge_seeds(history, start, end, n: int, tags, tree) -> DataFrame:
    """``TagName, i, DateTime, Value``: the last known value at both edges of
    every bucket, stamped with the edge (none before a tag's first sample)."""
    T = seconds_between(start, end)
    runs = pit.instant_runs(filter_tags(history, tags), start, n + 1, lambda x: pit._first_instant_even(x, T, n), end, tree)
    at = pit.instant_values(runs, n + 1, leading_nulls=False, chunk_size=4096).select("TagName", F.col("i").alias("edge"), "Value")
    sides = F.filter(F.array(F.col("edge"), F.col("edge") + 1), lambda b: (b >= 1) & (b <= n))
    return at.select("TagName", F.explode(sides).alias("i"),
                     add_seconds(start, pit.even_offset(F.col("edge"), T, n)).alias("DateTime"), "Value")


def buckets_filled(history: DataFrame, start, end, n: int, group: str, tags=None, step_seconds: int = 1,
                   seeded: bool = False, tree: SummaryTree | None = None) -> DataFrame:
    """AGG10 over the per-bucket 1-second filled series (closed buckets); with
    ``seeded`` each bucket also holds the last known values at its edges."""
    _check_n(n)
    g = check_group(group)
    T = seconds_between(start, end)
    rows = filter_range(filter_tags(history, tags), start, end, "[]").select("TagName", "DateTime", "Value")
    b = _explode_buckets(rows, start, T, n, "[]")
    if seeded:
        b = b.select("TagName", "i", "DateTime", "Value").unionByName(_edge_seeds(history, start, end, n, tags, tree))
    runs = fill_runs(None, start, end, step_seconds, seeded=False, keys=("TagName", "i"), rows=b)
    runs = runs.select("TagName", "i", "Value", (F.col("next_slot") - F.col("slot")).alias("w"))
    agg = runs.groupBy("TagName", "i").agg(weighted_agg(g).alias("_v"))
    return _label(_complete(agg, n, tags, 0.0 if g == "count" else None), start, T, n, F.col("_v"))


def buckets_cyclic(history: DataFrame, start, end, n: int, group: str, tags=None, step_ms: int = 60000,
                   tree: SummaryTree | None = None, chunk_size: int = 4096) -> DataFrame:
    """AGG10 over the cyclic series of each bucket: the held value at its left
    edge and every ``step_ms`` after it, before the right edge.  ``count`` is
    hours, as for a single range.

    The instants of all buckets are numbered in one row (bucket, then step), a
    sample feeds the first instant at or after it and holds until the next one
    that has a newer sample, and the weight of a run in a bucket is the number
    of its instants there."""
    _check_n(n)
    g = check_group(group)
    T = seconds_between(start, end)
    step_us = step_ms * 1000
    per = -(-(T // n + 1) * US // step_us) + 1       # more than any bucket has
    last_at = pit.from_us_value(epoch_us_value(end))
    src = asof_source(filter_tags(history, tags), start, last_at, tree)
    x = src.withColumn("_x", F.greatest(epoch_us("DateTime") - F.lit(epoch_us_value(start)), F.lit(0).cast("long"))) \
        .filter(F.col("_x") < T * US)
    if 0 < n <= T:
        x = with_bucket_of(x, "_x", T, n, "[)").withColumn("_b", F.explode_outer("_bk")).drop("_bk")   # cuts generated code
    else:
        x = x.withColumn("_b", F.element_at(bucket_members("_x", T, n, "[)"), 1))

    def edge(i):
        return f"({_edge_us(i, T, n)})"

    def steps(i):     # instants of bucket i
        return f"(({edge(i)} - {edge(f'{i} - 1')} + {step_us - 1}L) div {step_us}L)"

    x = x.withColumn("_k", F.expr(f"(_x - {edge('_b - 1')} + {step_us - 1}L) div {step_us}L"))
    over = F.expr(f"_k >= {steps('_b')}")
    x = x.withColumn("i", F.when(over, (F.col("_b") + 1) * F.lit(per)).otherwise(F.col("_b") * F.lit(per) + F.col("_k")))
    runs = x.filter(F.col("i") < (n + 1) * per).groupBy("TagName", "i").agg(*pit.last_sample()).select("TagName", "i", "Value")
    near, tail = forward_runs(shuffled_by_chunk(runs, ["TagName"], "i", index_chunk("i", chunk_size)), ["TagName"], "i")
    nb = near.unionByName(tail.drop("_first"))
    nb = nb.select("TagName", "Value", F.col("i").alias("_from"), F.coalesce("next_i", F.lit((n + 1) * per).cast("long")).alias("_to"))
    each = nb.withColumn("i", F.explode(F.sequence(div(F.col("_from"), per), F.least(div(F.col("_to"), per), F.lit(n).cast("long")))))
    w = F.expr(f"least(_to - i * {per}L, {steps('i')}) - greatest(_from - i * {per}L, 0L)")
    each = each.withColumn("w", w).filter(F.col("w") > 0)
    value = weighted_agg("count") * F.lit(step_ms / 3_600_000) if g == "count" else weighted_agg(g)
    agg = each.groupBy("TagName", "i").agg(value.alias("_v"))
    return _label(_complete(agg, n, tags, 0.0 if g == "count" else None), start, T, n, F.col("_v"))


def buckets_dif_interpolated(history: DataFrame, start, end, n: int, tags=None) -> DataFrame:
    """AGG10 with ``dif`` of interpolated values (raw mode): the value at each
    edge lies on the line between the samples around it; NULL when a side of an
    edge has none.

    Each sample meets the edges between it and the next sample of its tag: an
    explode of the edge numbers of that gap, no join."""
    _check_n(n)
    T = seconds_between(start, end)
    h = filter_tags(history, tags).groupBy("TagName", "DateTime").agg(F.max("Value").alias("Value"))
    nb = neighbour(h, ["TagName"], "DateTime", ["DateTime", "Value"], direction=+1)
    zero = F.lit(epoch_us_value(start))
    lo, hi = epoch_us("DateTime") - zero, epoch_us("next_DateTime") - zero
    first = F.coalesce(pit._first_instant_even(lo, T, n), F.lit(n + 1).cast("long"))
    # up to the last edge before the next sample; a last sample serves only an edge it hits
    after = F.when(F.col("next_DateTime").isNull(), F.when(lo < 0, F.lit(0)).otherwise(
        F.coalesce(pit._first_instant_even(lo + 1, T, n), F.lit(n + 1).cast("long"))))
    upto = F.coalesce(after, F.when(hi <= 0, F.lit(0)).otherwise(F.coalesce(pit._first_instant_even(hi, T, n), F.lit(n + 1).cast("long")))) - 1
    at = explode_span(nb, first, F.least(upto, F.lit(n)), "edge")
    edge_us = zero + pit.even_offset(F.col("edge"), T, n) * F.lit(US)
    b = F.struct(F.col("DateTime").alias("DateTime"), F.col("Value").alias("Value"))
    a = F.when(F.col("next_DateTime").isNotNull(), F.struct(F.col("next_DateTime").alias("DateTime"), F.col("next_Value").alias("Value")))
    v = F.when(edge_us == epoch_us("DateTime"), F.col("Value")).otherwise(pit.interpolate_expr(edge_us, b, a))
    sides = at.select("TagName", v.alias("v"), F.explode(F.array(
        F.struct(F.col("edge").alias("i"), F.lit(True).alias("right")), F.struct((F.col("edge") + 1).alias("i"), F.lit(False).alias("right")))).alias("s"))
    agg = sides.select("TagName", "v", "s.*").filter((F.col("i") >= 1) & (F.col("i") <= n)).groupBy("TagName", "i").agg(
        (F.max(F.when(F.col("right"), F.col("v"))) - F.max(F.when(~F.col("right"), F.col("v")))).alias("_v"))
    return _label(_complete(agg, n, tags), start, T, n, F.col("_v"))


def buckets_dif(history: DataFrame, start, end, n: int, tags=None,
                chunk_size: int = 4096, tree: SummaryTree | None = None) -> DataFrame:
    """AGG10 with ``dif``: as-of value at each right edge minus at the left edge."""
    _check_n(n)
    T = seconds_between(start, end)
    runs = pit.instant_runs(filter_tags(history, tags), start, n + 1, lambda x: pit._first_instant_even(x, T, n), end, tree)
    # edges e+1 .. next-1 have the value of the run that begins at edge e, edge next another one
    d = shuffled_by_chunk(runs.select("TagName", "i", "Value"), ["TagName"], "i", index_chunk("i", chunk_size))
    near, tail = forward_runs(d, ["TagName"], "i", carry=["Value"])
    near = near.select("TagName", "Value", "next_i", "next_Value", F.explode_outer(F.sequence(F.col("i") + 1, F.col("next_i"))).alias("b"))
    own = F.struct((F.col("i") + 1).alias("lo"), F.coalesce("next_i", F.lit(n).cast("long")).alias("hi"), "Value", "next_i", "next_Value")
    before = F.struct(F.lit(1).cast("long").alias("lo"), F.col("_first").alias("hi"), F.lit(None).cast("double").alias("Value"),
                      F.lit(None).cast("long").alias("next_i"), F.lit(None).cast("double").alias("next_Value"))
    far = tail.select("TagName", F.inline(F.when(F.col("_first") > 0, F.array(before, own)).otherwise(F.array(own))))
    far = explode_span(far, F.col("lo"), F.col("hi"), "b", deal=["TagName"]).select(*near.columns)
    new = F.when(F.col("b") == F.col("next_i"), F.col("next_Value")).otherwise(F.col("Value"))
    g = near.unionByName(far).select("TagName", F.col("b").alias("i"), (new - F.col("Value")).alias("_v"))
    if tags is not None:
        names = asked_names(history.sparkSession, tags)
        silent = names.join(runs.select("TagName").distinct(), "TagName", "left_anti").withColumn("_v", F.lit(None).cast("double"))
        g = g.unionByName(explode_span(silent, F.lit(1), F.lit(n), "i", deal=["TagName"]).select("TagName", "i", "_v"))
    return _label(g, start, T, n, F.col("_v"))


def buckets_avgm(history: DataFrame, start, end, n: int, tags=None,
                 tree: SummaryTree | None = None) -> DataFrame:
    """AGG11: per bucket, mean of the seeded 1-second series strictly inside ``(e(i-1), e(i))``.

    Runs stay unexploded: each run is split only over the buckets it overlaps
    and weighted by the number of its seconds inside the open bucket.
    """
    _check_n(n)
    T = seconds_between(start, end)
    s0 = epoch_us_value(start) // US
    runs = fill_runs(history, start, end, 1, seeded=True, tags=tags, tree=tree)
    r = runs.select("TagName", "Value", (F.col("slot") - F.lit(s0)).alias("ys"),
                    (F.col("next_slot") - F.lit(s0) - 1).alias("ye"))
    if T == 0:
        ex = r.withColumn("i", F.lit(1).cast("long")).withColumn("w", F.lit(0).cast("long"))
    else:
        lo = F.greatest(F.lit(1).cast("long"), F.floor(F.col("ys") * F.lit(n) / F.lit(T)).cast("long") - 1)
        hi = F.least(F.lit(n).cast("long"), F.floor(F.col("ye") * F.lit(n) / F.lit(T)).cast("long") + 2)
        ex = r.filter(lo <= hi).withColumn("i", F.explode(F.sequence(lo, hi)))
        a = F.floor((F.col("i") - 1) * F.lit(T) / F.lit(n)).cast("long")
        b = F.floor(F.col("i") * F.lit(T) / F.lit(n)).cast("long")
        ex = ex.withColumn("w", F.least(F.col("ye"), b - 1) - F.greatest(F.col("ys"), a + 1) + 1)
    # runs outside the open buckets weigh nothing but still name their tag
    inside = F.col("w") > 0
    ex = ex.select("TagName", "i", F.when(inside, F.col("Value")).alias("Value"), F.when(inside, F.col("w")).alias("w"))
    agg = ex.groupBy("TagName", "i").agg(weighted_agg("avg").alias("_v"))
    return _label(_complete(agg, n, tags), start, T, n, F.col("_v"))


def buckets(history: DataFrame, start, end, n: int, group: str, mode: str = "filled", tags=None,
            tree: SummaryTree | None = None) -> DataFrame:
    """Dispatch for ``count`` + ``group`` requests (GetTagCountGroup).

    ``dif`` is the difference of last known values at the edges, in raw mode of
    interpolated ones; ``avgm`` is the mean of the mode's series (the seeded one,
    strictly inside the bucket, for filled and seeded)."""
    g = check_group(group)
    if mode not in (*MODES, "closed_raw"):
        raise ValueError(f"mode must be one of {(*MODES, 'closed_raw')}")
    raw = mode in ("raw", "closed_raw")
    if g == "dif":
        return buckets_dif_interpolated(history, start, end, n, tags) if raw else buckets_dif(history, start, end, n, tags, tree=tree)
    if g == "avgm" and mode in ("filled", "seeded"):
        return buckets_avgm(history, start, end, n, tags, tree=tree)
    g = "avg" if g == "avgm" else g
    if raw:
        return buckets_raw(history, start, end, n, g, tags, "[)" if mode == "raw" else "[]")
    if mode == "cyclic":
        return buckets_cyclic(history, start, end, n, g, tags, tree=tree)
    return buckets_filled(history, start, end, n, g, tags, seeded=mode == "seeded", tree=tree)
