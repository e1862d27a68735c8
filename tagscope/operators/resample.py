"""Range retrieval and resampling (RNG1-4).

The filled series is kept as *runs*: one row per present slot with the slot
of the next present value.  Aggregates weight each run by its length, so the
per-second grid is never built; only ``resample()`` (an export of the grid
itself) explodes runs, and it does so per row, spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagscope.functions.timecols import US, epoch_us, epoch_us_value, from_epoch_us, ts_lit
from tagscope.operators import chunked
from tagscope.operators.chunked import explode_span, index_chunk
from tagscope.operators.filters import filter_range, filter_tags
from tagscope.operators.pointintime import last_sample
from tagscope.operators.tree import SummaryTree, asof_source


def range_raw(history: DataFrame, start, end, tags=None, bounds: str = "[)") -> DataFrame:
    """RNG1: raw samples in the range (half-open by default, as MySQL/MS SQL)."""
    h = filter_range(filter_tags(history, tags), start, end, bounds)
    return h.select("TagName", "DateTime", "Value")


def slot_of(step_seconds: int):
    return F.floor(epoch_us("DateTime") / F.lit(step_seconds * US)).cast("long")


def _per_slot(rows: DataFrame, keys, size: int, slot, *aggs) -> DataFrame:
    """Rows reduced to one per slot, still partitioned by (keys, chunk of ``size``
    slots): the one exchange of the rows also serves the lead that follows."""
    d = rows.withColumn("slot", slot).withColumn(chunked.CK, index_chunk("slot", size))
    return d.repartition(*keys, chunked.CK).groupBy(*keys, chunked.CK, "slot").agg(*aggs)


def fill_runs(history: DataFrame, start, end, step_seconds: int = 1, seeded: bool = True, tags=None,
              keys=("TagName",), rows: DataFrame | None = None, chunk_seconds: int | None = None,
              tree: SummaryTree | None = None) -> DataFrame:
    """Runs of the step-filled series: ``keys..., slot, next_slot, Value``.

    Each present slot holds the mean of its samples and lasts until the next
    present slot (the last one lasts one step).  ``rows`` may supply the
    samples directly (e.g. already split into buckets, with extra ``keys``).
    With ``seeded`` the last value at or before each bound counts as a sample at
    that bound.
    """
    near, tail = _runs(history, start, end, step_seconds, seeded, tags, keys, rows, chunk_seconds, tree)
    return near.unionByName(tail)


def _runs(history, start, end, step_seconds, seeded, tags, keys=("TagName",), rows=None, chunk_seconds=None, tree=None):
    """The runs inside chunks, and those that leave their chunk (few, maybe long)."""
    keys = list(keys)
    size = max(1, (chunk_seconds or chunked.chunk_seconds()) // step_seconds)
    if rows is None:
        rows = filter_range(filter_tags(history, tags), start, end, "[]").select("TagName", "DateTime", "Value")
        if seeded:
            return _seeded_runs(history, rows, start, end, step_seconds, size, tags, tree)
    d = _per_slot(rows, keys, size, slot_of(step_seconds), F.avg("Value").alias("Value"))
    near, tail = chunked.forward_runs(d, keys, "slot")
    return near, tail.drop("_first").withColumn("next_slot", F.coalesce("next_slot", F.col("slot") + 1))


def _seeded_runs(history, inside, start, end, step_seconds, size, tags, tree):
    """A tag's samples before ``start`` are first reduced to the last one.  It falls
    into the first slot, as a seed only; the seed at ``end`` is the last sample of the
    tag's last slot, known where the lead finds no successor."""
    a = ts_lit(start)
    older = asof_source(history, start, start, tree, tags).filter(F.col("DateTime") < a).groupBy("TagName").agg(*last_sample())
    rows = inside.unionByName(older.select("TagName", "DateTime", "Value"))
    step_us = step_seconds * US
    lo, hi = epoch_us_value(start) // step_us, epoch_us_value(end) // step_us
    t, v = F.col("DateTime"), F.col("Value")
    mine = F.when(t >= a, v)
    d = _per_slot(rows, ["TagName"], size, F.greatest(slot_of(step_seconds), F.lit(lo).cast("long")),
                  F.sum(mine).alias("_sum"), F.count(mine).alias("_n"), F.max_by(v, F.when(t <= a, t)).alias("_seed"),
                  F.max_by(v, t).alias("_last"))
    near, tail = chunked.forward_runs(d, ["TagName"], "slot")

    def mean(extra):
        """Mean of the slot's samples and of the seeds in it; NULL values do not count."""
        seeds = [F.col("_seed")] + ([F.col("_last")] if extra else [])
        total, n = F.coalesce("_sum", F.lit(0.0)), F.col("_n")
        for s in seeds:
            total, n = total + F.coalesce(s, F.lit(0.0)), n + F.when(s.isNotNull(), 1).otherwise(0)
        return F.try_divide(total, n)

    near = near.select("TagName", "slot", "next_slot", mean(False).alias("Value"))
    is_last, at_end = F.col("next_slot").isNull(), F.col("slot") == hi
    own = F.struct("slot", F.coalesce("next_slot", F.when(at_end, F.lit(hi + 1)).otherwise(F.lit(hi)).cast("long")).alias("next_slot"),
                   F.when(is_last & at_end, mean(True)).otherwise(mean(False)).alias("Value"))
    end_run = F.struct(F.lit(hi).cast("long").alias("slot"), F.lit(hi + 1).cast("long").alias("next_slot"), F.col("_last").alias("Value"))
    tail = tail.select("TagName", F.inline(F.when(is_last & ~at_end, F.array(own, end_run)).otherwise(F.array(own))))
    return near, tail


def resample(history: DataFrame, start, end, step_seconds: int = 1, seeded: bool = True, tags=None,
             tree: SummaryTree | None = None) -> DataFrame:
    """RNG2 (seeded) / RNG4 (unseeded): mean per step, every missing step filled
    with the previous value, from the first to the last present step.

    Runs inside a chunk are exploded where they lie.  Runs that leave their chunk
    (one per chunk at most) are cut into pieces that are dealt out first, so a tag
    that is silent for a year is not one task's work."""
    near, tail = _runs(history, start, end, step_seconds, seeded, tags, tree=tree)
    near = near.withColumn("s", F.explode_outer(F.sequence("slot", F.col("next_slot") - 1)))
    far = explode_span(tail, F.col("slot"), F.col("next_slot") - 1, "s", deal=["TagName"])
    s = near.select("TagName", "s", "Value").unionByName(far.select("TagName", "s", "Value"))
    return s.select("TagName", from_epoch_us(F.col("s") * F.lit(step_seconds * US)).alias("DateTime"), "Value")
