"""Mixing sources to target weights by capped water-filling (native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagscope.llm.common import Renamed, id_key, word_count

WEIGHTS = (5, 2, 1)      # given to the sources in order, repeating
MAX_EPOCHS = 3           # no source is read more often than this
SEED = "mix-1"
CHUNK_ROWS = 4096        # rows of all sources in one hash chunk, about


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
                   source: str = "source") -> DataFrame:
    """Targets by capped water-filling, from one row (source, source_size).

    Every source would get the share of the whole size that its weight gives;
    a source above ``max_epochs`` times its own size is clamped there and what
    it leaves is shared again by weight, until none is above.  With sources in
    the order of cap / weight the clamped ones are a prefix, so the fixed point
    follows from running sums: the level at position i is (whole size - caps
    before i) / (weights from i on) and the first source whose cap exceeds
    level * weight is the first unclamped one.  The only single-partition
    windows run over this table, which has one row per source.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    ranked = totals.withColumn("_w", F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(int(max_epochs)))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double")
             / F.sum("_w").over(after))
    stepped = ranked.withColumn("_level", level).withColumn("_at", F.row_number().over(fill))
    first = F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_w"),
                         F.struct("_at", "_level"))).over(whole)
    out = stepped.withColumn("_first", first)
    target = F.when(F.col("_first").isNull() | (F.col("_at") < F.col("_first._at")), F.col("_cap").cast("double")) \
        .otherwise(F.col("_first._level") * F.col("_w"))
    return out.select(source, "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows of ``docs`` with size, source_size, target and taken.

    Each source is read in whole passes and one fractional pass: with target =
    r * source_size every document is taken floor(r) times, and the rest is
    taken from the source's documents in an order seeded by the id, until the
    target (rounded to a word) is met; the document at the edge is taken in
    part.  So taken sums to the rounded target of the source, no document
    exceeds max_epochs times its size, and reruns agree.  Running sums are two
    level: within (source, hash chunk), and over chunk totals, so a hot source
    is split over chunks.

    Null text counts as empty (size and taken 0); a null source is a source of
    its own, last in order; ids may be null or repeat: each row is taken on its
    own, ties of the seeded order fall to id and size (equal rows are
    interchangeable).  An empty table gives no rows.  Helper columns
    (size, source_size, target, taken, and names starting with "_mix") replace
    columns of the same name.
    """
    n = docs.count()  # decides the number of chunks only
    chunks = max(1, -(-n // CHUNK_ROWS))
    order = F.md5(F.concat(F.lit(f"{seed}:"), id_key(F.col(doc_id))).cast("binary"))
    sized = docs.withColumn("size", word_count(F.col(text))).withColumn("_mix_order", order)
    place = F.conv(F.substring("_mix_order", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("_mix_chunk", F.floor(place * chunks / F.lit(1 << 32)).cast("long"))

    by_chunk = sized.groupBy(F.col(source).alias("_mix_s"), F.col("_mix_chunk").alias("_mix_c")) \
        .agg(F.sum("size").alias("_mix_size"))
    totals = by_chunk.groupBy("_mix_s").agg(F.sum("_mix_size").alias("source_size"))
    targets = source_targets(totals, weights, max_epochs, "_mix_s").withColumnRenamed("_mix_s", "_mix_t")
    whole = F.when(F.col("source_size") > 0, F.least(
        F.floor(F.col("target") / F.col("source_size")), F.lit(int(max_epochs)).cast("long"))).otherwise(F.lit(0))
    targets = targets.withColumn("_mix_whole", whole.cast("long")) \
        .withColumn("_mix_extra", F.round("target").cast("long") - F.col("_mix_whole") * F.col("source_size"))
    earlier = Window.partitionBy("_mix_s").orderBy("_mix_c").rowsBetween(Window.unboundedPreceding, -1)
    plan = by_chunk.withColumn("_mix_offset", F.coalesce(F.sum("_mix_size").over(earlier), F.lit(0))) \
        .join(targets, F.col("_mix_s").eqNullSafe(F.col("_mix_t"))) \
        .select("_mix_s", "_mix_c", "_mix_offset", "_mix_whole", "_mix_extra", "source_size", "target")

    rows = sized.drop("source_size", "target", "taken") \
        .join(plan, F.col(source).eqNullSafe(F.col("_mix_s")) & (F.col("_mix_chunk") == F.col("_mix_c")))
    within = Window.partitionBy(source, "_mix_chunk").orderBy("_mix_order", doc_id, "size") \
        .rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_mix_offset") + F.sum("size").over(within) - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_mix_extra") - start))
    return rows.withColumn("taken", (F.col("_mix_whole") * F.col("size") + part).cast("long")) \
        .drop(*[c for c in rows.columns if c.startswith("_mix")])


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
                    doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken; the
    one partly taken document of a source appears when half of it or more is
    (documents stay whole).  Columns are those of ``docs``."""
    names = Renamed(docs)
    m = mix(names.df, weights, max_epochs, seed, *[names.name(c) for c in (doc_id, text, source)])
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rows = m.withColumn("_times", times).where("_times > 0")
    return names.back(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))))
