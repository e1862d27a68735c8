"""Scaling check: operators on the sf0.1 events replicated k times in memory
(each copy shifts user_id, so tags and rows both grow).  Not a registered
query; a local look at how time grows with rows.

    python tools/scale_check.py [k ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tagscope.operators import aggregate as agg  # noqa: E402
from tagscope.operators import buckets as bk  # noqa: E402
from tagscope.operators import events as ev  # noqa: E402
from tagscope.operators import pointintime as pit  # noqa: E402
from tagscope.session import build_session  # noqa: E402

FROM, TO = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def replicated(spark, k):
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    e = e.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    uid = F.col("user_id") + F.col("_copy") * 100000
    return e.select(F.concat(F.lit("T"), (uid % (20 * k)).cast("string")).alias("TagName"),
                    F.col("ts").alias("DateTime"), F.col("value").alias("Value"))


def timed(build):
    """Build (eager checkpoints included) and run one query; seconds."""
    t0 = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    ks = [int(x) for x in sys.argv[1:]] or [1, 10, 30]
    spark = build_session("local[8]", shuffle_partitions=32)
    print("| copies | rows | tags | value at date | filled avg | 300 instants | 300 buckets avg | down events |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for k in ks:
        h = replicated(spark, k)
        s = h.withColumn("Value", F.when(F.col("Value") < 50, 0.0).otherwise(1.0))
        qs = [lambda: pit.value_at(h, "2024-01-20 00:00:00"),
              lambda: agg.aggregate(h, FROM, TO, "avg", mode="filled"),
              lambda: pit.values_at_instants(h, FROM, TO, 300),
              lambda: bk.buckets(h, FROM, TO, 300, "avg", mode="raw"),
              lambda: ev.down_events(s, FROM, TO)]
        ts = []
        for fn in qs:
            timed(fn)
            ts.append(min(timed(fn) for _ in range(2)))
        print(f"| {k} | {100000 * k:,} | {20 * k} | " + " | ".join(f"{t:.2f}" for t in ts) + " |", flush=True)


if __name__ == "__main__":
    main()
