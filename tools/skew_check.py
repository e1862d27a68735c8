"""Skew check: the sequential operators on a history where ONE tag holds every
row, next to the same rows spread over 20 tags.

    python tools/skew_check.py [sf_dir]

Reports wall time (noop sink) and the largest (tag, chunk) group, the unit of
work of one window task, for fixed 1-hour chunks and for adaptive chunks.
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tagscope.operators import aggregate as agg  # noqa: E402
from tagscope.operators import chunked  # noqa: E402
from tagscope.operators import events as ev  # noqa: E402
from tagscope.operators import resample as rs  # noqa: E402
from tagscope.session import build_session  # noqa: E402
from tagscope.sources import testdata as td  # noqa: E402

FROM, TO = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def timed(build):
    """Build (eager checkpoints included) and run one query; seconds."""
    t0 = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    spread = td.history(spark, sf)
    hot = spread.withColumn("TagName", F.lit("HOT"))
    print(f"rows: {spread.count()}")
    for target in (None, 2000):
        if target:
            spark.conf.set(chunked.CONF_TARGET_ROWS, str(target))
        label = f"adaptive {target} rows" if target else "fixed 1 h chunks"
        for name, h in (("20 tags", spread), ("1 hot tag", hot)):
            d = chunked.with_chunk(h, ["TagName"], "DateTime")
            biggest = d.groupBy("TagName", chunked.CK).count().agg(F.max("count")).first()[0]
            t_ev = min(timed(lambda: ev.down_events(h, FROM, TO)) for _ in range(2))
            t_run = min(timed(lambda: chunked.running_sum(h, ["TagName"], ["DateTime"], "Value", "t")) for _ in range(2))
            t_fill = min(timed(lambda: agg.aggregate(h, FROM, TO, "avg", mode="filled")) for _ in range(2))
            t_rs = min(timed(lambda: rs.resample(h, FROM, TO, 60)) for _ in range(2))
            print(f"| {label} | {name} | {biggest} | {t_ev:.2f} | {t_run:.2f} | {t_fill:.2f} | {t_rs:.2f} |")
    spark.conf.unset(chunked.CONF_TARGET_ROWS)


if __name__ == "__main__":
    main()
