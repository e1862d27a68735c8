"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full into Spark's ``noop`` sink (no collect), once
to warm up and then ``$BENCH_RUNS`` times; the median is reported.  Prints
one JSON line: {"metric", "value" (sum of medians), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagscope.session import build_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", app="tagscope-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    from tagscope.plans.catalog import QUERIES
    timings, failed = {}, {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        try:
            run(fn(spark, sf_dir))  # warm-up (also plans and JIT-compiles)
            ts = []
            for _ in range(runs):
                t0 = time.perf_counter()
                run(fn(spark, sf_dir))  # plan building is timed too (it may checkpoint)
                ts.append(time.perf_counter() - t0)
        except Exception as exc:  # report and go on: one failure must not hide the rest
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
            print(f"# {name}: FAILED {failed[name]}", file=sys.stderr, flush=True)
            continue
        timings[name] = round(statistics.median(ts), 3)
        print(f"# {name}: {timings[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "spark": spark.version,
        "cpus": int(cpus),
        "runs": runs,
        "failed": failed,
    }))


if __name__ == "__main__":
    main()
