"""Run every registered query once and report any whole-stage code-generation
failure (Spark then silently falls back to slower interpreted execution).

    python tools/codegen_check.py [sf_dir]
"""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

RUNNER = r"""
import sys
sys.path.insert(0, %r)
from tagscope.plans.catalog import QUERIES
from tagscope.session import build_session
spark = build_session("local[8]", shuffle_partitions=16)
for name, fn in QUERIES.items():
    print("QUERY", name, flush=True)
    print("QUERY", name, file=sys.stderr, flush=True)
    fn(spark, %r).write.format("noop").mode("overwrite").save()
"""


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    p = subprocess.run([sys.executable, "-c", RUNNER % (ROOT, sf)], capture_output=True, text=True, timeout=3600)
    current, bad = None, {}
    for line in p.stderr.splitlines():
        if line.startswith("QUERY "):
            current = line.split()[1]
        elif "Failed to compile" in line or "grows beyond 64 KB" in line:
            bad.setdefault(current, set()).add(line.strip()[:120])
    print("queries with code-generation failures:", sorted(bad) or "none")
    for q, msgs in bad.items():
        for m in sorted(msgs):
            print(f"  {q}: {m}")
    return 1 if bad or p.returncode else 0


if __name__ == "__main__":
    sys.exit(main())
