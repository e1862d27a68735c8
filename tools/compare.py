"""Local correctness loop: run registered queries in Spark and their oracle SQL
in DuckDB over the same parquet tables and compare row sets.

    python tools/compare.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tagscope.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if os.environ.get("COMPARE_EXACT") else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return repr(v)


DUCK_TO_SPARK = {"DOUBLE": "double", "BIGINT": "bigint", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz",
                 "INTEGER": "int", "BOOLEAN": "boolean", "DATE": "date"}


def type_diffs(df, rel):
    """Columns whose Spark type differs from the DuckDB oracle's type."""
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dt = {c: DUCK_TO_SPARK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    return [(c, st.get(c), dt.get(c)) for c in sorted(set(st) | set(dt)) if st.get(c) != dt.get(c)]


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(cols)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from tagscope.plans.catalog import ORACLE, QUERIES
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"create view {t} as select * from read_parquet('{p}')")
    bad = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        t0 = time.time()
        df = fn(spark, sf)
        srows = [tuple(r) for r in df.collect()]
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"{name:28s} spark={len(srows):8d} rows  (no oracle) {ts:.1f}s")
            continue
        res = con.sql(ORACLE[name])
        orows = res.fetchall()
        s, scols = rows_of(df.columns, srows)
        o, ocols = rows_of(res.columns, orows)
        tdiff = type_diffs(df, res)
        ok = s == o and scols == ocols and not tdiff
        bad += not ok
        print(f"{name:28s} spark={len(s):8d} oracle={len(o):8d} {'OK' if ok else 'MISMATCH'} {ts:.1f}s")
        if not ok:
            if scols != ocols:
                print("   cols", scols, ocols)
            if tdiff:
                print("   types (col, spark, duckdb)", tdiff)
            ss, oo = set(s), set(o)
            print("   spark-only", sorted(ss - oo)[:3])
            print("   oracle-only", sorted(oo - ss)[:3])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
