"""Run registered queries next to their SQL on the same parquet files and compare the rows.

python -m tests.oracle [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r))
    )


def same(a, b):
    """Equal values; whole numbers may differ in type only."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for wrong in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if wrong in plan:
            return False, f"the plan has a {wrong}"
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cols, got = sorted_rows(df.columns, rows)
    if sql is None:
        return len(rows) > 0, f"rows-only n={len(rows)} spark={t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want_cols, want = sorted_rows(names, cur.fetchall())
    t2 = time.time()
    note = f"n={len(rows)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s"
    if cols != want_cols:
        return False, f"{note} columns {cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"{note} rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    if bad:
        return False, f"{note} {len(bad)} rows differ, e.g. {bad[:2]}"
    return True, note


def main(names):
    from __spark_entry__ import oracle_sql, queries

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, todo, sqls = connect(sf_dir), queries(), oracle_sql()
    failed = []
    for name in names or todo:
        try:
            ok, note = compare(spark, con, sf_dir, name, todo[name], sqls.get(name))
        except Exception as e:  # report every query, then fail at the end
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print(("ok   " if ok else "FAIL ") + name, note[:1500], flush=True)
        failed += [] if ok else [name]
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
