"""Run registered queries and their SQL twins on the same parquet files and compare.

    python -m tests.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
from datetime import datetime

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None else str(v) if not isinstance(v, bool) else v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(x is not None, str(x)) for x in r])


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return canonical(columns, cur.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    cols_a, a = spark_rows(df)
    cols_b, b = duck_rows(con, sql)
    if cols_a != cols_b:
        return f"columns {cols_a} != {cols_b}"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}; first {a[:2]} / {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ: {bad[0]}"
    return None if a else "both empty"


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siltmark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from siltmark.plans.catalog import ORACLES, QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = session(), duck(args.sf)
    names = args.names or list(QUERIES)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            if name in ORACLES:
                note = difference(df, con, ORACLES[name]) or "ok"
            else:
                rows = df.collect()
                note = f"rows only: {len(rows)} {[tuple(r) for r in rows[:2]]}"[:300]
        except Exception as e:  # report and go on with the next query
            note = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        failed += not note.startswith(("ok", "rows"))
        print(f"{name:40s} {time.time() - start:6.2f}s  {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
