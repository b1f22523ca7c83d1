"""Run registered queries next to their SQL and compare every value."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, plan, sql, directory):
    start = time.time()
    df = plan(spark, directory)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return spent, len(got), None
    start = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return spent, len(got), f"columns {sorted(df.columns)} vs {sorted(columns)}"
    left, right = rows_of(df.columns, got), rows_of(columns, expected)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        return spent, len(got), (
            f"{len(left)} vs {len(right)} rows; {sorted(columns)}\n  spark {only_left}\n  sql   {only_right}"
        )
    return spent, len(got), None


def main(argv):
    directory, wanted = argv[0], argv[1:]
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from crowdgauge.runtime import session

    spark = session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    bad = 0
    for name, plan in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            spent, n, problem = compare(
                spark, con, name, plan, entry.oracle_sql().get(name), directory
            )
        except Exception as error:  # report and go on with the next query
            spent, n, problem = 0.0, 0, f"{type(error).__name__}: {str(error)[:700]}"
        status = "ok  " if problem is None else "FAIL"
        if problem is None and name not in entry.oracle_sql():
            status = "rows"
        if problem or n == 0:
            bad += 1
        print(f"{status} {name:45s} {n:7d} rows {spent:6.2f}s{' EMPTY' if n == 0 else ''}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
