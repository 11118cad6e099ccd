"""Run catalog queries next to their SQL statements and compare all rows.

    python tests/compare.py <folder of tables> [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    """One value in a form both engines share."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows) if rows and None not in (v for r in rows for v in r) else sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark, con, name, query, sql, sf_dir):
    """None if equal, else a short text; also the seconds of both engines."""
    t = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - t
    if sql is None:
        return None if got else "no rows", spark_s, 0.0, len(got)
    t = time.time()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    duck_s = time.time() - t
    problem = None
    if sorted(df.columns) != sorted(names):
        problem = f"columns {sorted(df.columns)} against {sorted(names)}"
    elif len(got) != len(want):
        problem = f"{len(got)} rows against {len(want)}"
    else:
        a, b = sorted_rows(df.columns, got), sorted_rows(names, want)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            problem = f"{len(bad)} of {len(a)} rows differ, first {sorted(names)}: {bad[0][0]} against {bad[0][1]}"[:900]
    return problem, spark_s, duck_s, len(got)


def main(sf_dir, *only):
    from __spark_entry__ import oracle_sql, queries
    from assay.session import local_session

    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = duck(sf_dir), oracle_sql()
    failed = 0
    for name, query in queries().items():
        if only and name not in only:
            continue
        try:
            problem, s, d, n = difference(spark, con, name, query, oracle.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem, s, d, n = f"{type(error).__name__}: {str(error)[:700]}", 0, 0, 0
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32s} {n:8d} rows  spark {s:6.2f}s  sql {d:6.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
