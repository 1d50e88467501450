"""Run a registered query and its SQL statement on the same tables and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool):
        return int(value)
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, run, sql, folder):
    """(ok, message, spark seconds, rows)"""
    start = time.time()
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, "rows only", took, len(got[1])
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} <> {want[0]}", took, len(got[1])
    if got[1] != want[1]:
        have, need = set(got[1]), set(want[1])
        missing = [r for r in want[1] if r not in have][:3]
        extra = [r for r in got[1] if r not in need][:3]
        return False, f"rows {len(got[1])} vs {len(want[1])}; only sql {missing}; only spark {extra}", took, len(got[1])
    return True, "", took, len(got[1])


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from touchline.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            ok, message, took, n = compare(spark, con, run, oracle.get(name), folder)
        except Exception as exc:  # noqa: BLE001
            ok, message, took, n = False, f"{type(exc).__name__}: {str(exc)[:900]}", 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s rows={n} {message}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
