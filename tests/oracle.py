"""Run queries beside their SQL and compare every value.

``python -m tests.oracle [--sf 0.01] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def duck(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, canon(v)) for k, v in value.items())
    if isinstance(value, (dt.datetime, dt.date, decimal.Decimal)):
        return str(value)
    return value


def compare(spark, con, name: str, run, sql: str | None, path: str) -> tuple[bool, str]:
    begin = time.time()
    df = run(spark, path)
    rows = df.collect()
    spent = time.time() - begin
    columns = sorted(df.columns)
    if sql is None:
        return True, f"rows={len(rows)} {spent:.1f}s (no sql)"
    begin = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    sql_spent = time.time() - begin
    info = f"rows={len(rows)}/{len(expected)} {spent:.1f}s sql={sql_spent:.1f}s"
    if sorted(names) != columns:
        return False, f"{info} columns {columns} != {sorted(names)}"
    bad_types = [(c, df.schema[c].dataType.simpleString(), types[c]) for c in columns
                 if KINDS.get(df.schema[c].dataType.simpleString()) != types[c]]
    left = Counter(tuple(canon(r[c]) for c in columns) for r in rows)
    at = [names.index(c) for c in columns]
    right = Counter(tuple(canon(r[i]) for i in at) for r in expected)
    if left != right:
        only_left, only_right = list((left - right).items())[:3], list((right - left).items())[:3]
        return False, f"{info} differs={sum((left - right).values())} {columns}\n   spark={only_left}\n   sql  ={only_right}"
    if bad_types:
        return False, f"{info} types {bad_types}"
    if not rows:
        return False, f"{info} EMPTY"
    return True, info


def main() -> int:
    sys.path.insert(0, ".")
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from zocalo.queries import QUERIES
    from zocalo.session import build_session
    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    path = f"/root/testdata/sf{args.sf}"
    con = duck(path)
    failed = 0
    for name, q in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            ok, info = compare(spark, con, name, q.run, q.sql, path)
        except Exception as error:  # report and go on with the next query
            ok, info = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, info, flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
