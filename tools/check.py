"""Compare registered queries with their check SQL: ``python tools/check.py SF_DIR [name or prefix ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(value):
    """A value with its kind, so that 1 and 1.0 or a date and a text differ."""
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("null",) if math.isnan(value) else ("float", repr(value))
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return ("time", value.replace(tzinfo=None).isoformat())
    if isinstance(value, datetime.date):
        return ("date", value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    return ("text", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def oracle_rows(connection, sql):
    relation = connection.sql(sql)
    return rows_of(list(relation.columns), relation.fetchall())


def connect(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def compare(spark, connection, sf_dir, name, query, sql):
    """An empty text when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "", sum(got.values())
    want_columns, want = oracle_rows(connection, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} vs {want_columns}", sum(got.values())
    if got != want:
        extra, missing = got - want, want - got
        return (f"rows {sum(got.values())} vs {sum(want.values())}\n   spark only: {list(extra.items())[:2]}"
                f"\n   sql only:   {list(missing.items())[:2]}"), sum(got.values())
    return "", sum(got.values())


def main():
    import os

    from trailhound.plans.catalog import ORACLES, QUERIES
    from trailhound.session import build_session

    sf_dir, *names = sys.argv[1:]
    cpus = os.environ.get("CHECK_CPUS", "8")
    spark = build_session("check", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = []
    for name, query in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, connection, sf_dir, name, query, ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", 0
        print(f"{'BAD ' if problem else 'ok  '} {name} {n} rows {time.time() - start:.1f}s {problem}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
