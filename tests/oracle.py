"""Run a registered query next to its SQL in DuckDB and compare the values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "quantize"):
        return round(float(value), 6)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def compare(spark, sf_dir: str, query, sql: str | None, db=None) -> tuple[str, float, int]:
    start = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - start
    if sql is None:
        return "rows-only", seconds, len(rows)
    db = db or connect(sf_dir)
    result = db.execute(sql)
    names, want = normal([c[0] for c in result.description], result.fetchall())
    got_names, got = normal(df.columns, [tuple(r) for r in rows])
    if names != got_names:
        return f"columns {got_names} != {names}", seconds, len(rows)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", seconds, len(rows)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", seconds, len(rows)
    return "ok", seconds, len(rows)


def main(argv):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from loreloom.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    db = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = argv or sorted(queries)
    failures = 0
    for name in wanted:
        try:
            verdict, seconds, count = compare(spark, sf_dir, queries[name], oracles.get(name), db)
        except Exception as error:  # report and go on with the next query
            verdict, seconds, count = "ERROR " + str(error)[:1500], 0.0, 0
        failures += verdict not in ("ok", "rows-only")
        print(f"\n{name:28s} {seconds:6.2f}s {count:8d} {verdict}", flush=True)
    print("failures", failures)


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
