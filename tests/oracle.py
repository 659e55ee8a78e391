"""Side-by-side comparison of a registered query and its oracle SQL."""

from __future__ import annotations

import datetime
import math
import sys

import duckdb

from goldweave.plans.catalog import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


_SPARK_KIND = {"bigint": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean",
               "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    got_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]).lower() for d in cur.description}
    expected_rows = cur.fetchall()
    out = []
    if sorted(columns) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} against {sorted(columns)}")
        return out
    for name, kind in df.dtypes:
        if _SPARK_KIND.get(kind.split("(")[0]) != kinds[name]:
            out.append(f"type of {name}: {kind} against {kinds[name]}")
    got, expected = rows_of(df.columns, got_rows), rows_of(columns, expected_rows)
    if len(got) != len(expected):
        out.append(f"{len(got)} rows against {len(expected)}")
    if not got:
        out.append("no rows")
    for g, e in zip(got, expected):
        if repr(g) != repr(e):
            out.append(f"got {g} expected {e}"[:600])
            if len(out) > 3:
                break
    return out


def check_all(spark, folder: str, names=None) -> dict[str, list[str]]:
    import time
    from goldweave.plans.all_queries import CATALOG
    from goldweave.plans.catalog import Tables
    con, failed = connect(folder), {}
    for name, entry in CATALOG.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = entry.build(Tables(spark, folder))
            if entry.sql:
                diff = differences(df, con, entry.sql)
                n = -1
            else:
                n, diff = df.count(), []
        except Exception as error:  # report and go on
            diff, n = [f"{type(error).__name__}: {str(error)[:700]}"], -1
        took = time.time() - start
        note = "ok" if not diff else "DIFF"
        empty = "" if n != 0 else " EMPTY"
        print(f"{note:5}{empty} {name} {took:.2f}s {'(rows only)' if not entry.sql else ''}", flush=True)
        for d in diff:
            print("      ", d, flush=True)
        if diff:
            failed[name] = diff
    return failed


if __name__ == "__main__":
    from goldweave.session import build_session
    folder = sys.argv[1]
    session = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    bad = check_all(session, folder, set(sys.argv[2:]))
    print(f"failed: {sorted(bad)}")
