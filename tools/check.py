"""Run named queries and compare them with their check SQL in DuckDB.

    python tools/check.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return repr(float(v) + 0.0)
        return str(v)

    return sorted("|".join(show(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str:
    """'' when equal, else a short description of the difference."""
    got_rows = [tuple(r) for r in spark_df.collect()]
    want = con.execute(sql)
    want_cols = [d[0] for d in want.description]
    want_rows = want.fetchall()
    if sorted(spark_df.columns) != sorted(want_cols):
        return f"columns {sorted(set(spark_df.columns) ^ set(want_cols))}"
    got, expected = canonical(spark_df.columns, got_rows), canonical(want_cols, want_rows)
    if got == expected:
        return "" if got else "both empty"
    extra, missing = sorted(set(got) - set(expected)), sorted(set(expected) - set(got))
    return (f"{len(got)} rows vs {len(expected)}, {len(extra)} extra, {len(missing)} missing; columns "
            f"{sorted(spark_df.columns)}\n   spark {extra[:2]}\n   check {missing[:2]}")


def main() -> int:
    from parcelrules.plans import suite
    from parcelrules.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in args or suite.QUERIES:
        start = time.time()
        try:
            df = suite.QUERIES[name](spark, folder)
            if name in suite.CHECK_SQL:
                outcome = compare(df, con, suite.CHECK_SQL[name])
            else:
                outcome = "" if df.count() else "empty"
        except Exception as exc:  # report and go on with the next query
            outcome = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += bool(outcome)
        kind = "" if name in suite.CHECK_SQL else " (rows only)"
        print(f"{'FAIL' if outcome else 'ok  '} {name}{kind} {time.time() - start:.2f}s {outcome}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
