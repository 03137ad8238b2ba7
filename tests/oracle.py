"""Runs a registered query in Spark and its SQL in DuckDB over the same tables and compares the rows.

    python -m tests.oracle [--dir /root/testdata/sf0.01] [NAME ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings firehose reactions posts exposures "
    "notes ratings clients reading_labels mix_targets"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(root, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def normal(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None if x is None else "nan"
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(normal(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, normal(v)) for k, v in x.items()))
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, root: str, name: str, query, sql: str | None) -> str:
    """An empty text if they agree, else what differs."""
    began = time.time()
    df = query(spark, root)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    took = time.time() - began
    if sql is None:
        print(f"{name}: {len(got)} rows, {took:.1f} s, no SQL", flush=True)
        return ""
    cursor = connect(root).execute(sql)
    columns, want = [c[0] for c in cursor.description], cursor.fetchall()
    print(f"{name}: {len(got)} rows, {took:.1f} s", flush=True)
    if sorted(columns) != sorted(got_columns):
        return f"{name}: columns {sorted(got_columns)} against {sorted(columns)}"
    a, b = rows_of(got_columns, got), rows_of(columns, want)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{name}: {len(a)} rows against {len(b)}; {sorted(columns)} only Spark {only_a}; only SQL {only_b}"
    return ""


def main(args: list[str]) -> None:
    import __spark_entry__ as entry
    from brindle.session import get_session

    root = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        root, args = args[1], args[2:]
    spark = get_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, bad = entry.queries(), entry.oracle_sql(), []
    for name in args or queries:
        if name.endswith("*"):
            names = [q for q in queries if q.startswith(name[:-1])]
        else:
            names = [name]
        for n in names:
            try:
                problem = compare(spark, root, n, queries[n], sql.get(n))
            except Exception as e:  # report and go on
                problem = f"{n}: {type(e).__name__} {str(e)[:1500]}"
            if problem:
                print("FAIL", problem, flush=True)
                bad.append(n)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
