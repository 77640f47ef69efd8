"""Runs registered queries next to their SQL and compares the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple("\0" if row[n] is None else str(row[n]) for n in order) for row in rows)


def difference(spark, connection, sf_dir: str, build, statement: str) -> str | None:
    """None when both sides give the same rows, else what differs."""
    frame = build(spark, sf_dir)
    ours = [tuple(row) for row in frame.collect()]
    result = connection.execute(statement)
    names = [column[0] for column in result.description]
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    left, right = canonical(frame.columns, ours), canonical(names, result.fetchall())
    if not left:
        return "no rows to compare"
    if left == right:
        return None
    lost, extra = set(right) - set(left), set(left) - set(right)
    return f"{len(left)} rows against {len(right)}; ours only {sorted(extra)[:3]}; SQL only {sorted(lost)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry_points
    from listprep.session import local_session

    folder = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    link, statements, failed = connect(folder), entry_points.oracle_sql(), 0
    for name, build in entry_points.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = difference(spark, link, folder, build, statements[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'same'}", flush=True)
    print("failed:", failed)
