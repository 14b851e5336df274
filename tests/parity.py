"""Run the queries against their SQL counterparts: ``python tests/parity.py [sf_dir] [names..]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(columns), sorted(picked, key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between the two results; empty if nothing does."""
    got_columns, got = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    want_columns, want = _sorted_rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} instead of {want_columns}"]
    notes = [] if len(got) == len(want) else [f"{len(got)} rows instead of {len(want)}"]

    def same(a, b):
        if isinstance(a, float) and isinstance(b, float):
            return a == b or (math.isnan(a) and math.isnan(b))
        return a == b and type(a) is type(b)

    wrong = [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))]
    if wrong:
        notes.append(f"{len(wrong)} rows differ, first {str(wrong[0][0])[:300]} instead of {str(wrong[0][1])[:300]}")
    return notes


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        begun = time.monotonic()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                notes = differences(df, con, sqls[name])
                print(name, "ok" if not notes else notes, f"{time.monotonic() - begun:.1f}s", flush=True)
            else:
                notes = []
                print(name, "rows", df.count(), f"{time.monotonic() - begun:.1f}s", flush=True)
        except Exception as error:  # keep going through the list
            notes = [f"{type(error).__name__}: {str(error)[:600]}"]
            print(name, notes, flush=True)
        failed += bool(notes)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
