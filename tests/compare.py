"""Runs registered queries against their SQL in DuckDB: python tests/compare.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(v):
    if isinstance(v, float) and not math.isfinite(v):
        return str(v)
    return v


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    want = db.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(want.columns, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if repr(x) != repr(y)]
    return f"{len(wrong)} of {len(a)} rows, such as {wrong[0]}" if wrong else None


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "5g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    db, queries, oracles, bad = connect(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in args or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            found = compare(queries[name](spark, sf_dir), db, oracles[name]) if name in oracles else f"(no SQL) {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(found) and not found.startswith("(no SQL)")
        print(f"{name}: {found or 'same'} [{time.time() - began:.1f} s]", flush=True)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(main(sys.argv[1:]))
