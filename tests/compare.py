"""Runs registered queries against their DuckDB texts; also a script: python tests/compare.py [NAME...]."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def cell(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if v is not None and type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1 << 50 else str(v)
    return str(v)


def rows(names: list[str], data) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in data)


def compare(spark, con, name: str, query, text: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = con.sql(text)
    want_names = list(rel.columns)
    want = rows(want_names, rel.fetchall())
    if sorted(df.columns) != sorted(want_names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(want_names)}"
    if got != want:
        odd = next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)
        return f"{name}: {len(got)} and {len(want)} rows, first difference {odd}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf = "/root/testdata/sf0.01"
    con, q, bad = oracle(sf), e.queries(), 0
    for name, text in e.oracle_sql().items():
        if sys.argv[1:] and name not in sys.argv[1:]:
            continue
        try:
            said = compare(spark, con, name, q[name], text, sf)
        except Exception as x:  # noqa: BLE001
            said = f"{name}: {str(x)[:300]}"
        if said:
            bad += 1
            print(said)
    print("compared", len(e.oracle_sql()), "bad", bad)
