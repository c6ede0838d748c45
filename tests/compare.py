"""Runs registered queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return ""
        if isinstance(x, bool):
            return str(int(x))
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else f"{x:.6g}"
        if hasattr(x, "tolist"):
            return str(x.tolist())
        return str(x)

    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False, name=None))


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str:
    """'' if both have the same columns and rows."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} {sorted(right.columns)}"
    a, b = canonical(left), canonical(right)
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main(sf_dir: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, found = connect(sf_dir), entry.oracle_sql(), entry.queries()
    for name in names or found:
        try:
            t = time.time()
            got = found[name](spark, sf_dir).toPandas()
            took = time.time() - t
            if name not in sql:
                print(f"{name}: {len(got)} rows without SQL, {took:.1f} s", flush=True)
                continue
            t = time.time()
            wrong = compare(got, con.execute(sql[name]).fetchdf())
            print(f"{name}: {wrong[:400] or 'ok'} ({len(got)} rows), {took:.1f} s, SQL {time.time() - t:.1f} s", flush=True)
        except Exception as e:
            print(f"{name}: FAILED {str(e)[:500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
