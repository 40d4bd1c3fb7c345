"""``python tests/oracle.py [SF_DIR] [NAME...]``: each query beside its DuckDB SQL, rows and values compared."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    out = []
    for r in frame[names].itertuples(index=False):
        out.append(tuple("" if x is None or x != x else f"{float(x):.6g}" if isinstance(x, float) else str(x) for x in r))
    return sorted(out)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/**/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def same(spark, con, query, sql: str, sf_dir: str) -> str:
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; first difference {next(((x, y) for x, y in zip(a, b, strict=False) if x != y), '-')}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            said = same(spark, con, query, sql[name], sf_dir) if name in sql else f"no SQL; {query(spark, sf_dir).count()} rows"
        except Exception as e:
            said = f"FAILED {type(e).__name__} {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
