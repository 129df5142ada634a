"""Holds queries against their SQL in DuckDB: python -m tests.oracle [SF_DIR] [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return int(x) if isinstance(x, int) and not isinstance(x, bool) else x


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def differences(df, con, sql: str) -> list[str]:
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if sorted(df.columns) != names:
        return [f"columns {sorted(df.columns)} and {names}"]
    want = sorted((tuple(plain(dict(zip(rel.columns, r, strict=True))[n]) for n in names) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    if got == want:
        return []
    return [f"{len(got)} and {len(want)} rows", *(f"got {a}\n     not {b}" for a, b in zip(got, want, strict=False) if a != b)][:3]


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connection(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if n in sql]:
        began = time.time()
        try:
            found = differences(queries[name](spark, sf_dir), con, sql[name]) if name in sql else [f"no SQL; {queries[name](spark, sf_dir).count()} rows"]
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found) and name in sql
        print("ok " if not found else "BAD", name, f"{time.time() - began:.1f} s", *found, sep="  ", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
