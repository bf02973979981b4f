"""Run checked queries and their SQL side by side and report differences.

usage: python tools/verify.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("verify")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_float_dtype(s):
            df[c] = s.map(lambda v: "NULL" if pd.isna(v) else repr(float(v)))
        else:
            df[c] = s.map(lambda v: "NULL" if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)) else
                          repr(float(v)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    kinds = [(c, str(a[c].dtype), str(b[c].dtype)) for c in a.columns if str(a[c].dtype) != str(b[c].dtype)
             and not {str(a[c].dtype), str(b[c].dtype)} <= {"object", "str", "string"}]
    x, y = canonical(a), canonical(b)
    if not x.equals(y):
        left = x.merge(y.drop_duplicates(), how="left", indicator=True)
        extra = left[left["_merge"] == "left_only"].drop(columns="_merge")
        right = y.merge(x.drop_duplicates(), how="left", indicator=True)
        lost = right[right["_merge"] == "left_only"].drop(columns="_merge")
        return f"values differ: {len(extra)} rows\n  spark {extra.head(2).to_dict('records')}\n  sql   {lost.head(2).to_dict('records')}"
    return f"ok (types {kinds})" if kinds else "ok"


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    from checks import CHECKS
    names = [n for n in CHECKS if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark, con, bad = session(), oracle(sf_dir), 0
    for n in names:
        t = time.time()
        try:
            got = CHECKS[n].run(spark, sf_dir).toPandas()
            took = time.time() - t
            if CHECKS[n].sql is None:
                verdict = "rows-only" if len(got) else "EMPTY"
            else:
                verdict = compare(got, con.execute(CHECKS[n].sql).df())
        except Exception as e:  # noqa: BLE001 - report and go on
            took, verdict = time.time() - t, "ERROR " + str(e).split("JVM stacktrace")[0][:900]
        if not verdict.startswith(("ok", "rows-only")):
            bad += 1
        print(f"{n:45s} {took:6.2f}s rows={len(got) if 'got' in dir() else -1:7d} {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
