"""Compare registered queries with their SQL: python tests/oracle_check.py [name part] ..."""

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores=8):
    return (SparkSession.builder.master(f"local[{cores}]").appName("crosstide-check")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.log.level", "ERROR").getOrCreate())


def oracle(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if frame[c].dtype == object:
            frame[c] = [None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v))
                        else (str(v.tolist()) if isinstance(v, np.ndarray) else str(v)) for v in frame[c]]
        elif str(frame[c].dtype) in ("boolean", "bool"):
            frame[c] = [None if pd.isna(v) else str(bool(v)) for v in frame[c]]
        else:
            frame[c] = frame[c].astype("float64")
    return frame.sort_values(list(frame.columns), kind="stable", na_position="first").reset_index(drop=True)


def difference(left, right):
    """Empty text when equal, else what differs."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(set(left.columns) ^ set(right.columns))}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    a, b = plain(left), plain(right)
    problems = []
    for c in a:
        if a[c].dtype == object or b[c].dtype == object:
            bad = a[c].astype(object).where(a[c].notna(), None).ne(b[c].astype(object).where(b[c].notna(), None))
            bad &= ~(a[c].isna() & b[c].isna())
        else:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = int(np.flatnonzero(bad)[0])
            problems.append(f"{c}: {int(bad.sum())} rows, e.g. {a[c][i]!r} vs {b[c][i]!r}")
    return "; ".join(problems[:6])


def main(parts, folder):
    import __spark_entry__ as entry
    spark, con = session(), oracle(folder)
    failed, queries, sqls = [], entry.queries(), entry.oracle_sql()
    for name, build in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            t = time.time()
            left = build(spark, folder).toPandas()
            took = time.time() - t
            note = ""
            if name in sqls:
                t = time.time()
                right = con.execute(sqls[name]).df()
                note = difference(left, right)
                took = f"{took:.1f}s sql {time.time() - t:.1f}s"
            else:
                took = f"{took:.1f}s rows only"
            if not len(left):
                note = note or "no rows"
        except Exception as error:
            note, took, left = f"{type(error).__name__}: {str(error)[:700]}", "", []
        print(("ok   " if not note else "FAIL ") + f"{name} {len(left)} rows {took} {note}", flush=True)
        failed += [name] if note else []
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01"))
