"""Run registered queries on Spark and their SQL twins on DuckDB and compare the rows.

usage: python tests/oracle_check.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    """Value used for the exact comparison; keeps int and float apart."""
    import numpy as np
    import pandas as pd

    if isinstance(value, (list, np.ndarray)):
        return tuple(normal(v) for v in value)
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, (float, np.floating)):
        return None if value != value else float(value)
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(normal(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


def check(spark, con, name, run, sql, sf_dir):
    """Return (ok, text)."""
    start = time.time()
    spark_frame = run(spark, sf_dir)
    spark_types = dict(spark_frame.dtypes)
    left = spark_frame.toPandas()
    took = time.time() - start
    if sql is None:
        return True, f"rows={len(left)} (no SQL) {took:.1f}s {list(left.columns)[:6]}"
    start = time.time()
    right = con.execute(sql).df()
    sql_took = time.time() - start
    if sorted(left.columns) != sorted(right.columns):
        return False, f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return False, f"rows {len(left)} != {len(right)}"
    a, b = rows_of(left), rows_of(right)
    note = ""
    for column in left.columns:
        lk, rk = left[column].dtype.kind, right[column].dtype.kind
        if lk != rk:
            note += f" dtype[{column}] {spark_types[column]}/{right[column].dtype}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return False, f"{len(bad)} rows differ of {len(a)}: {bad[:2]}{note}"
    return True, f"rows={len(left)} spark {took:.1f}s sql {sql_took:.1f}s{note}"


def main() -> int:
    import duckdb

    import __spark_entry__
    from anchorgrid.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    spark = local_session()
    con = duckdb.connect()
    sf_dir = f"/root/testdata/sf{sf}"
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    failed = []
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, text = check(spark, con, name, run, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(("ok   " if ok else "FAIL ") + name + " " + text, flush=True)
        if not ok:
            failed.append(name)
    print(f"failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
