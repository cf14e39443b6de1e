"""Run registered queries next to their DuckDB statements and compare all rows.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (pd.Timestamp,)):
        return str(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return repr(value)
    return value if isinstance(value, (str, int, bool)) else str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    # integer columns with NULLs come as floats from either side
    out = {}
    for c in cols:
        values = frame[c].tolist()
        out[c] = [_cell(v) for v in values]
    rows = list(zip(*[out[c] for c in cols])) if cols else []
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def fetch_spark(df) -> pd.DataFrame:
    return df.toPandas()


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    start = time.time()
    got = fetch_spark(fn(spark, sf_dir))
    took = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got)} rows, {took:.2f}s"
    start = time.time()
    want = con.execute(sql).df()
    duck = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns differ: {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype).replace("datetime64[ns]", "datetime64[us]") != str(want[c].dtype)}
    note = f"{len(a)} rows, spark {took:.2f}s, duckdb {duck:.2f}s" + (f", types {types}" if types else "")
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"{len(a)} / {len(b)} rows; only spark {str(sorted(sa - sb, key=str)[:2])[:700]}; only duckdb {str(sorted(sb - sa, key=str)[:2])[:700]} {note}"
    return True, note


def main() -> int:
    from lorewell.plans import ORACLE, QUERIES, load_all
    from lorewell.session import local_session

    load_all()
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as fault:  # report and go on
            ok, note = False, f"{type(fault).__name__}: {str(fault)[:900]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{len(names)} queries, {bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
