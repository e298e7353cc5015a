"""Compare every named query with its oracle SQL in DuckDB.

    python check.py [folder of tables] [part of a query name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from larkbeam import local_session
from larkbeam.plans import all_queries
from larkbeam.sources.tables import SCHEMAS


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    ordered = frame[sorted(frame.columns)]
    return sorted(repr(row) for row in ordered.itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs between two results as bags of rows, or None."""
    kinds = [{c: str(f[c].dtype) for c in sorted(f.columns)} for f in (got, want)]
    for kind in kinds:
        for column, name in kind.items():
            if name.startswith("datetime64"):
                kind[column] = "datetime64"
    if kinds[0] != kinds[1]:
        return f"columns {kinds[0]} instead of {kinds[1]}"
    a, b = rows(got), rows(want)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} rows instead of {len(b)}; got {only_a[:2]}, want {only_b[:2]}"


def main() -> int:
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    failed = 0
    for name, query in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.perf_counter()
        try:
            got = query.plan(spark, directory).toPandas()
            took = time.perf_counter() - began
            if query.oracle is None:
                result = f"{len(got)} rows, no oracle"
            else:
                wrong = difference(got, con.execute(query.oracle).df())
                failed += wrong is not None
                result = f"{len(got)} rows, " + (f"WRONG: {wrong}" if wrong else "same")
        except Exception as error:  # report and go on with the other queries
            failed += 1
            took = time.perf_counter() - began
            result = f"FAILED: {str(error)[:600]}"
        print(f"{name:34s} {took:7.2f} s  {result}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
