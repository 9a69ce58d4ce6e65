"""Run registered queries in Spark and their SQL in DuckDB; compare all rows."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(row[i]) for i in order) for row in rows)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree in columns and rows, else what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    ours = _rows(df.columns, df.collect())
    result = con.sql(entry.oracle_sql()[name])
    theirs = _rows(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} against {sorted(result.columns)}"
    if ours != theirs:
        return (
            f"{sum(ours.values())} rows against {sum(theirs.values())};"
            f" only ours {list((ours - theirs))[:3]}; only SQL {list((theirs - ours))[:3]}"
        )
    return None


if __name__ == "__main__":
    from tellerflow.session import build_session

    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{sys.argv[1]}"
    session, database = build_session(cores="8", shuffle_partitions=8), connect(folder)
    names = sys.argv[2:] or list(entry.queries())
    for query in names:
        began = time.time()
        if query not in entry.oracle_sql():
            print(f"ROWS {query} {entry.queries()[query](session, folder).count()}")
            continue
        try:
            found = difference(session, database, query, folder)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'same' if found is None else 'DIFF'} {query} {time.time() - began:.1f}s {found or ''}", flush=True)
