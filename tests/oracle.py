"""Compare registered queries with their SQL on the same parquet files."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return repr(float(v)) if isinstance(v, int) else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, sys.path[0] + "/..")
    import __spark_entry__ as entry
    from ingestkit.session import local_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(sf)
    failed = 0
    for key, fn in entry.queries().items():
        if only and key not in only:
            continue
        start = time.time()
        try:
            sql_text = entry.oracle_sql().get(key)
            message = compare(session, connection, fn, sql_text, sf) if sql_text else f"no SQL, {fn(session, sf).count()} rows"
        except Exception as e:
            message = "ERROR " + str(e).split("\n")[0][:600]
            if only:
                traceback.print_exc()
        failed += message is not None
        print(f"{key:22} {time.time() - start:6.2f}s {'ok' if message is None else message[:900]}", flush=True)
    print("failed:", failed)
