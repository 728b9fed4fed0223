"""Run registered queries against their SQL and compare names, rows and values."""

from __future__ import annotations

import collections
import glob
import importlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0) if value != int(value) else str(int(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in value) + "]"
    return str(value)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = _bag(columns, cur.fetchall())
    if got != want:
        extra, missing = got - want, want - got
        show = lambda c: [tuple(str(v)[:150] for v in r) for r in list(c)[:3]]
        return (
            f"{sum(got.values())} rows vs {sum(want.values())}; {sum(extra.values())} only in Spark,"
            f" e.g. {show(extra)}; {sum(missing.values())} only in SQL, e.g. {show(missing)}"
        )
    return None if got else "both sides empty"


if __name__ == "__main__":
    from clauselake.session import build_session

    sf_dir, section, names = sys.argv[1], sys.argv[2], set(sys.argv[3:])
    spark, con = build_session(), connect(sf_dir)
    module = importlib.import_module(f"clauselake.plans.{section}")
    for name, fn in module.QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, fn, module.ORACLES.get(name), sf_dir)
        except Exception as exc:  # keep going to the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {'ok' if problem is None else problem}", flush=True)
