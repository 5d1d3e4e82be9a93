"""Compare registered queries with their SQL in DuckDB, order-insensitively.

    python -m tests.oracle [sf] [name-prefix ...]
"""
from __future__ import annotations

import collections
import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark_df, con, sql: str) -> str:
    """'' when equal, else what differs."""
    cols = sorted(spark_df.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in cols) for r in spark_df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = collections.Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    bad = [(c, t, types[c]) for c, t in spark_df.dtypes
           if (t == "bigint") != (types[c] == "BIGINT") or t in ("int", "smallint")]
    note = f" types {bad}" if bad else ""
    if got != want:
        extra, lack = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"rows {sum(got.values())} against {sum(want.values())}; spark only {extra}; duckdb only {lack}{note}"
    return note


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from cuewright.session import local_session

    sf = argv[0] if argv else "0.01"
    prefixes = tuple(argv[1:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    failed = []
    q, o = queries(), oracle_sql()
    for name in q:
        if not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = q[name](spark, sf_dir)
            if name in o:
                diff = compare(df, con, o[name])
                n = ""
            else:
                diff, n = "", f"rows only: {df.count()}"
        except Exception as e:  # report and go on with the next query
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        print(f"{'FAIL' if diff else 'ok  '} {name:34s} {time.time() - t0:6.1f}s {n} {diff}", flush=True)
        if diff:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
