"""Run a registered query on Spark and its oracle on DuckDB and compare the results."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, str):
        return v
    return f"{type(v).__name__}:{v!r}"


def compare(spark, sf: str, name: str, fn, sql: str, con) -> str | None:
    df = fn(spark, sf)
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    exp_cols = [d[0] for d in cur.description]
    exp = cur.fetchall()
    if sorted(got_cols) != sorted(exp_cols):
        return f"columns differ: {sorted(got_cols)} vs {sorted(exp_cols)}"
    gi = [got_cols.index(c) for c in sorted(got_cols)]
    ei = [exp_cols.index(c) for c in sorted(exp_cols)]
    g = sorted(tuple(norm(r[i]) for i in gi) for r in got)
    e = sorted(tuple(norm(r[i]) for i in ei) for r in exp)
    if len(g) != len(e):
        only_g = [x for x in g if x not in set(e)][:3]
        only_e = [x for x in e if x not in set(g)][:3]
        return f"rows {len(g)} vs {len(e)}; spark only {only_g}; oracle only {only_e}"
    bad = [(a, b) for a, b in zip(g, e) if a != b]
    if bad:
        return f"{len(bad)}/{len(g)} rows differ, e.g. {bad[0]}"
    if not g:
        return "empty result on both sides"
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from lumenark.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    pick = sys.argv[1:]
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pick and not any(p in name or p == fn.__module__.rsplit(".", 1)[-1] for p in pick):
            continue
        t = time.time()
        try:
            if name in sqls:
                res = compare(spark, sf, name, fn, sqls[name], con)
            else:
                n = len(fn(spark, sf).collect())
                res = None if n else "no rows"
                name = f"{name} (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            res = f"{type(e).__name__}: {str(e)[:700]}"
        bad += res is not None
        print(f"{'ok  ' if res is None else 'FAIL'} {name} {time.time() - t:.1f}s {res or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
