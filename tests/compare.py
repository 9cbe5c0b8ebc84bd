"""Run registered queries against their SQL and report differences.

    python -m tests.compare [-s SF] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
ROOT = "/root/testdata"


def oracle(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ROOT}/sf{sf}/{t}.parquet')")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False, name=None):
        out = []
        for v in row:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and v != v):
                out.append(None)
            elif isinstance(v, (float, np.floating)):
                out.append(float(v))
            elif isinstance(v, (bool, np.bool_)):
                out.append(bool(v))
            elif isinstance(v, (int, np.integer)):
                out.append(int(v))
            elif hasattr(v, "isoformat"):
                out.append(v.isoformat()[:10] if str(v)[11:19] in ("", "00:00:00") else v.isoformat()[:19])
            elif isinstance(v, (list, tuple, np.ndarray)):
                out.append(tuple(v))
            else:
                out.append(v)
        rows.append(tuple(out))
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    try:
        return sorted(rows, key=key)
    except TypeError:
        return sorted(rows, key=str)


def check(got, want) -> str:
    """Empty when both frames hold the same rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if not bad:
        return ""
    names = sorted(got.columns)
    cols = {}
    for x, y in bad:
        for n, p, q in zip(names, x, y):
            if p != q:
                cols.setdefault(n, []).append((p, q))
    return f"{len(bad)} rows differ: " + "; ".join(f"{n}: {len(v)} e.g. {v[0]}" for n, v in list(cols.items())[:6])


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tapeloom.session import local_session

    sf = "0.01"
    if argv[:1] == ["-s"]:
        sf, argv = argv[1], argv[2:]
    spark = local_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf)
    sqls = oracle_sql()
    chosen = [n for n in queries() if not argv or any(n.startswith(a) for a in argv)]
    failed = []
    for name in chosen:
        t0 = time.time()
        try:
            got = queries()[name](spark, f"{ROOT}/sf{sf}").toPandas()
            t1 = time.time()
            if name in sqls:
                want = con.execute(sqls[name]).df()
                t2 = time.time()
                message = check(got, want)
                state = "ok" if not message else "FAIL " + message
            else:
                t2 = t1
                state = "rows-only"
            if len(got) == 0:
                state += " EMPTY"
        except Exception as error:  # keep going, the report lists it
            t1 = t2 = time.time()
            state, got = "ERROR " + str(error)[:1200], []
        if not state.startswith(("ok", "rows-only")) or "EMPTY" in state:
            failed.append(name)
        print(f"{name:34s} {len(got):7d} rows spark {t1 - t0:6.2f}s sql {t2 - t1:6.2f}s {state}", flush=True)
    print(f"{len(chosen) - len(failed)}/{len(chosen)} fine; not fine: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
