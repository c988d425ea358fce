"""Compare registered Spark queries with their DuckDB oracle SQL.

Mirrors the driver's gate: same column names, same row count, same
order-insensitive hash of the values. Run as a script to print a table:

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(float(v))
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def table_hash(columns, rows) -> tuple[list[str], int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return [columns[i] for i in order], len(lines), h


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    from txnwatch.catalog import REGISTRY

    e = REGISTRY[name]
    t0 = time.time()
    sdf = e.fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    s_cols, s_n, s_h = table_hash(sdf.columns, srows)
    out = {"query": name, "spark_rows": s_n, "spark_sec": round(time.time() - t0, 2)}
    if not e.sql:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    rel = con.execute(e.sql)
    d_cols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    d_cols_s, d_n, d_h = table_hash(d_cols, drows)
    out.update({"oracle_rows": d_n, "cols_match": s_cols == d_cols_s, "hash_match": s_h == d_h})
    out["status"] = "ok" if (s_cols == d_cols_s and s_n == d_n and s_h == d_h) else "MISMATCH"
    if out["status"] != "ok":
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols_s
        sset = {"|".join(_norm(r[sdf.columns.index(c)]) for c in s_cols) for r in srows}
        dset = {"|".join(_norm(r[d_cols.index(c)]) for c in d_cols_s) for r in drows}
        out["only_spark"] = sorted(sset - dset)[:3]
        out["only_oracle"] = sorted(dset - sset)[:3]
    return out


def main(argv):
    from txnwatch.catalog import REGISTRY
    from txnwatch.session import get_spark

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(REGISTRY)
    spark = get_spark(master=os.environ.get("TXNWATCH_MASTER"))
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, sf_dir, n, con)
        except Exception as exc:  # report and continue
            r = {"query": n, "status": "ERROR", "error": repr(exc)[:400]}
        bad += r["status"] in ("MISMATCH", "ERROR")
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok or rows-only")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
