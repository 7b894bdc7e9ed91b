"""Run registered Spark queries and their DuckDB oracle side by side (as the driver does).

    python -m tests.oracle_harness [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        v = v.asDict(recursive=True)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return None
        return float(f"{f:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr), [columns[i] for i in order]


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    from __spark_entry__ import oracle_sql, queries
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    sql = oracle_sql().get(name)
    if sql is None:
        res["oracle"] = "none"
        return res
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    sr, sc = rows_of(sdf.columns, s_rows)
    dr, dc = rows_of(d_cols, d_rows)
    res["schema_match"] = sc == dc
    res["match"] = sc == dc and sr == dr
    if verbose and not res["match"]:
        res["spark_cols"], res["duck_cols"] = sc, dc
        ss, ds = set(sr), set(dr)
        res["only_spark"] = [r for r in sr if r not in ds][:3]
        res["only_duck"] = [r for r in dr if r not in ss][:3]
    return res


def main(argv):
    sys.path.insert(0, ".")
    from themelens.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    from __spark_entry__ import queries
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    ok = True
    for n in names or sorted(queries()):
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and go on
            r = {"name": n, "error": repr(e)[:1500]}
        ok &= bool(r.get("match", r.get("oracle") == "none"))
        print(r, flush=True)
    print("ALL OK" if ok else "MISMATCHES")


if __name__ == "__main__":
    main(sys.argv[1:])
