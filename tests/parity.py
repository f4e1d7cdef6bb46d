"""Spark-vs-DuckDB parity check, the same comparison the driver makes:
column names, types, row count and an order-insensitive multiset of rows
(doubles rounded to 6 places). Usable from pytest and as a script:

    python -m tests.parity --sf /root/testdata/sf0.01 [keys...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from dxspark.plans.fixtures import BASE_TABLES

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
                 "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT",
                 "date": "DATE", "timestamp": "TIMESTAMP"}


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple, str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        # repr keeps the sign of zero: -0.0 and 0.0 hash differently downstream
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return v


def _spark_type(dt) -> str:
    s = dt.simpleString()
    if s.startswith("array<"):
        return SPARK_TO_DUCK.get(s[6:-1], s[6:-1].upper()) + "[]"
    return SPARK_TO_DUCK.get(s, s.upper())


def compare(spark, key: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    con = con or duck_connect(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = {f.name: _spark_type(f.dataType) for f in sdf.schema.fields}
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_types)) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rows = [tuple(_norm(v) for _, v in sorted(zip(rel.columns, row))) for row in rel.fetchall()]
    t2 = time.time()
    res = {"key": key, "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2),
           "rows": (len(s_rows), len(d_rows))}
    res["names_ok"] = sorted(s_types) == sorted(d_types)
    res["types_ok"] = res["names_ok"] and all(s_types[c] == d_types[c] for c in s_types)
    if not res["types_ok"]:
        res["types"] = (s_types, d_types)
    key_fn = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    res["values_ok"] = res["names_ok"] and sorted(s_rows, key=key_fn) == sorted(d_rows, key=key_fn)
    if res["names_ok"] and not res["values_ok"]:
        sa, da = set(s_rows), set(d_rows)
        res["only_spark"] = list(sa - da)[:3]
        res["only_duck"] = list(da - sa)[:3]
    res["ok"] = res["types_ok"] and res["values_ok"]
    return res


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args(argv)
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from dxspark.session import get_spark
    spark = get_spark()
    qs, os_ = e.queries(), e.oracle_sql()
    keys = a.keys or sorted(os_)
    con = duck_connect(a.sf)
    bad = 0
    for k in keys:
        if k not in os_:
            print(f"{k}: no oracle"); continue
        try:
            r = compare(spark, k, qs[k], os_[k], a.sf, con)
        except Exception as ex:  # report and go on
            r = {"key": k, "ok": False, "error": repr(ex)[:600]}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "FAIL"), r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok; {len(qs)} queries, {len(os_)} oracles")


if __name__ == "__main__":
    main()
