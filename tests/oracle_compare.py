"""Run each registered query in Spark and its SQL oracle in DuckDB on the same
Parquet tables and compare row count, column names, types and values
(order-insensitive).  Usable from pytest and as a script:

    python tests/oracle_compare.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                            for x in r))


def compare(spark, sf_dir: str, keys=None, con=None, verbose=True) -> dict:
    import __spark_entry__ as entry
    q, o = entry.queries(), entry.oracle_sql()
    con = con or duck(sf_dir)
    out = {}
    for k in keys or sorted(q):
        t0 = time.time()
        res = {"key": k}
        try:
            sdf = q[k](spark, sf_dir)
            pdf = sdf.toPandas()
            res["spark_sec"] = round(time.time() - t0, 2)
            res["rows"] = len(pdf)
            if k in o:
                ddf = con.execute(o[k]).df()
                res["oracle_rows"] = len(ddf)
                res["cols_ok"] = sorted(pdf.columns) == sorted(ddf.columns)
                if not res["cols_ok"]:
                    res["cols"] = (sorted(pdf.columns), sorted(ddf.columns))
                else:
                    a, b = canon(pdf), canon(ddf)
                    res["values_ok"] = a == b
                    if not res["values_ok"]:
                        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                        res["diff"] = diff
                        res["dtypes"] = (dict(pdf.dtypes.astype(str)), dict(ddf.dtypes.astype(str)))
            res["ok"] = res.get("values_ok", k not in o) and res.get("rows") == res.get(
                "oracle_rows", res.get("rows"))
        except Exception as e:  # noqa: BLE001
            res["ok"] = False
            res["error"] = f"{type(e).__name__}: {str(e)[:800]}"
        out[k] = res
        if verbose:
            print(("OK  " if res["ok"] else "FAIL"), k, {x: y for x, y in res.items()
                                                         if x not in ("key", "ok")}, flush=True)
    return out


if __name__ == "__main__":
    from carepulse.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = local_session(8, 8)
    r = compare(spark, sf, keys)
    bad = [k for k, v in r.items() if not v["ok"]]
    print(f"{len(r) - len(bad)}/{len(r)} ok; failing: {bad}")
