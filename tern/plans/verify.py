"""Compare registered queries with their DuckDB oracles.

Usage: ``python -m tern.plans.verify [sf_dir] [key ...]``

Comparison: same column names, same row count, and the same multiset of
rows after canonicalizing values (Decimal normalized, floats printed with
repr, dates/timestamps as ISO text).  Columns are compared in name order.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
import time
from collections import Counter

from tern.sources.tables import DRIVER_TABLES


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return canon(tuple(v))
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(canon(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(canon(r[i]) for i in order) for r in data]


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, keys=None, verbose=True) -> dict:
    from tern.plans.registry import oracle_sql, queries

    qs, os_ = queries(), oracle_sql()
    con = duck_connection(sf_dir)
    out = {}
    for key in keys or sorted(qs):
        t0 = time.time()
        try:
            cols, srows = rows_of_spark(qs[key](spark, sf_dir))
        except Exception as e:  # pragma: no cover - reported, not raised
            out[key] = {"ok": False, "error": f"spark: {type(e).__name__}: {e}"[:500]}
            if verbose:
                print(key, out[key])
            continue
        t1 = time.time()
        if key not in os_:
            out[key] = {"ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
        else:
            try:
                ocols, orows = rows_of_duck(con, os_[key])
            except Exception as e:
                out[key] = {"ok": False, "error": f"duckdb: {type(e).__name__}: {e}"[:500]}
                if verbose:
                    print(key, out[key])
                continue
            res = {
                "cols": cols == ocols,
                "rows": (len(srows), len(orows)),
                "values": Counter(srows) == Counter(orows),
                "spark_s": round(t1 - t0, 2),
                "duck_s": round(time.time() - t1, 2),
            }
            res["ok"] = res["cols"] and res["values"]
            if not res["cols"]:
                res["col_diff"] = (cols, ocols)
            elif not res["values"]:
                a, b = Counter(srows), Counter(orows)
                res["only_spark"] = list((a - b).elements())[:3]
                res["only_oracle"] = list((b - a).elements())[:3]
            out[key] = res
        if verbose:
            print(key, out[key], flush=True)
    return out


def main(argv):
    from tern.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or None
    spark = build_session("local[8]")
    res = compare(spark, sf_dir, keys)
    bad = [k for k, v in res.items() if v.get("ok") is False]
    print("FAILED:", bad if bad else "none", f"({len(res)} queries)")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
