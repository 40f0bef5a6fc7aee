"""Oracle check: run a catalog query on Spark and its SQL on DuckDB, compare.

Mirrors the driver's gate: row count, column names, order-insensitive values.
Usage: python -m quarry.plans.check [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
import time

import duckdb

from quarry.sources.tables import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, entry, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    df = entry.build(spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    s_cols = df.columns
    s_vals = sorted((tuple(_norm(r[c]) for c in sorted(s_cols)) for r in rows), key=repr)
    res = {"name": entry.name, "spark_rows": len(rows), "spark_sec": round(t1 - t0, 2)}
    if entry.sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(entry.sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    idx = {c: i for i, c in enumerate(d_cols)}
    res["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS spark={sorted(s_cols)} duck={sorted(d_cols)}"
        return res
    d_vals = sorted((tuple(_norm(r[idx[c]]) for c in sorted(s_cols)) for r in d_rows), key=repr)
    res["types"] = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    res["duck_types"] = dict(zip(d_cols, [str(t) for t in rel.types]))
    if s_vals == d_vals:
        res["status"] = "match"
    else:
        res["status"] = "VALUES differ"
        sset, dset = set(map(repr, s_vals)), set(map(repr, d_vals))
        res["only_spark"] = list(sset - dset)[:3]
        res["only_duck"] = list(dset - sset)[:3]
    return res


def main(argv):
    from quarry.plans.catalog import REGISTRY
    from quarry.session import get_spark

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(REGISTRY)
    spark = get_spark()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, sf_dir, REGISTRY[n], con)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"bad={bad} of {len(names)}")


if __name__ == "__main__":
    main(sys.argv)
