"""Run catalogue queries on Spark and their DuckDB twins; compare results.

Usage: python -m tests.compare [SF_DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from reelflow.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except Exception:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (bytes, str)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    ddf = con.execute(sql).df()
    scols, srows = rows_of(sdf)
    dcols, drows = rows_of(ddf)
    problems = []
    if scols != dcols:
        problems.append(f"columns spark={scols} duck={dcols}")
    if len(srows) != len(drows):
        problems.append(f"rows spark={len(srows)} duck={len(drows)}")
    elif scols == dcols and srows != drows:
        for a, b in zip(srows, drows):
            if a != b:
                diff = [(c, x, y) for c, x, y in zip(scols, a, b) if x != y]
                problems.append(f"first diff: {str(diff)[:600]}")
                break
    return problems, len(srows), t1 - t0


def main(argv):
    from reelflow.session import build_session
    import __spark_entry__ as E
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in sqls:
            n = fn(spark, sf_dir).count()
            print(f"{name:24s} rows-only  rows={n}")
            continue
        try:
            problems, n, secs = compare(spark, con, name, fn, sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, n, secs = [f"error: {str(e)[:800]}"], -1, 0
        bad += bool(problems)
        print(f"{name:24s} {'OK ' if not problems else 'BAD'} rows={n} spark={secs:.2f}s {'; '.join(problems)}")
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
