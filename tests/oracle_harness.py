"""Run a registered query on Spark and its oracle statement on DuckDB and
compare row counts, column names and the multiset of rounded values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))

from bagwise.sources.tables import TABLES


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6) + 0.0
    except Exception:
        pass
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, name: str, fn, sql: str, sf_dir: str):
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    ts = time.time() - t
    dcols, drows = duck(sql, sf_dir)
    sc, sr = canon(scols, srows)
    dc, dr = canon(dcols, drows)
    ok = sc == dc and sr == dr
    msg = f"{name}: spark {len(sr)} rows {ts:.1f}s, duck {len(dr)} rows"
    if sc != dc:
        msg += f" COLS {sc} vs {dc}"
    elif sr != dr:
        diff = [r for r in sr if r not in set(dr)][:3]
        diff2 = [r for r in dr if r not in set(sr)][:3]
        msg += f" VALUES differ: spark-only {diff} duck-only {diff2}"
    return ok, msg


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from bagwise.plans.catalog import REGISTRY
    from bagwise.plans.oracle import ORACLE
    from bagwise.session import get_session
    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0] == "--entry":      # as the driver sees them
        import __spark_entry__ as entry
        REGISTRY, ORACLE, args = entry.queries(), entry.oracle_sql(), args[1:]
    names = args or list(REGISTRY)
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for n in names:
        if n not in ORACLE:
            df = REGISTRY[n](spark, sf)
            print(f"{n}: no oracle, spark rows {df.count()}")
            continue
        try:
            ok, msg = compare(spark, n, REGISTRY[n], ORACLE[n], sf)
        except Exception as e:  # report and go on
            ok, msg = False, f"{n}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("OK   " if ok else "FAIL ") + msg, flush=True)
    print("failed:", bad)
