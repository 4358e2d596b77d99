"""Spark-vs-DuckDB comparison, modelled on the driver's correctness gate:
row count, column names, and an order-insensitive value hash."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.9g}" if abs(v) > 1e-9 else "0"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (bool,)):
        return str(int(v))
    return str(v)


def digest(pdf: pd.DataFrame) -> tuple[int, list, str]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records"))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(rows), cols, h, rows


def tolerant_equal(s: pd.DataFrame, d: pd.DataFrame, cols) -> bool:
    def key(r):
        return tuple(_norm(r[c]) if not isinstance(r[c], float) else f"{r[c]:.6g}" for c in cols)
    rs = sorted(s[cols].to_dict("records"), key=key)
    rd = sorted(d[cols].to_dict("records"), key=key)
    for a, b in zip(rs, rd):
        for c in cols:
            x, y = a[c], b[c]
            if isinstance(x, float) and isinstance(y, float):
                if not (math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
                        or (math.isnan(x) and math.isnan(y))):
                    return False
            elif _norm(x) != _norm(y):
                return False
    return True


def compare(spark, name, qfn, sql, sf_dir, con):
    t0 = time.time()
    s = qfn(spark, sf_dir).toPandas()
    t1 = time.time()
    d = con.execute(sql).df()
    t2 = time.time()
    d = d.astype(object).where(pd.notnull(d), None)
    s = s.astype(object).where(pd.notnull(s), None)
    ns, cs, hs, rs = digest(s)
    nd, cd, hd, rd = digest(d)
    ok = ns == nd and cs == cd and hs == hd
    detail = ""
    if not ok and ns == nd and cs == cd and tolerant_equal(s, d, cs):
        return "near", ns, round(t1 - t0, 2), round(t2 - t1, 2), "equal within 1e-9 relative"
    if not ok:
        if cs != cd:
            detail = f"cols spark-only={sorted(set(cs)-set(cd))} duck-only={sorted(set(cd)-set(cs))}"
        elif ns != nd:
            detail = f"rows {ns} vs {nd}"
        else:
            diff = [(a, b) for a, b in zip(rs, rd) if a != b][:2]
            detail = f"first diffs {diff}"
    return ok, ns, round(t1 - t0, 2), round(t2 - t1, 2), detail


def main(names=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from shipgraph.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "12g"})
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for n in sorted(qs):
        if names and n not in names:
            continue
        if n not in sqls:
            t0 = time.time()
            try:
                cnt = qs[n](spark, sf_dir).count()
                print(f"ROWS  {n:28s} rows={cnt} {time.time()-t0:.2f}s", flush=True)
            except Exception as e:  # report and continue
                bad += 1
                print(f"FAIL  {n:28s} {type(e).__name__}: {str(e)[:300]}", flush=True)
            continue
        try:
            ok, rows, ts, td, detail = compare(spark, n, qs[n], sqls[n], sf_dir, con)
        except Exception as e:  # report and continue
            ok, rows, ts, td, detail = False, -1, 0, 0, f"{type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        tag = "NEAR" if ok == "near" else ("OK  " if ok else "FAIL")
        print(f"{tag}  {n:28s} rows={rows} spark={ts}s duck={td}s {detail}",
              flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    sys.exit(1 if main(set(args) or None, sf) else 0)
