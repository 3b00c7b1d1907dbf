"""Run every query against its SQL on a table folder: python tools_check.py [sf] [name ...]."""
import glob
import math
import os
import sys
import time

import duckdb

from loci.plans.catalog import QUERIES, SQL, load_all
from loci.session import build_session


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def compare(spark, con, name, folder):
    t0 = time.time()
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    took = time.time() - t0
    cols = sorted(df.columns)
    mine = sorted((tuple(canon(r[c]) for c in cols) for r in rows), key=repr)
    if name not in SQL:
        return "rows", f"{len(mine)} rows", took
    rel = con.sql(SQL[name])
    theirs_cols = list(rel.columns)
    if sorted(theirs_cols) != cols:
        return "COLS", f"{cols} vs {sorted(theirs_cols)}", took
    at = [theirs_cols.index(c) for c in cols]
    theirs = sorted((tuple(canon(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if mine == theirs:
        return "ok", f"{len(mine)} rows", took
    a = [r for r in mine if r not in set(theirs)][:2]
    b = [r for r in theirs if r not in set(mine)][:2]
    n = len(set(mine) - set(theirs))
    return "DIFF", f"{len(mine)} vs {len(theirs)}; {n} differ\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}", took


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    load_all()
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(folder + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    bad = []
    for name in names:
        try:
            state, note, took = compare(spark, con, name, folder)
        except Exception as e:
            state, note, took = "ERR", str(e)[:900], 0
        if state not in ("ok", "rows"):
            bad.append(name)
        print(f"{state:5} {took:6.2f}s {name}: {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
