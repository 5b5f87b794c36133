"""python tests/check.py <sf_dir> [query ...]: time and compare registered queries."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle
from conftest import session

import __spark_entry__ as entry

warm = "--warm" in sys.argv
sf_dir, *names = [a for a in sys.argv[1:] if a != "--warm"]
spark = session()
spark.sparkContext.setLogLevel("ERROR")
con = oracle.connect(sf_dir)
queries, sql = entry.queries(), entry.oracle_sql()
for name in names or queries:
    t = time.time()
    try:
        df = queries[name](spark, sf_dir)
        if warm:
            df.write.format('noop').mode('overwrite').save()
            t = time.time()
            queries[name](spark, sf_dir).write.format('noop').mode('overwrite').save()
            spent = time.time() - t
        if name in sql:
            problem = oracle.differences(df, con, sql[name])
            verdict = "ok" if problem is None else f"DIFF {problem}"
        else:
            rows = df.collect()
            verdict = f"rows={len(rows)} {rows[0] if rows else ''}"[:300]
    except Exception as e:
        traceback.print_exc(limit=-3)
        verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
    spent = spent if warm else time.time() - t
    print(f"{name:28s} {spent:6.2f}s {verdict}", flush=True)
