"""Compare registered queries with their oracle: python tests/check.py sf0.01 [name-part ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from conftest import make_session  # noqa: E402

import __spark_entry__ as E  # noqa: E402

folder = f"/root/testdata/{sys.argv[1]}"
parts = sys.argv[2:]
spark = make_session()
con = oracle.connect(folder)
sqls = E.oracle_sql()
bad = 0
for name, build in E.queries().items():
    if parts and not any(p in name for p in parts):
        continue
    t = time.time()
    try:
        df = build(spark, folder)
        if name in sqls:
            problems, n = oracle.compare(df, con, sqls[name])
        else:
            n = df.count()
            problems = [] if n else ["no rows"]
    except Exception as exc:  # noqa: BLE001
        problems = [f"{type(exc).__name__}: {str(exc).split('JVM')[0][:700]}"]
        n = ""
    bad += bool(problems)
    print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - t:.1f}s {'(rows only)' if name not in sqls else ''} {n}", flush=True)
    for p in problems:
        print("     ", p[:1500], flush=True)
print("failed", bad)
