"""Run queries against their SQL: ``python tests/check_queries.py <folder> [name part]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as e  # noqa: E402
from oracle import compare, connect  # noqa: E402

from brinewave.session import get_session  # noqa: E402

folder, part = sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else ""
spark = get_session(
    "check", "local[8]",
    {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
sql = e.oracle_sql()
for name, fn in e.queries().items():
    if part not in name:
        continue
    t = time.time()
    try:
        df = fn(spark, folder)
        if name in sql:
            n = df.count()
            t1 = time.time() - t
            problem = compare(df, con, sql[name])
            print(f"{'ok ' if problem is None else 'BAD'} {name} {n} rows {t1:.1f}s {problem or ''}", flush=True)
        else:
            print(f"-   {name} {len(df.collect())} rows {time.time() - t:.1f}s", flush=True)
    except Exception as x:
        if os.environ.get("TRACE"):
            traceback.print_exc()
        print(f"ERR {name} {str(x)[:700]}", flush=True)
