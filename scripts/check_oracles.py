"""Compare registered queries with their SQL twins: check_oracles.py SF_DIR [name-prefix ...]"""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from compare import connect, difference, rows_of_spark, rows_of_sql  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from workloads.catalog import CATALOG  # noqa: E402

sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
spark = (
    SparkSession.builder.master("local[8]")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.driver.memory", "12g")
    .config("spark.sql.session.timeZone", "UTC")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
good, bad = 0, []
for name, query in CATALOG.items():
    if prefixes and not name.startswith(prefixes):
        continue
    start = time.time()
    try:
        got = rows_of_spark(query(spark, sf_dir))
        took = time.time() - start
        problem = difference(got, rows_of_sql(con, query.sql())) if query.source else None
    except Exception as error:  # noqa: BLE001
        took, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:700]}"
    good, bad = (good + 1, bad) if problem is None else (good, [*bad, name])
    state = "ok" if query.source else f"rows only ({len(got[1])})" if problem is None else "rows only"
    print(f"{took:6.2f}s {name}: {state if problem is None else 'BAD ' + problem}", flush=True)
print(f"{good} good, {len(bad)} bad: {bad}")
