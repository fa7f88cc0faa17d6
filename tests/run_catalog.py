"""Manual runner: ``python tests/run_catalog.py [sf_dir] [name ...]``."""

import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402
from flowhorizon.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "catalog",
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf), entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            result = compare(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as exc:
            result = "ERROR " + (str(exc).split("JVM stacktrace")[0][:1500] if "-v" not in sys.argv else traceback.format_exc())
        ok = result is None or result.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t:6.2f}s {result or ''}", flush=True)
    print("failed:", bad, "of", len(names))
    spark.stop()


if __name__ == "__main__":
    main()
