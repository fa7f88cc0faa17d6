"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set input and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowhorizon.catalog import load  # noqa: E402
from flowhorizon.session import build_session  # noqa: E402

HEADLINE = [
    "host_windows",
    "host_sequences",
    "temporal_split",
    "window_neighbours",
    "neighbour_mean",
    "clean_flows",
    "interval_labels",
    "host_relative",
    "metrics_at",
    "threshold_sweep",
    "per_host_auc",
    "score_summary",
    "risk_scores",
    "chain_verify",
    "packet_flows",
    "stream_windows",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    names = sys.argv[1:] or HEADLINE
    # one untimed query, so that JVM start-up and class loading are not billed to the first one
    queries["host_windows"](spark, sf).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
