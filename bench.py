"""Headline queries, forced by a noop write; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2,
the fastest counts; the first run of each query warms the JVM).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barograph import catalog  # noqa: E402
from barograph.session import get_session  # noqa: E402

HEADLINE = (
    "src_01", "win_03", "win_09", "win_14", "win_22", "win_27", "fil_04", "joi_03", "joi_07", "agg_06", "agg_13",
    "top_03", "sig_04", "sig_05", "sig_06", "dis_03", "dis_05", "dis_06", "dis_12", "fyr_05", "fyr_07", "war_07", "war_09",
    "bkt_07", "bkt_10", "bkt_12", "bkt_14", "mrg_01", "str_01", "str_06", "udx_01", "udx_05",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_session("bench", f"local[{cpus}]", cpus, spark__driver__memory="16g", spark__ui__enabled="false",
                        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "median": round(statistics.median(seconds.values()), 3), "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
