"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and ``BENCH_RUNS`` times (default 3) to be timed,
all rows going to the no-op sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from zocalo.queries import QUERIES
from zocalo.session import build_session

HEADLINE = ["A17_grp_month", "A02_met_order_count", "J04_join_asof_backward", "J05_join_validity_interval", "J09_join_knn_threshold",
            "J18_join_structural_similarity", "M03_mem_upsert_merge", "M05_mem_search_structural", "D02_dq_groundedness",
            "E08_ev_threshold_sweep", "Q10_qs_structured", "D11_dq_redact_text"]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "bench",
                          **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            QUERIES[name].run(spark, path).write.format("noop").mode("overwrite").save()
            timed.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(timed[1:] or timed), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": path.rsplit("sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
