"""Benchmark: run every registered query on the driver tables and time it.

Env: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8),
``BENCH_QUERIES`` (comma-separated subset, default all). Each query is executed
with the ``noop`` sink, which computes every row without collecting results
to the driver. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from quadrat.queries import QUERIES
    from quadrat.session import build_session

    spark = build_session("quadrat-bench", master=f"local[{cpus}]",
                          shuffle_partitions=max(8, cpus * 2),
                          extra={"spark.driver.memory": "16g"})
    # Warm-up (JVM/JIT, parquet footers); not timed.
    QUERIES["mean_basal_area"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name, q in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    headline = {k: v for k, v in times.items() if not k.endswith("_sparse")}
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "headline_seconds": round(sum(headline.values()), 3),   # the SURVEY §7.3 keys
        "sparse_seconds": round(sum(times.values()) - sum(headline.values()), 3),
        "sf": sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
