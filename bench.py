"""Benchmark: run the registered queries at one scale factor.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8),
BENCH_QUERIES (comma list, default: all), BENCH_REPEAT (2).  Each query is
executed in full with a ``noop`` write (no collect), after one warm-up pass
over the headline query; the reported time per query is the best of
BENCH_REPEAT runs (steady state, without one-off code compilation).
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casefile.plans.queries import QUERIES  # noqa: E402
from casefile.session import get_session  # noqa: E402

HEADLINE = "duplicate_files"


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or sorted(QUERIES)
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    spark = get_session(f"local[{cpus}]", app_name="casefile-bench", shuffle_partitions=2 * cpus,
                        extra={"spark.driver.memory": "16g"})
    _run(QUERIES[HEADLINE](spark, sf_dir))  # warm-up: JIT, codegen cache, file listing
    times = {}
    for name in wanted:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            _run(QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        times[name] = round(min(runs), 3)
    sf_label = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf_label)
    except ValueError:
        sf = sf_label
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
