"""Print, per registered query, its shuffles, broadcasts and scan columns.

Usage: python tools/plan_report.py [sf_dir] [name ...]
Runs each query once (noop write) so the adaptive plan is final.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casefile.plans import inspect  # noqa: E402
from casefile.plans.queries import QUERIES  # noqa: E402
from casefile.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(QUERIES)
    spark = get_session("local[8]", shuffle_partitions=8)
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        ex = inspect.exchanges(df)
        bc = inspect.broadcasts(df)
        scans = inspect.scans(df)
        keys = sorted({re.sub(r"#\d+", "", e["partitioning"]) for e in ex})
        cols = sorted({s["read_schema"] for s in scans if s["read_schema"]})
        print(f"{name}: exchanges={len(ex)} broadcasts={len(bc)} binary_in_shuffle={inspect.binary_in_shuffles(df)}")
        for k in keys:
            print(f"    shuffle {k[:110]}")
        for c in cols:
            print(f"    scan {c[:110]}")


if __name__ == "__main__":
    main()
