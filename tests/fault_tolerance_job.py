"""Run the duplicate pipeline with tasks that fail on their first attempt.

Executed in its own process (``local[2,4]``: up to 4 attempts per task) by
``test_fault_tolerance.py``; prints one JSON line with the clean and the
retried results.
"""

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from casefile.operators import duplicates  # noqa: E402
from casefile.session import get_session  # noqa: E402


def fail_first_attempt(batches):
    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
        raise RuntimeError("injected task loss")
    yield from batches


def main():
    scratch = tempfile.mkdtemp(prefix="casefile-ft-")
    spark = get_session("local[2,4]", shuffle_partitions=4,
                        extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    members = (spark.range(3000).select(
        F.concat(F.lit("h"), (F.col("id") % 97).cast("string")).alias("file_hash"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("label")).repartition(4))
    clean = duplicates.duplicate_files(members)
    want = sorted((r.file_hash, r.n, r.label) for r in clean.collect())
    flaky_in = members.mapInPandas(fail_first_attempt, members.schema)
    retried = duplicates.duplicate_files(flaky_in)
    flaky_out = retried.mapInPandas(fail_first_attempt, retried.schema)
    got = sorted((r.file_hash, r.n, r.label) for r in flaky_out.collect())
    print(json.dumps({"same": got == want, "rows": len(want), "files": len(want)}))
    spark.stop()


if __name__ == "__main__":
    main()
