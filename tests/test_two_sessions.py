"""Cached frames and literals belong to one session: a second one in the same process works."""

import json
import subprocess
import sys

SCRIPT = """
import json, sys, tempfile
from casefile.plans.queries import QUERIES
from casefile.session import get_session

seen = []
for _ in range(2):
    spark = get_session("local[2]", shuffle_partitions=2, extra={"spark.checkpoint.dir": tempfile.mkdtemp()})
    seen.append(sorted(map(tuple, QUERIES["media_type_counts"](spark, sys.argv[1]).collect())))
    spark.stop()
print(json.dumps(seen[0] == seen[1] and len(seen[0]) > 10))
"""


def test_a_second_session_starts_afresh():
    run = subprocess.run([sys.executable, "-c", SCRIPT, "/root/testdata/sf0.001"], capture_output=True, text=True,
                         timeout=600)
    assert json.loads(run.stdout.strip().splitlines()[-1]), run.stderr[-2000:]
