import json
import os
import subprocess
import sys


def test_duplicates_survive_task_retries():
    script = os.path.join(os.path.dirname(__file__), "fault_tolerance_job.py")
    out = subprocess.run([sys.executable, script], capture_output=True, text=True, timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("{")]
    assert line, out.stderr[-2000:]
    result = json.loads(line[-1])
    # 97 digests: 90 groups of 31 files and 7 of 30
    assert result == {"same": True, "rows": 3000, "files": 3000}
