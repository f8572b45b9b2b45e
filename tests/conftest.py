import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casefile.session import checkpoint_dir, get_session  # noqa: E402
from casefile.sources.evidence import EVIDENCE_SCHEMA, conform  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="casefile-test-")
    session = get_session("local[4]", app_name="casefile-tests", shuffle_partitions=8,
                          extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                 "spark.sql.warehouse.dir": os.path.join(scratch, "wh")})
    checkpoint_dir(session)
    yield session


def make_evidence(spark, rows):
    """Evidence frame from dicts (missing fields NULL)."""
    names = [f.name for f in EVIDENCE_SCHEMA.fields]
    data = [tuple(r.get(n) for n in names) for r in rows]
    return conform(spark.createDataFrame(data, EVIDENCE_SCHEMA))
