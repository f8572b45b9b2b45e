"""Property tests: duplicates against a pure-Python grouping, refinement against its definition."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from casefile.functions.mediatype import EXTENSION_TYPES, ancestors, refine
from casefile.operators import duplicates

members_strategy = st.lists(
    st.tuples(st.sampled_from(["h0", "h1", "h2", "h3"]), st.text("abc;_/", min_size=1, max_size=6)),
    min_size=0, max_size=60, unique_by=lambda t: t[1])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=members_strategy, hot=st.integers(1, 7))
def test_long_form_equals_python_grouping(spark, rows, hot):
    df = spark.createDataFrame(rows, "file_hash string, label string")
    got = duplicates.duplicate_files(df, hot_rows=hot).collect()
    groups = defaultdict(list)
    for key, label in rows:
        groups[key].append(label)
    want = {(k, len(v), min(v), label) for k, v in groups.items() if len(v) > 1 for label in v}
    assert len(got) == len(want) and {(r.file_hash, r.n, r.first_file, r.label) for r in got} == want


def test_refine_matches_definition(spark):
    types = sorted(set(EXTENSION_TYPES.values())) + ["application/octet-stream", "application/zip", "text/plain"]
    pairs = [(a, b) for a in types for b in sorted(set(EXTENSION_TYPES.values()))]
    df = spark.createDataFrame(pairs, "ct string, cand string")
    got = {(r.ct, r.cand): r.out for r in
           df.select("ct", "cand", refine(F.col("ct"), F.col("cand")).alias("out")).collect()}
    for (ct, cand), out in got.items():
        assert out == (cand if ct in ancestors(cand) else ct), (ct, cand, out)
