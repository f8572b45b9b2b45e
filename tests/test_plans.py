"""Plan-shape assertions: pruning, pushdown, and what crosses a shuffle."""

from casefile.operators import duplicates, hashing, mediatypes
from casefile.plans import inspect
from casefile.plans.queries import QUERIES
from casefile.sources import evidence as ev

SF = "/root/testdata/sf0.001"


def test_metadata_scan_prunes_content(spark, tmp_path):
    from tests.conftest import make_evidence

    make_evidence(spark, [{"id": "a", "file_path": "p", "file_content": b"x"}]).write.parquet(str(tmp_path / "e"))
    table = ev.read_evidence(spark, str(tmp_path / "e"))
    s = inspect.scans(ev.file_metadata(table))
    assert s and "file_content" not in s[0]["read_schema"]
    s = inspect.scans(ev.external_original_paths(table))
    assert "IsNotNull(external_path)" in s[0]["pushed_filters"]
    assert "file_content" not in s[0]["read_schema"]
    s = inspect.scans(hashing.file_hashes(table))
    assert s[0]["read_schema"] == "struct<id:string,file_content:binary>"
    assert "IsNotNull(file_content)" in s[0]["pushed_filters"]
    s = inspect.scans(mediatypes.inline_media_types(table))
    assert s[0]["read_schema"] == "struct<id:string,file_path:string,file_content:binary>"


def test_no_binary_crosses_a_shuffle(spark):
    for name in ["duplicate_files", "file_media_types", "external_media_types", "merged_hashes",
                 "media_type_counts", "file_hashes", "hash_counts"]:
        df = QUERIES[name](spark, SF)
        assert inspect.binary_in_shuffles(df) == [], name


def test_inline_media_types_need_no_shuffle(spark):
    df = QUERIES["inline_media_type_mismatch"](spark, SF)
    assert inspect.exchanges(df) == []


def test_duplicates_shuffle_little(spark):
    for name in ("duplicate_files", "duplicate_members", "duplicate_preview"):
        assert len(inspect.exchanges(QUERIES[name](spark, SF))) <= 3, name
    counts = duplicates.hash_counts(spark.createDataFrame([("h", "l")], "file_hash string, label string"))
    assert len(inspect.exchanges(counts)) == 1


def _aggregates(df):
    return [n.nodeName() for n in inspect.plan_nodes(df) if "Aggregate" in n.nodeName()]


def test_hashes_and_types_do_not_aggregate_inline_rows(spark, tmp_path):
    from tests.conftest import make_evidence

    make_evidence(spark, [{"id": "a", "file_path": "p", "file_content": b"x"}]).write.parquet(str(tmp_path / "e"))
    table = ev.read_evidence(spark, str(tmp_path / "e"))
    assert _aggregates(hashing.file_hashes(table)) == [] and inspect.exchanges(hashing.file_hashes(table)) == []
    spark.createDataFrame([("/x/a", "h", "t")], "path string, file_hash string, content_type string") \
        .write.parquet(str(tmp_path / "s"))
    outside = spark.read.parquet(str(tmp_path / "s"))
    # only the external files are aggregated: once for the anti join, once for the rows
    for df in (hashing.file_hashes(table, outside), mediatypes.file_media_types(table, outside)):
        assert len(_aggregates(df)) <= 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = hashing.hashed_paths(table, outside)
        assert len([e for e in inspect.exchanges(df) if "file_path" in dict(e["columns"])]) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merged_view_moves_no_bytes(spark, tmp_path):
    from casefile.plans import jobs
    from tests.conftest import make_evidence

    make_evidence(spark, [{"id": "a", "file_path": "p", "file_content": b"x"}]).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([("a", "h")], "id string, file_hash string").write.parquet(str(tmp_path / "h"))
    jobs.register_evidence_views(spark, str(tmp_path / "e"), str(tmp_path / "h"), prefix="mv_")
    merged = spark.table("mv_evidence_merged")
    assert "file_content" not in merged.columns and inspect.binary_in_shuffles(merged) == []
    assert merged.collect()[0].file_hash == "h"


def test_external_summary_drops_content_before_join(spark):
    from casefile.sources import testdata

    summaries = hashing.summarize_content(testdata.external_store(spark, SF))
    df = mediatypes.external_media_types(testdata.evidence_from_testdata(spark, SF), summaries)
    assert inspect.binary_in_shuffles(df) == []


def test_media_type_stages_compile(spark):
    """Generated code must compile (no silent fallback to interpreted evaluation)."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ["inline_media_type_mismatch", "file_media_types", "external_media_type_mismatch",
                     "media_type_counts", "merged_media_types"]:
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_the_external_store_is_scanned_once(spark):
    """Neither digests nor verdicts of external files are computed for the join and again for the rows."""
    for name in ("file_media_types", "media_types", "merged_hashes", "file_hashes_sha256"):
        scans = inspect.scans(QUERIES[name](spark, SF))
        # the evidence is a union of five tables; the store's five were read when the narrow result was written
        assert len(scans) <= 14, (name, len(scans))
