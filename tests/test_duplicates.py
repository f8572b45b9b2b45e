import pytest

from pyspark.sql import functions as F

from casefile.operators import duplicates, reports
from casefile.plans import inspect


def _members(spark, rows):
    df = spark.createDataFrame(rows, "id string, file_path string, file_hash string")
    return duplicates.label_members(df)


def test_groups_labels_null_path_and_semicolon(spark):
    h1, h2 = "a" * 128, "b" * 128
    m = _members(spark, [("e3", "p/x", h1), ("e4", None, h1), ("e5", "p;q", h2), ("e6", "r", h2),
                         ("e7", "solo", "c" * 128)])
    got = {(r.file_hash, r.n, r.first_file, r.label) for r in duplicates.duplicate_files(m).collect()}
    assert got == {(h1, 2, "e3_p/x", "e3_p/x"), (h1, 2, "e3_p/x", "e4_null"),
                   (h2, 2, "e5_p;q", "e5_p;q"), (h2, 2, "e5_p;q", "e6_r")}
    counts = {r.file_hash: (r.n, r.first_file) for r in duplicates.hash_counts(m, label="label").collect()}
    assert counts == {h1: (2, "e3_p/x"), h2: (2, "e5_p;q"), "c" * 128: (1, "e7_solo")}


@pytest.fixture(scope="module")
def large_group(spark):
    """25,000 files of one digest, and 30 groups of two."""
    rows = spark.range(25_000).select(F.format_string("id%06d", "id").alias("id"), F.lit("p").alias("file_path"),
                                      F.lit("h").alias("file_hash"))
    pairs = spark.range(60).select(F.format_string("x%02d", "id").alias("id"), F.lit("p").alias("file_path"),
                                   F.concat(F.lit("k"), F.floor(F.col("id") / 2)).alias("file_hash"))
    return duplicates.materialize(duplicates.label_members(rows.unionByName(pairs)))


def test_large_group_has_one_header(spark, large_group, tmp_path):
    out = str(tmp_path / "report")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    reports.write_duplicate_report(reports.duplicate_report(large_group, materialized=True), out)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    import glob

    parts = sorted(glob.glob(out + "/part-*"))
    text = "".join(open(p).read() for p in parts)
    groups = [g.split("\n") for g in text.split("\n\n") if g]
    assert text.count("SHA512-Hash: ") == 31 == len(groups) and len(parts) > 1
    for lines in groups:
        assert lines[0].startswith("SHA512-Hash: ") and lines[0].endswith(" ")
        assert lines[1:] == sorted(lines[1:])
        assert len(lines) - 1 == (25_000 if lines[0] == "SHA512-Hash: h " else 2)


def test_preview_takes_groups(large_group):
    rows = duplicates.duplicate_preview(large_group, 20, materialized=True).select("file_hash", "n").collect()
    assert len({r.file_hash for r in rows}) == 20 and len(rows) == 25_000 + 19 * 2
    top = duplicates.duplicate_preview(large_group.where("file_hash != 'h'"), 1, materialized=True).collect()
    assert [r.label for r in sorted(top, key=lambda r: r.label)] == ["x00_p", "x01_p"]


def test_hot_keys_take_the_broadcast_branch(spark, monkeypatch):
    rows = [(f"id{i}", "p", "hot") for i in range(300)] + [(f"c{i}", "p", f"k{i // 2}") for i in range(200)]
    m = _members(spark, rows)
    long = duplicates.duplicate_members(m, hot_rows=50)
    got = {r.file_hash: r.n for r in long.select("file_hash", "n").distinct().collect()}
    assert long.count() == 500 and got["hot"] == 300 and all(v == 2 for k, v in got.items() if k != "hot")
    # the hot key never crosses the member shuffle: it only meets a broadcast
    assert inspect.broadcasts(long)
    # too many hot keys to broadcast: the threshold rises until they are few
    monkeypatch.setattr(duplicates, "MAX_HOT_KEYS", 3)
    assert duplicates.duplicate_members(m, hot_rows=1).count() == 500
