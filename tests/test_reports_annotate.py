import hashlib

from pyspark.sql import functions as F

from casefile.operators import annotate, duplicates, reports
from casefile.plans import jobs
from casefile.sources import evidence as ev
from tests.conftest import make_evidence


def test_duplicate_report_layout(spark):
    m = duplicates.label_members(spark.createDataFrame(
        [("e1", "a", "h"), ("e2", "b", "h")], "id string, file_path string, file_hash string"))
    lines = reports.duplicate_report(m).orderBy("file_hash", "line", "label").collect()
    assert [r.value for r in lines] == ["SHA512-Hash: h ", "e1_a", "e2_b", ""]


def test_inventory_report_layout(spark):
    inv = spark.createDataFrame(
        [("file:/x", "u", "g", "rw-r--r--", 3, None, None, 1, 2, None, None, {"user.k": "v"})],
        "path string, owner string, group string, permissions string, length bigint, block_size bigint, "
        "replication int, access_time bigint, modification_time bigint, checksum string, "
        "checksum_algorithm string, xattrs map<string,string>")
    value = reports.inventory_report(inv).first().value
    assert value == ("File Path =file:/x\nOwner =u\nGroup =g\nPermissions =rw-r--r--\nFile Length =3\n"
                     "Block Size =null\n# Replications =null\nAccess Time =1\nModification Time =2\n"
                     "Checksum (null) =null\nXAttr user.k =v\n\n")


def test_merge_upserts_and_orphans(spark):
    table = make_evidence(spark, [{"id": "a", "file_path": "p", "file_hash": "old"},
                                  {"id": "b", "file_path": "q"}])
    hashes = spark.createDataFrame([("a", "new"), ("z", "orph"), ("y", "h-y"), ("b", None)],
                                   "id string, file_hash string")
    types = spark.createDataFrame([("b", "text/plain"), ("y", "t-y"), ("x", "t-x")], "id string, media_type string")
    full = sorted(map(tuple, annotate.merge_annotations(table, file_hash=hashes, media_type=types).collect()))
    copart = sorted(map(tuple, annotate.merge_annotations_copartitioned(
        table, file_hash=hashes, media_type=types).collect()))
    assert full == copart and len(full) == 5  # a, b from the evidence; orphans z, y, x
    merged = {r.id: r for r in annotate.merge_annotations(table, file_hash=hashes, media_type=types).collect()}
    assert merged["y"].file_hash == "h-y" and merged["y"].media_type == "t-y" and merged["x"].file_hash is None
    assert merged["a"].file_hash == "new" and merged["a"].file_path == "p"
    assert merged["b"].file_hash is None and merged["b"].media_type == "text/plain"
    assert merged["z"].file_hash == "orph" and merged["z"].file_path is None


def test_end_to_end_jobs(spark, tmp_path):
    table = make_evidence(spark, [
        {"id": "e1", "file_path": "a.txt", "file_type": "DATA_FILE", "file_content": b"same"},
        {"id": "e2", "file_path": "b.json", "file_type": "DATA_FILE", "file_content": b"same"},
        {"id": "big", "file_path": "c.pdf", "file_type": "DATA_FILE", "external_path": "/ext/big"},
    ])
    root = tmp_path
    table.write.parquet(str(root / "evidence"))
    (root / "ext").mkdir()
    (root / "ext" / "big").write_bytes(b"%PDF-1.4 body")
    jobs.hash_job(spark, str(root / "evidence"), str(root / "ext"), str(root / "hash"))
    jobs.media_type_job(spark, str(root / "evidence"), str(root / "ext"), str(root / "type"))
    merged = {r.id: r for r in jobs.load_evidence(spark, str(root / "evidence"), str(root / "hash"),
                                                   str(root / "type")).collect()}
    assert merged["big"].file_hash == hashlib.sha512(b"%PDF-1.4 body").hexdigest()
    assert merged["big"].media_type == "application/pdf"
    assert merged["e2"].media_type == "application/json"
    hist = {r.media_type: r.n for r in
            jobs.media_type_histogram(spark, str(root / "evidence"), str(root / "type")).collect()}
    assert hist == {"application/pdf": 1, "application/json": 1, "text/plain": 1}
    jobs.duplicate_report_job(spark, str(root / "evidence"), str(root / "hash"), str(root / "report"))
    text = spark.read.text(str(root / "report"), wholetext=True).agg(F.concat_ws("", F.collect_list("value")))
    assert "e1_a.txt\ne2_b.json" in text.first()[0]


def test_scans_on_edge_rows(spark):
    table = make_evidence(spark, [
        {"id": "e7", "file_hash": ""}, {"id": "e8", "file_hash": "h", "file_path": "p"},
        {"id": "e9", "file_type": None, "file_content": b"x"},
        {"id": "d1", "file_type": "DATA_FILE", "external_path": "/ext/d1", "file_path": "o"},
    ])
    assert [r.id for r in ev.hash_and_path(table).collect()] == ["e8"]
    assert [r.id for r in ev.data_file_content(table).collect()] == ["d1"]
    assert [(r.id, r.file_path) for r in ev.external_original_paths(table).collect()] == [("d1", "o")]
    msg = ev.content_messages(table).first().message
    assert msg == "Entry = d1 with relativePath = o and hdfsPath = /ext/d1 and hbase content size =-1."


def test_annotate_job_single_pass_and_heads(spark, tmp_path):
    from casefile.operators import hashing, mediatypes

    table = make_evidence(spark, [
        {"id": "e1", "file_path": "a.txt", "file_type": "DATA_FILE", "file_content": b"hello"},
        {"id": "x1", "file_path": "x.pdf", "file_type": "DATA_FILE", "external_path": "/ext/x1"},
        {"id": "x2", "file_path": "z.bin", "file_type": "DATA_FILE", "external_path": "/ext/x2"},
    ])
    table.write.parquet(str(tmp_path / "evidence"))
    ext = tmp_path / "ext"
    ext.mkdir()
    (ext / "x1").write_bytes(b"%PDF-1.5" + b"\x00" * 5000)
    (ext / "x2").write_bytes(b"")
    for listing in ("index", "inventory"):
        types = {r.path.rsplit("/", 1)[-1]: r.content_type for r in
                 hashing.read_types(spark, str(ext), listing=listing).collect()}
        assert types == {"x1": "application/pdf", "x2": "application/octet-stream"}
    jobs.annotate_job(spark, str(tmp_path / "evidence"), str(ext), str(tmp_path / "out"))
    merged = {r.id: r for r in jobs.load_evidence(spark, str(tmp_path / "evidence"), str(tmp_path / "out/file_hash"),
                                                   str(tmp_path / "out/media_type")).collect()}
    assert merged["x1"].media_type == "application/pdf"
    assert merged["x2"].file_hash == hashlib.sha512(b"").hexdigest()
    assert merged["x2"].media_type == "application/octet-stream"
    assert merged["e1"].media_type == "text/plain"
    typed = {r.id: r.media_type for r in mediatypes.file_media_types(
        ev.read_evidence(spark, str(tmp_path / "evidence")), hashing.read_types(spark, str(ext))).collect()}
    assert typed == {"e1": "text/plain", "x1": "application/pdf", "x2": "application/octet-stream"}


def test_merged_values_equals_scan_of_merged_view(spark):
    table = make_evidence(spark, [{"id": "a", "media_type": "old/a"}, {"id": "b", "media_type": "old/b"},
                                  {"id": "c"}, {"id": "d", "media_type": "old/d"}])
    fresh = spark.createDataFrame([("a", "new/a"), ("c", "new/c"), ("d", ""), ("z", "new/z"), ("b", None)],
                                  "id string, media_type string")
    want = sorted((r.id, r.media_type) for r in
                  ev.media_types(annotate.merge_annotations(table, media_type=fresh)).collect())
    got = sorted((r.id, r.media_type) for r in annotate.merged_values(table, "media_type", fresh).collect())
    assert got == want == [("a", "new/a"), ("b", "old/b"), ("c", "new/c"), ("z", "new/z")]


def test_bucketed_tables_merge_without_shuffle(spark, tmp_path):
    from casefile.plans import inspect

    table = make_evidence(spark, [{"id": f"e{i}", "file_path": f"p{i}", "file_content": b"x" * (i % 3)}
                                  for i in range(50)])
    table.write.parquet(str(tmp_path / "ev"))
    jobs.hash_job(spark, str(tmp_path / "ev"), None, str(tmp_path / "h"))
    jobs.media_type_job(spark, str(tmp_path / "ev"), None, str(tmp_path / "t"))
    names = jobs.bucket_tables(spark, str(tmp_path / "ev"), str(tmp_path / "b"), 4,
                               (str(tmp_path / "h"), str(tmp_path / "t")), prefix="bt_")
    merged = jobs.merged_tables(spark, names).select("id", "file_path", "file_hash", "media_type")
    assert inspect.exchanges(merged) == []
    one = jobs.merged_tables(spark, {k: v for k, v in names.items() if k != "media_type"}).select(
        "id", "file_path", "file_hash")
    assert inspect.exchanges(one) == []
    plain = jobs.load_evidence(spark, str(tmp_path / "ev"), str(tmp_path / "h"), str(tmp_path / "t")).select(
        "id", "file_path", "file_hash", "media_type")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, plain.collect()))
