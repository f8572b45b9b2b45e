import pytest
from pyspark.sql import functions as F

from casefile.functions.mediatype import (SIGNATURES, OCTET_STREAM, ancestors, detect, magic_type,
                                          with_content_type, with_media_type)
from casefile.operators import mediatypes
from tests.conftest import make_evidence

PNG = bytes.fromhex("89504E470D0A1A0A") + b"rest of image"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"

CASES = [
    # (content, path, by_content, with_name)
    (PNG, None, "image/png", "image/png"),
    (b"%PDF-1.7\n", None, "application/pdf", "application/pdf"),
    (b"PK\x03\x04rest", "a.docx", "application/zip", DOCX),
    (b"\xff\xd8\xff\xe0JFIF", "x.png", "image/jpeg", "image/jpeg"),
    (b"\x00\x01\x02", None, OCTET_STREAM, OCTET_STREAM),
    (b"\x00\x01\x02", "photo.png", OCTET_STREAM, "image/png"),
    (b"hello", "a.csv", "text/plain", "text/csv"),
    (b"hello", "a.CSV", "text/plain", "text/csv"),
    (b"hello", "noext", "text/plain", "text/plain"),
    (b'{"k": 1}', "e/1.json", "text/plain", "application/json"),
    (b"  \n<!DOCTYPE HTML><html>", "web/1.txt", "text/html", "text/html"),
    (b"<html><body>", "web/1.htm", "text/html", "text/html"),
    (b"<?xml version='1.0'?><svg/>", "pic.svg", "application/xml", "image/svg+xml"),
    (b"RIFF\x00\x00\x00\x00WAVEfmt ", None, "audio/vnd.wave", "audio/vnd.wave"),
    (b"\x00\x00\x00\x18ftypmp42", "clip.m4v", "video/mp4", "video/x-m4v"),
    (b"BM" + b"\x00" * 10, None, "image/bmp", "image/bmp"),
    (b"BMW is a car", "car.txt", "text/plain", "text/plain"),
    (b"x" * 257 + b"ustar\x0000", "a.tar", "application/x-tar", "application/x-tar"),
    (b"caf\xc3\xa9 na\xc3\xafve", "a.txt", "text/plain", "text/plain"),
    (b"tab\tok\r\n", None, "text/plain", "text/plain"),
    (b"bell\x07", "a.txt", OCTET_STREAM, "text/plain"),
    (b"", "a.txt", OCTET_STREAM, "text/plain"),
    ("hi there".encode("utf-16-le").join([b"\xff\xfe", b""]), "u.csv", "text/plain", "text/csv"),
    (b"\xef\xbb\xbfplain", None, "text/plain", "text/plain"),
    (b"\xef\xbb\xbf\n<HTML>", "a.txt", "text/html", "text/html"),
    (b"t" * 600 + b"\x00", "a.bin", OCTET_STREAM, OCTET_STREAM),
    (b"t" * 5000, "a.bin", "text/plain", "text/plain"),
    (b"\x00\x00\x00\x18ftypqt  ", None, "video/quicktime", "video/quicktime"),
    (b"\x00\x00\x00\x18ftypheic", None, "image/heic", "image/heic"),
    (b"\x00\x00\x00\x18ftypM4A ", None, "audio/mp4", "audio/mp4"),
    (b"\x00\x00\x00\x18ftypisom", None, "video/mp4", "video/mp4"),
]


@pytest.fixture(scope="module")
def typed(spark):
    rows = [(i, c, p) for i, (c, p, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, content binary, path string")
    staged = with_media_type(with_content_type(df, "content"), "content_type", "path")
    single = df.select("i", magic_type(F.col("content")).alias("c1"),
                       detect(F.col("content"), F.col("path")).alias("n1"))
    return {r.i: r for r in staged.join(single, "i").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_detection(typed, i):
    _, _, by_content, with_name = CASES[i]
    row = typed[i]
    assert (row.content_type, row.media_type) == (by_content, with_name)
    assert (row.c1, row.n1) == (by_content, with_name)


def test_null_content_gives_null(spark):
    df = spark.createDataFrame([(None, "a.txt")], "content binary, path string")
    assert df.select(detect(F.col("content"), F.col("path"))).first()[0] is None


def test_hierarchy():
    assert ancestors("application/json") == ["application/json", "application/javascript", "text/plain",
                                             OCTET_STREAM]
    assert all(r[0] for r in SIGNATURES)


def test_inline_mismatch_and_counts(spark):
    ev = make_evidence(spark, [
        {"id": "a", "file_path": "x.json", "file_content": b'{"a": 1}'},
        {"id": "b", "file_path": "y.txt", "file_content": b"plain"},
        {"id": "c", "file_path": "z.jpg", "file_content": PNG},
        {"id": "d", "file_path": "e.txt", "file_content": b""},
    ])
    mism = {r.id: (r.type_by_content, r.type_with_name)
            for r in mediatypes.inline_media_type_mismatch(ev).collect()}
    assert mism == {"a": ("text/plain", "application/json")}
    counts = [(r.media_type, r.n) for r in
              mediatypes.media_type_counts(mediatypes.inline_media_types(ev)).collect()]
    assert counts == [("application/json", 1), ("image/png", 1), ("text/plain", 1)]


def test_external_join_uses_name_and_drops_orphans(spark):
    from casefile.operators.hashing import summarize_content

    ev = make_evidence(spark, [{"id": "r3", "file_path": "docs/a.docx", "external_path": "/ext/r3"},
                               {"id": "r4", "file_path": "x.png", "external_path": "/ext/r4"}])
    ext = summarize_content(spark.createDataFrame(
        [("/ext/r3", 8, b"PK\x03\x04abcd"), ("/ext/r4", 4, b"\xff\xd8\xff\xe0"), ("/ext/orphan", 1, b"a")],
        "path string, length bigint, content binary"))
    got = {r.id: r.media_type for r in mediatypes.external_media_types(ev, ext).collect()}
    assert got == {"r3": DOCX, "r4": "image/jpeg"}
    mism = {r.id: r.type_with_name for r in mediatypes.external_media_type_mismatch(ev, ext).collect()}
    assert mism == {"r3": DOCX}
    both = {r.id: r.media_type for r in mediatypes.file_media_types(ev, ext).collect()}
    assert both == got


def test_external_verdict_wins_over_inline(spark):
    from casefile.operators.hashing import summarize_content

    ev = make_evidence(spark, [{"id": "e10", "file_path": "doc.pdf", "file_content": b"plain words",
                                "external_path": "/ext/e10"}])
    ext = summarize_content(spark.createDataFrame([("/ext/e10", 8, b"%PDF-1.7")],
                                                  "path string, length bigint, content binary"))
    got = {r.id: r.media_type for r in mediatypes.file_media_types(ev, ext).collect()}
    assert got == {"e10": "application/pdf"}
    assert {r.id: r.media_type for r in mediatypes.file_media_types(ev).collect()} == {"e10": "text/plain"}
