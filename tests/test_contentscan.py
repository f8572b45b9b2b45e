"""Text by encoding and markup by root element: the column rules and the chunked scanners agree."""

import random

import pytest
from pyspark.sql import functions as F

from casefile.functions.contentscan import PrologScanner, TextScanner
from casefile.functions.mediatype import OCTET_STREAM, with_content_type
from casefile.operators import hashing

CHINESE = "漢字かな交じり文" * 9000
TEXTS = [  # (content, whether it is text)
    ("plain".encode(), True), (b"", False), ("é ü 漢 🎉".encode(), True), (b"caf\xe9 is a word in a one-byte encoding", True),
    (b"\xe9\xe8\xe7\xe0 \xf9", False), ("broken at the end, but mostly plain text é".encode()[:-1], True),
    ("漢字".encode()[:-1], False), (b"bell \x07", False), (b"\xef\xbb\xbf\x00", True),
    (b"\xff\xfe" + "wide".encode("utf-16le"), True), (b"\xfe\xff" + "wide é".encode("utf-16be"), True),
    (b"\xff\xfe" + CHINESE.encode("utf-16le"), True), (b"\xff\xfe" + "wide".encode("utf-16le") + b"x", False),
    (b"\xff\xfe" + "a\x07b".encode("utf-16le"), False), (b"\xff\xfea\x00\x00\xd8b\x00", False),
    (b"\xff\xfe" + "🎉 party".encode("utf-16le"), True), (b"\xff\xfe\x00\xdc", False),
    ("no mark at all".encode("utf-16le"), True), ("no mark at all é".encode("utf-16be"), True),
    (("a" * 10 + "漢" * 11).encode("utf-16le"), False), (("a" * 11 + "漢" * 11).encode("utf-16le"), True),
    ("odd".encode("utf-16le") + b"x", False), ("four bytes".encode("utf-32le"), True), ("four bytes".encode("utf-32be"), True),
    (b"\xff\xfe\x00\x00" + "four".encode("utf-32le"), True), (b"\x00\x00\xfe\xff" + CHINESE.encode("utf-32be"), True),
    (b"\xff\xfe\x00\x00" + b"\x00\x00\x11\x00", False), (b"\x00" * 8, False), (b"\x01\x02\x03\x04", False),
    (b"a\x00b\x00" * 40_000, True), (b"a\x00b\x00" * 40_000 + b"\x00\xd8", False), (b"t" * 100_000 + b"\x00", False),
]
MARKUP = [
    (b"<html>", "text/html"), (b" " * 600 + b"<HTML>", "text/html"), (b"\xef\xbb\xbf\n<title>x", "text/html"),
    (b"<!-- " + b"c" * 2048 + b" -->\n<svg/>", "image/svg+xml"), (b"<!-- a -- b - -->" * 30_000 + b"<body>", "text/html"),
    (b"<?xml version='1.0'?><svg/>", "application/xml"),
    (b"<?xml version='1.0'?><svg xmlns='http://www.w3.org/2000/svg'/>", "image/svg+xml"),
    (b"<?xml version='1.0'?>\n<!DOCTYPE svg PUBLIC 'x' [ <!ENTITY a 'b>'> ] ><x:svg xmlns:x='http://www.w3.org/2000/svg'>",
     "image/svg+xml"),
    (b"<!DOCTYPE html>\n<html xmlns=\"http://www.w3.org/1999/xhtml\">", "application/xhtml+xml"),
    (b"<!doctype  HTML PUBLIC 'a'><!-- x --><p>", "text/html"), (b"<!doctype html", "text/html"), (b"<!DOCTYPE htmlx><p>", None),
    (b"<?xml version='1.0'?><rss version='2.0'>", "application/rss+xml"), (b"<rss>", "application/rss+xml"),
    (b"<feed xmlns='http://www.w3.org/2005/Atom'>", "application/atom+xml"), (b"<feed>", None),
    (b"<?xml version='1.0'?><feed>", "application/xml"), (b"<?xml unclosed", "application/xml"), (b"<?xml-x?><p>", None),
    (b"<note xmlns='urn:x'>", "application/xml"), (b"<note>", None), (b"<", None), (b" \n", None), (b"text <html>", None),
    (b"<!-- never closed <html>", None), (b"<!-- --><!doctype html [", "text/html"), (b"<scripts>", None),
    (b"<script>", "text/html"), (b"<html" + b" a='b'" * 20_000 + b" xmlns='http://www.w3.org/1999/xhtml'>", "text/html"),
    (b"< html>", None), (b"<?php echo 1 ?><head>", "text/html"), (b"<!-- <!doctype html> --><note>", None),
]


def scanned(data, cuts):
    text, prolog = TextScanner(), PrologScanner()
    for low, high in zip([0, *cuts], [*cuts, len(data)]):
        text.feed(data[low:high])
        prolog.feed(data[low:high])
    return text.is_text(), prolog.verdict()


@pytest.mark.parametrize("data,want", TEXTS)
def test_text_in_chunks(data, want):
    rng = random.Random(1)
    for cuts in [[], *([n] for n in range(min(len(data), 60))), sorted(rng.choices(range(len(data) + 1), k=5)),
                 list(range(1, min(len(data), 50)))]:
        assert scanned(data, cuts)[0] is want


@pytest.mark.parametrize("data,want", MARKUP)
def test_markup_in_chunks(data, want):
    rng = random.Random(2)
    for cuts in [[], *([n] for n in range(min(len(data), 130))), sorted(rng.choices(range(len(data) + 1), k=9)),
                 list(range(1, min(len(data), 400)))]:
        assert scanned(data, cuts)[1] == want


def expected(data):
    text, markup = scanned(data, [])
    return markup or ("text/plain" if text else OCTET_STREAM)


def test_columns_equal_the_scanners(spark):
    rng = random.Random(3)
    parts = [b"<", b">", b"html", b"<html>", b"<svg>", b"<!--", b"-->", b"-", b"<?xml", b"?>", b"<!doctype html", b"[", b"]",
             b" ", b"\n", b"xmlns='http://www.w3.org/2000/svg'", b"\xef\xbb\xbf", b"a", b"\x00", b"a\x00", b"\x00a", b"\xe9",
             "é".encode(), b"\x07", b"\xff\xfe", b"\xd8\x00", b"\x00\xdc", b"x" * 20, b"\x00\x00\x00a"]
    cases = [d for d, _ in TEXTS + MARKUP]
    cases += [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    cases += [b"".join(rng.choice([b"a\x00", b"\x00a", b" \x00", b"\xe9\x00", b"\x00\xd8", b"\x00\xdc", b"\x01\x4e"])
                       for _ in range(rng.randint(0, 6))) for _ in range(1000)]
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in enumerate(cases)], "n int, content binary")
    found = {r.n: r.content_type for r in with_content_type(rows, "content").select("n", "content_type").collect()}
    marks = (b"BM", b"PK\x03\x04", b"\x1f\x8b", b"MZ")
    for n, data in enumerate(cases):
        if not data.startswith(marks):
            assert found[n] == expected(data), data[:300]


def test_both_routes_agree_on_files(spark, tmp_path):
    from casefile.sources.files import binary_files

    want = {}
    for n, (data, _) in enumerate(TEXTS + MARKUP):
        if data:
            (tmp_path / f"f{n}").write_bytes(data)
            want[f"f{n}"] = expected(data)
    files = binary_files(spark, str(tmp_path))
    for frame in (hashing.summarize_files(files), hashing.summarize_files(files, max_length=0)):
        assert {r.path.rsplit("/", 1)[-1]: r.content_type for r in frame.collect()} == want
    small = hashing.summarize_paths(files.select("path", F.col("length")), chunk_bytes=7).collect()
    assert {r.path.rsplit("/", 1)[-1]: r.content_type for r in small} == want
