"""SHA-512 and raw directories against brute force in pandas/hashlib at sf0.001."""

import hashlib
import os

import pytest

from casefile.operators import hashing, reports
from casefile.plans import jobs
from casefile.plans.queries import _evidence, _members, _summaries
from casefile.sources import files, inventory

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hashed(spark):
    """Every content-bearing file of the derived evidence with its SHA-512 by hashlib: (id, file_path, h)."""
    rows = _evidence(spark, SF).select("id", "file_path", "file_content").toPandas()
    stored = {}
    from casefile.sources.testdata import external_store

    for r in external_store(spark, SF).orderBy("path").collect():
        stored[r.path.rsplit("/", 1)[-1]] = bytes(r.content)
    rows["content"] = [stored.get(i) if i in stored else (bytes(c) if c is not None else b"") for i, c in
                       zip(rows.id, rows.file_content)]
    rows = rows[rows.content.map(len) > 0]
    return rows.assign(h=rows.content.map(lambda c: hashlib.sha512(c).hexdigest()))


def test_file_hashes_sha512(spark, hashed):
    got = {r.id: r.file_hash for r in hashing.file_hashes(_evidence(spark, SF), _summaries(spark, SF)).collect()}
    assert got == dict(zip(hashed.id, hashed.h))


def test_duplicate_report_sha512(spark, hashed, tmp_path):
    df = hashed.assign(label=hashed.id + "_" + hashed.file_path.fillna("null"))
    want = sorted(f"SHA512-Hash: {h} \n" + "\n".join(sorted(g.label)) + "\n\n"
                  for h, g in df.groupby("h") if len(g) > 1)
    out = str(tmp_path / "report")
    reports.write_duplicate_report(reports.duplicate_report(_members(spark, SF)), out)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    text = "".join(open(os.path.join(out, p), encoding="utf-8").read() for p in parts)
    assert text == "".join(want)


def test_directory_hashes_and_listing(spark):
    want = {}
    for name in os.listdir(SF):
        with open(os.path.join(SF, name), "rb") as fh:
            want[name] = hashlib.sha512(fh.read()).hexdigest()
    got = {r.path.rsplit("/", 1)[-1]: r.file_hash for r in hashing.summarize_directory(spark, SF).collect()}
    assert got == want
    assert sorted(r.id for r in files.external_content(spark, SF).collect()) == sorted(want)
    inv = {r.path.rsplit("/", 1)[-1]: r.length for r in inventory.file_inventory(spark, SF).collect()}
    assert inv == {n: os.path.getsize(os.path.join(SF, n)) for n in want}
    assert jobs.directory_duplicates(spark, SF).count() == 0
