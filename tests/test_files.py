import hashlib
import os

import pytest

from casefile.operators import hashing
from casefile.plans import jobs
from casefile.sources import files, inventory


@pytest.fixture()
def tree(tmp_path):
    d = tmp_path / "d"
    (d / "sub" / "k=v").mkdir(parents=True)
    (d / "sub1").mkdir()
    (d / "sub2").mkdir()
    (d / "r1").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"text")
    (d / "r2").write_bytes(b"%PDF-")
    (d / "sub" / "k=v" / "r6").write_bytes(b"hello")
    (d / "a b%20.txt").write_bytes(b"hello")
    (d / "zero").write_bytes(b"")
    (d / "zero2").write_bytes(b"")
    (d / ".hidden").write_bytes(b"h")
    (d / "_under").write_bytes(b"u")
    (d / "sub1" / "dup").write_bytes(b"1")
    (d / "sub2" / "dup").write_bytes(b"2")
    return str(d)


def _names(paths):
    return sorted(p.rsplit("/", 1)[-1] for p in paths)


def test_binary_listing_recursive_without_partition_discovery(spark, tree):
    got = files.directory_files(spark, tree).collect()
    assert _names(r.path for r in got) == ["a b%20.txt", "dup", "dup", "r1", "r2", "r6"]
    assert "k" not in files.binary_files(spark, tree).columns


def test_external_content_keyed_by_name(spark, tree):
    got = files.external_content(spark, tree).collect()
    assert sorted(r.id for r in got) == ["a b%20.txt", "dup", "dup", "r1", "r2", "r6"]


def test_inventory_keeps_zero_length_and_skips_hidden(spark, tree):
    inv = {r.path.rsplit("/", 1)[-1]: r for r in inventory.file_inventory(spark, tree).collect()}
    assert set(inv) == {"a b%20.txt", "dup", "r1", "r2", "r6", "zero", "zero2"}
    assert inv["zero"].length == 0 and inv["r2"].length == 5
    assert len(inv["r1"].permissions) == 9 and inv["r1"].modification_time > 0
    assert inv["r1"].block_size is None and inv["r1"].checksum is None
    assert all(r.path.startswith("file:/") for r in inv.values())
    hidden = inventory.file_inventory(spark, tree, include_hidden=True).collect()
    assert {".hidden", "_under"} <= set(_names(r.path for r in hidden))


def test_inventory_partitions_split_tree(spark, tmp_path):
    root = tmp_path / "t"
    for i in range(6):
        (root / f"d{i}" / "x").mkdir(parents=True)
        (root / f"d{i}" / "x" / "f").write_bytes(b"abc")
        (root / f"top{i}").parent.mkdir(parents=True, exist_ok=True)
        (root / f"top{i}").write_bytes(b"t")
    df = inventory.file_inventory(spark, str(root), target_partitions=3)
    assert df.count() == 12
    assert df.rdd.getNumPartitions() >= 2


def test_directory_hashes_include_empty_files(spark, tree):
    got = {r.path.rsplit("/", 1)[-1]: r.file_hash for r in
           hashing.summarize_directory(spark, tree).collect() if "dup" not in r.path}
    assert got["zero"] == hashlib.sha512(b"").hexdigest()
    assert got["r6"] == got["a b%20.txt"] == hashlib.sha512(b"hello").hexdigest()


def test_directory_duplicates_group_by_digest(spark, tree):
    found = {}
    for r in jobs.directory_duplicates(spark, tree).collect():
        found.setdefault(r.file_hash, []).append(r.label)
    groups = sorted(sorted(_names(v)) for v in found.values())
    assert groups == [["a b%20.txt", "r6"], ["zero", "zero2"]]


def test_directory_reports_written(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    jobs.directory_duplicate_report_job(spark, tree, out + "/dups")
    jobs.inventory_report_job(spark, tree, out + "/meta")
    text = "".join(open(os.path.join(out, "dups", f)).read()
                   for f in sorted(os.listdir(out + "/dups")) if f.startswith("part-"))
    assert text.count("SHA512-Hash: ") == 2
    meta = "".join(open(os.path.join(out, "meta", f)).read()
                   for f in sorted(os.listdir(out + "/meta")) if f.startswith("part-"))
    assert meta.count("File Path =file:/") == 8 and "Permissions =" in meta


def test_flat_directory_is_sliced_without_losing_files(spark, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(230):
        (flat / f"f{i:03d}").write_bytes(b"x" * (i % 7))
    df = inventory.file_inventory(spark, str(flat), files_per_slice=50)
    assert df.rdd.getNumPartitions() == 5
    names = [r.path.rsplit("/", 1)[-1] for r in df.collect()]
    assert sorted(names) == [f"f{i:03d}" for i in range(230)]


def test_inventory_reads_extended_attributes(spark, tmp_path):
    target = tmp_path / "x" / "tagged"
    target.parent.mkdir()
    target.write_bytes(b"data")
    try:
        os.setxattr(target, "user.case", b"A-17")
    except (OSError, AttributeError):
        pytest.skip("file system without user extended attributes")
    row = inventory.file_inventory(spark, str(target.parent)).first()
    assert row.xattrs == {"user.case": "A-17"}
    from casefile.operators import reports

    assert "XAttr user.case =A-17\n" in reports.inventory_report(inventory.file_inventory(spark, str(target.parent))).first().value


def test_inventory_raises_on_a_missing_root_or_scheme(spark, tmp_path):
    for where in (str(tmp_path / "nowhere"), "nosuchscheme://host/x"):
        with pytest.raises(Exception):  # noqa: B017 - the reason differs, the point is that it is not empty
            inventory.file_inventory(spark, where).count()


def test_inventory_keeps_names_that_are_not_utf8(spark, tmp_path):
    folder = os.fsencode(str(tmp_path / "odd"))
    os.mkdir(folder)
    for name in (b"a\xff%.bin", b"plain%20", "gr\u00fc\u00df".encode()):
        with open(os.path.join(folder, name), "wb") as fh:
            fh.write(b"x")
    rows = inventory.file_inventory(spark, str(tmp_path / "odd")).collect()
    assert sorted(_names(r.path for r in rows)) == sorted(["a%FF%25.bin", "plain%20", "gr\u00fc\u00df"])
    assert all(r.length == 1 and r.error is None for r in rows)


def test_inventory_reports_entries_it_cannot_read(spark, tmp_path):
    (tmp_path / "t").mkdir()
    os.symlink(tmp_path / "gone", tmp_path / "t" / "broken")
    (tmp_path / "t" / "fine").write_bytes(b"ab")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in inventory.file_inventory(spark, str(tmp_path / "t")).collect()}
    assert rows["fine"].length == 2 and rows["fine"].error is None
    assert rows["broken"].length is None and "FileNotFoundError" in rows["broken"].error


def test_inventory_lists_other_file_systems_like_local_ones(tree):
    rows = list(inventory._remote_rows("file://" + tree, True, False))
    assert sorted(r[0].rsplit("/", 1)[-1] for r in rows) == ["a b%20.txt", "dup", "dup", "r1", "r2", "r6", "zero", "zero2"]
    assert all(r[4] is not None and r[8] is not None for r in rows)


def test_size_only_listing(spark, tree):
    assert _names(r.path for r in inventory.zero_length_files(spark, tree).collect()) == ["zero", "zero2"]
