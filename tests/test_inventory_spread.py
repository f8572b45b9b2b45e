"""The inventory route: remote folders in many units, and reading that spreads however the listing was split."""

import errno
import hashlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from casefile.operators import hashing
from casefile.plans import jobs
from casefile.sources import inventory
from tests.conftest import make_evidence


@pytest.fixture
def store(tmp_path, monkeypatch):
    for k in range(12):
        deep = tmp_path / f"d{k}" / "sub" / "deep"
        deep.mkdir(parents=True)
        (tmp_path / f"d{k}" / f"a{k}").write_bytes(b"a" * k)
        (deep / f"b{k}").write_bytes(b"bb")
    (tmp_path / "top").write_bytes(b"t")
    (tmp_path / "d3" / ".hidden").mkdir()
    (tmp_path / "d3" / ".hidden" / "h").write_bytes(b"h")
    monkeypatch.setattr(inventory, "_remote", lambda uri: (fs.LocalFileSystem(), str(tmp_path)))
    return "store://host" + str(tmp_path)


def listed(uri, **options):
    reader = inventory.FileInventoryReader({"path": uri, **options})
    units = reader.partitions()
    return units, [row[0] for unit in units for row in reader._rows(unit.value)]


@pytest.mark.parametrize("target", ["1", "4", "13", "64"])
def test_remote_tree_is_listed_once_by_many_units(store, target):
    whole = sorted(r[0] for r in inventory._remote_rows(store, True, False))
    units, paths = listed(store, targetPartitions=target)
    assert len(whole) == 25 and sorted(paths) == whole
    assert len(units) >= min(int(target), 12)
    _, shown = listed(store, targetPartitions=target, includeHidden="true")
    assert len(shown) == 26 and len(set(shown)) == 26


def test_remote_flat_listing_single_file_and_missing_root(store, monkeypatch, tmp_path):
    assert [p.rsplit("/", 1)[-1] for p in listed(store, recursive="false")[1]] == ["top"]
    monkeypatch.setattr(inventory, "_remote", lambda uri: (fs.LocalFileSystem(), str(tmp_path / "top")))
    assert len(listed(store + "/top")[1]) == 1
    monkeypatch.setattr(inventory, "_remote", lambda uri: (fs.LocalFileSystem(), str(tmp_path / "gone")))
    with pytest.raises(FileNotFoundError):
        listed(store + "/gone")


def test_reading_a_flat_folder_spreads(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"f{k}").write_bytes(b"x" * k)
    found = hashing.summarize_directory(spark, str(tmp_path), 256, listing="inventory")
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 4
    assert {r.file_hash for r in rows} == {hashlib.sha256(b"x" * k).hexdigest() for k in range(60)} and len(rows) == 60
    types = hashing.read_types(spark, str(tmp_path), listing="inventory").withColumn("task", F.spark_partition_id())
    assert len({r.task for r in types.collect()}) > 4


def test_a_dangling_link_stops_no_job(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "good").write_bytes(b"good")
    (tmp_path / "store" / "empty").write_bytes(b"")
    (tmp_path / "store" / "dangling").symlink_to(tmp_path / "gone")
    evidence = str(tmp_path / "evidence")
    make_evidence(spark, [{"id": "inline", "file_content": b"inline"}]).write.parquet(evidence)
    want = {"inline": b"inline", "good": b"good", "empty": b""}
    for listing in ("index", "inventory"):
        out = str(tmp_path / f"hashes-{listing}")
        jobs.hash_job(spark, evidence, str(tmp_path / "store"), out, listing=listing)
        found = {r.id: r.file_hash for r in spark.read.parquet(out).collect()}
        assert found == {k: hashlib.sha512(v).hexdigest() for k, v in want.items()}
        types = hashing.read_types(spark, str(tmp_path / "store"), listing=listing).collect()
        assert sorted(r.path.rsplit("/", 1)[-1] for r in types) == ["empty", "good"]
    (lost,) = inventory.unreadable_files(spark, str(tmp_path / "store")).collect()
    assert lost.path.endswith("/dangling") and lost.error.startswith("FileNotFoundError")


def test_a_remote_folder_that_cannot_be_listed_is_a_row(store, monkeypatch, tmp_path):
    class Closed:
        """A file system one of whose folders is closed."""

        def __init__(self):
            self.inner = fs.LocalFileSystem()

        def get_file_info(self, asked):
            if isinstance(asked, fs.FileSelector) and asked.base_dir.endswith("d3/sub"):
                raise PermissionError(errno.EACCES, "closed")
            return self.inner.get_file_info(asked)

    monkeypatch.setattr(inventory, "_remote", lambda uri: (Closed(), str(tmp_path)))
    rows = list(inventory._remote_rows(store, True, False))
    assert [(r[0].endswith("/d3/sub"), r[-1]) for r in rows if r[-1]] == [(True, "PermissionError: Permission denied")]
    assert len(rows) == 25  # the file below is lost, the folder is named instead
