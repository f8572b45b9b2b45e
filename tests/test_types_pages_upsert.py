"""Media-type search, pages of duplicate groups, repeated upserts, the evidence report."""

import hashlib
import os
import random

import pytest

from casefile.functions import mediatype
from casefile.operators import browse, reports, upsert
from casefile.plans import inspect
from casefile.search import types
from tests.conftest import make_evidence


def test_intervals_are_the_hierarchy():
    numbers = types.numbering()
    assert sorted(first for first, _ in numbers.values()) == list(range(len(numbers)))
    for name, (low, high) in numbers.items():
        inside = {n for n, (at, _) in numbers.items() if low <= at <= high}
        assert inside == {n for n in numbers if name in mediatype.ancestors(n)}
    for search, names in types.GROUPS.items():
        covered = {n for n, (at, _) in numbers.items() if any(a <= at <= b for a, b in types.intervals(search))}
        assert covered == {n for n in numbers if set(mediatype.ancestors(n)) & set(names)}
    spans = types.intervals("text/*")
    assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:])) and types.intervals("x/y") == []


@pytest.fixture(scope="module")
def typed(spark, tmp_path_factory):
    rng = random.Random(4)
    names = sorted(types.numbering()) + ["text/x-own", "application/x-own"]
    rows = [(f"f{n}", rng.choice(names) if n % 3 else "text/plain") for n in range(900)] + [("none", None)]
    path = str(tmp_path_factory.mktemp("typed") / "t")
    types.write_typed(spark.createDataFrame(rows, "id string, media_type string").repartition(4), path)
    return types.read_typed(spark, path, "id string, media_type string, type_no int"), rows


@pytest.mark.parametrize("search,means", [
    ("application/zip", lambda t: "application/zip" in mediatype.ancestors(t)),
    ("application/octet-stream", lambda t: t in types.numbering()),
    ("text/*", lambda t: any(a.startswith("text/") for a in mediatype.ancestors(t))),
    ("archive", lambda t: bool(set(mediatype.ancestors(t)) & set(types.GROUPS["archive"]))),
    ("text/x-own", lambda t: t == "text/x-own"), ("no/such", lambda t: False), ("no/*", lambda t: False)])
def test_search_types(typed, search, means):
    table, rows = typed
    found = types.search_types(table, [search]).collect()
    assert {r.query for r in found} <= {search}
    assert sorted(r.id for r in found) == sorted(i for i, t in rows if t and means(t))


def test_only_the_types_files_are_read(typed):
    table, _ = typed
    chosen = types.of_types(table, "application/zip")
    scan = next(n for n in inspect.plan_nodes(chosen) if n.nodeName().startswith("Scan"))
    assert "type_no" in scan.metadata().get("PartitionFilters").get()
    read = {r.p for r in chosen.selectExpr("_metadata.file_path as p").collect()}
    low, high = types.numbering()["application/zip"]
    assert read and all(low <= int(p.split("type_no=")[1].split("/")[0]) <= high for p in read)
    chosen.collect()
    every = table.selectExpr("_metadata.file_path as p").distinct().count()
    assert scan.metrics().get("numFiles").get().value() <= len(read) < every / 2


def made_groups(spark, sizes):
    rows = [(hashlib.sha256(str(k).encode()).hexdigest(), n, f"first-{k}") for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "file_hash string, n long, first_file string"), sorted(rows, key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_pages_give_every_group_once(spark, digits):
    rng = random.Random(digits)
    groups, order = made_groups(spark, [rng.choice([2, 2, 2, 3, 4, 9, rng.randint(2, 500)]) for _ in range(333)])
    found = browse.numbered_groups(groups, 10, digits).collect()
    assert [r.file_hash for r in sorted(found, key=lambda r: r.place)] == [r[0] for r in order]
    assert sorted(r.place for r in found) == list(range(333)) and all(r.page == r.place // 10 for r in found)
    for page in (0, 7, 33, 34):
        rows = browse.page_of_groups(groups, page, 10, digits).collect()
        assert [r.file_hash for r in sorted(rows, key=lambda r: r.place)] == [r[0] for r in order[10 * page:10 * page + 10]]


def test_a_page_sorts_its_bins_only(spark):
    groups, order = made_groups(spark, [2] * 400 + [3] * 5)
    assert [e for e in inspect.exchanges(browse.numbered_groups(groups, 10)) if "rangepartitioning" in e["partitioning"]] == []
    made = browse.bins(groups, 1).collect()
    touched = [b for b in made if b.first_place < 30 and b.first_place + b.many > 20]
    assert sum(b.many for b in touched) < 100 and len(made) > 16
    members = spark.createDataFrame([(r[0], f"label-{k}") for k, r in enumerate(order) for _ in range(2)],
                                    "file_hash string, label string")
    page = browse.page_of_groups(groups, 2, 10, 1)
    assert browse.page_members(members, page).count() == 20
    with pytest.raises(ValueError):
        browse.page_of_groups(groups, -1)
    assert browse.numbered_groups(groups.limit(0)).count() == 0


def files_of(path):
    return {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns
            for folder, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_batches_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.create(spark, path, "media_type")
    ddl = "id string, media_type string, seq int"
    first = [(f"f{n}", "a/a", 0) for n in range(200)]
    assert upsert.upsert(spark.createDataFrame(first, ddl), path, "media_type", "seq", 8) == 8
    before = files_of(path)
    second = [("f1", "b/b", 1), ("f1", "b/c", 2), ("f1", "b/a", 0), ("new", "n/n", 0), (None, "x/x", 0), ("f2", None, 0)]
    rewritten = upsert.upsert(spark.createDataFrame(second, ddl), path, "media_type", "seq", 8)
    after = files_of(path)
    same = {f for f in before if after.get(f) == before[f]}
    buckets = {f.split("bucket=")[1].split("/")[0] for f in before}
    changed = {f.split("bucket=")[1].split("/")[0] for f in set(before) - same}
    assert rewritten in (1, 2) and len(changed) == rewritten and len(buckets - changed) == 8 - rewritten
    assert {f for f in before if f.split("bucket=")[1].split("/")[0] not in changed} <= same
    third = [("f1", "c/c", 0), ("f3", "c/c", 0), ("f3", "c/c", 0)]
    upsert.upsert(spark.createDataFrame(third, ddl), path, "media_type", None, 8)
    want = {**{f"f{n}": "a/a" for n in range(200)}, "new": "n/n", "f1": "c/c", "f3": "c/c"}
    rows = upsert.read(spark, path, "media_type").collect()
    assert {r.id: r.media_type for r in rows} == want and len(rows) == len(want)
    state = files_of(path)
    assert upsert.upsert(spark.createDataFrame([], ddl), path, "media_type", None, 8) == 0 and files_of(path) == state


def test_a_failed_batch_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    upsert.create(spark, path, "file_hash")
    upsert.upsert(spark.createDataFrame([(f"f{n}", "old") for n in range(50)], "id string, file_hash string"), path,
                  "file_hash", buckets=4)
    before = files_of(path)
    # the table's write fails in its tasks, after the batch itself has been written
    monkeypatch.setattr(upsert, "materialize", lambda df, label: df.withColumn(
        "file_hash", fail("file_hash")))
    from pyspark.sql import functions as F

    def fail(column):
        return F.when(F.col("id") == "f7", F.raise_error(F.lit("lost"))).otherwise(F.col(column)).cast("string")

    batch = spark.createDataFrame([("f7", "new"), ("f8", "new")], "id string, file_hash string")
    with pytest.raises(Exception, match="lost"):
        upsert.upsert(batch, path, "file_hash", buckets=4)
    assert files_of(path) == before
    assert {r.file_hash for r in upsert.read(spark, path, "file_hash").collect()} == {"old"}
    with pytest.raises(ValueError):
        upsert.create(spark, str(tmp_path / "u"), "owner")


def test_evidence_report(spark, tmp_path):
    table = make_evidence(spark, [{"id": "b", "file_path": "p/2", "owner": "o", "file_size": "12"}, {"id": "a"}])
    lines = reports.evidence_report(table)
    reports.write_evidence_report(lines, str(tmp_path / "r"))
    text = [line for name in sorted(os.listdir(tmp_path / "r")) if name.startswith("part-")
            for line in (tmp_path / "r" / name).read_text().splitlines()]
    assert text[:6] == ["File Path =null", "Owner =null", "Group =null", "Permissions =null", "File Length =0",
                        "Access Time =null"]
    assert text[10:15] == ["File Path =p/2", "Owner =o", "Group =null", "Permissions =null", "File Length =12"]
    assert len(text) == 20 and text[9] == text[19] == ""
