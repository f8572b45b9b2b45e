"""The whole raw directory: events, hot digests and zero-length files."""

import hashlib
from collections import Counter

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


def test_events_and_empty_files_go_through_the_directory_queries(spark):
    con = duckdb.connect()
    n_rows = {t: con.execute(f"SELECT count({c}) FROM read_parquet('{SF}/{t}.parquet')").fetchone()[0]
              for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))}
    props = [b"" if k % 97 == 0 else p.encode() for k, p in con.execute(
        f"SELECT event_id, props FROM read_parquet('{SF}/events.parquet') "
        "WHERE event_id % 97 = 0 OR props IS NOT NULL").fetchall()]
    queries = entry.queries()
    listed = queries["whole_directory_files"](spark, SF).collect()
    assert len(listed) == len(props) + sum(n_rows.values())
    events = [r for r in listed if "/evt-" in r.path]
    assert Counter(r.length for r in events) == Counter(map(len, props))
    hashes = [r for r in queries["whole_directory_hashes_sha256"](spark, SF).collect() if "/evt-" in r.path]
    assert Counter(r.file_hash for r in hashes) == Counter(hashlib.sha256(p).hexdigest() for p in props)
    groups = {h: n for h, n in Counter(r.file_hash for r in hashes).items() if n > 1}
    lines = queries["whole_directory_duplicates_sha256"](spark, SF).where("line = 1 and value like '%/evt-%'").collect()
    found = Counter(r.file_hash for r in lines)
    assert found[EMPTY] == groups[EMPTY] > 1
    assert {h: found[h] for h in groups} == groups
