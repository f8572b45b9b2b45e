"""Driver contract: entry(), queries(), oracle_sql() against DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, _digest

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["n", "first_file", "label"]
    groups = {}
    for r in rows:
        groups.setdefault((r.first_file, r.n), []).append(r.label)
    assert len(groups) > 90 and all(len(labels) == n and min(labels) == first for (first, n), labels in groups.items())


def test_greens_are_not_vacuous(spark):
    queries = entry.queries()
    assert queries["external_media_type_mismatch"](spark, SF).count() > 0
    assert queries["external_id_collisions"](spark, SF).count() > 0
    assert queries["directory_duplicates_sha256"](spark, SF).count() > 0
    assert queries["media_type_counts"](spark, SF).count() >= 20
    assert len({r.first_file for r in queries["duplicate_preview"](spark, SF).collect()}) == 20


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0
