"""A few registered queries against DuckDB on the smallest tables; the driver does all of them."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = ["tree_rollup", "diff_max_depth", "access_tree", "filter_rollup", "latest_scan_per_path", "age_histogram", "gcs_usage_log"]


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(None if r[k] is None else float(r[k]) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert as_rows(df.columns, [tuple(r) for r in df.collect()]) == as_rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(3).count() == 3


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
