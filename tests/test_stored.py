"""Manifests, stored sketches, arrivals and the stored queries' SQL."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arborlake.operators import access, audit
from arborlake.operators import rollup as R
from arborlake.plans import stored_queries
from arborlake.sources import sinks
from arborlake.streaming import arrivals

from .test_queries import DATA, as_rows
from .test_snapshots import listing


@pytest.mark.parametrize("name", sorted(stored_queries.QUERIES))
def test_stored_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = entry.queries()[name](spark, DATA), con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert as_rows(df.columns, [tuple(r) for r in df.collect()]) == as_rows(want.columns, want.fetchall())


@pytest.mark.parametrize(("under", "least", "most"), [("d7", 0, 9), ("d7/e1", 2, 3), ("", 1, 1), ("", 0, 0), ("nowhere", 0, 9), ("d7", 5, 9), (".", 0, 9)])
def test_slice_opens_few_files(spark, tmp_path_factory, under, least, most):
    to = str(tmp_path_factory.mktemp("m") / "snap")
    snap = R.rollup_listing(listing(spark, [(f"d{k % 40}/e{k % 3}/{k}", k) for k in range(4_000)]), "")
    sinks.write_snapshot(snap, to, 24, row_group_rows=50)
    sinks.write_manifest(spark, to)
    files = sorted(Path(to).glob("*.parquet"))
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert all(meta.row_group(k).num_rows <= 50 for k in range(meta.num_row_groups))
    inner = under not in ("", ".")
    want = snap.where(F.col("depth").between(least, most))
    want = want.where((F.col("path") == under) | F.col("path").startswith(f"{under}/")) if inner else want
    got = sinks.read_slice(spark, to, under, least, most)
    key = lambda df: sorted(map(str, df.select("path", "kind", "size", "n_desc").collect()))
    assert key(got) == key(want)
    opened = sinks.slice_files(spark, to, under, least, most)
    holding = got.select(F.input_file_name()).distinct().count()
    assert len(opened) <= holding + (3 if inner else 1) and (most >= 9 and not inner or len(opened) < len(files) / 2)
    assert spark.read.parquet(f"{to}.manifest").agg(F.sum("n_rows")).first()[0] == snap.count()


def test_sketches_merge_over_days_and_levels(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("b", f"x/{k % 3}" if k % 7 else None, at + timedelta(hours=k), "GET", f"r{k % 500}") for k in range(3_000)], "bucket string, path string, ts timestamp, op string, requester string")
    first, second = (access.requester_sketches(rows.where(c)) for c in ("ts < '2024-02-01'", "ts >= '2024-02-01'"))
    both = {r["path"]: r["n_requesters"] for r in access.merged_requesters(first.unionByName(second), "path").collect()}
    assert set(both) == {".", "x", "x/0", "x/1", "x/2"} and abs(both["."] - 500) <= 25 and abs(both["x"] - 500) <= 25
    assert access.requester_sketches(rows.limit(0)).count() == 0
    names = audit.merged_names(audit.name_sketches(R.rollup_listing(listing(spark, [(f"a/{k % 900}", 1) for k in range(2_000)]), "")), "kind")
    assert {r["kind"]: (r["n_rows"], abs(r["n_names"] - (900 if r["kind"] == "file" else 1)) <= 45) for r in names.collect()} == {"file": (2_000, True), "dir": (1, True)}


def test_arrivals_account_for_every_row(spark, tmp_path):
    """Random batches against plain Python; every batch runs twice."""
    rng, folder, at = random.Random(5), str(tmp_path / "a"), datetime(2024, 3, 1)
    schema = spark.createDataFrame([], "ts timestamp, request_id string, path string").schema
    arrivals.create(spark, folder, schema)
    kept, newest, want = [], None, []
    known = {f"i{k}": at + timedelta(minutes=20 * k) for k in range(40)}
    for number in range(4):
        ids = [rng.choice(sorted(known)) for _ in range(25)]
        batch = [(known[i], i, "p") for i in ids] + [(at, None, "q"), (at, None, "q"), (None, "z", "p"), (None, "z", "p")]
        df = spark.createDataFrame(batch, schema)
        for _ in range(2):
            arrivals.add_batch(df, number, folder)
        mark = newest - timedelta(hours=2) if newest else None
        late = [r for r in batch if mark and r[0] and r[0] < mark]
        timely = [r for r in batch if r not in late]
        seen = {r[1] for r in kept if r[1] and r[0] and (not mark or r[0] >= mark)}
        new = {r[1]: r for r in timely if r[1] and r[1] not in seen}
        add = [*new.values(), *[r for r in timely if not r[1]]]
        want.append((number, len(batch), len(add), len(late), len(batch) - len(add) - len(late)))
        kept += add
        newest = max([*[r[0] for r in batch if r[0]], *([newest] if newest else [])])
    assert [tuple(r)[:5] for r in arrivals.counts(spark, folder).orderBy("batch").select("batch", "n_rows", "n_kept", "n_late", "n_repeated").collect()] == want
    assert sum(w[3] for w in want) > 0 and sum(w[4] for w in want) > 0
    assert arrivals.kept(spark, folder, schema).count() == len(kept)
    assert spark.read.schema(schema).parquet(f"{folder}/late").count() == sum(w[3] for w in want)
