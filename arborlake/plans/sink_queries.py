"""Queries that write with a sink to the shared folder and read back with pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import access
from ..sources import access_logs, sinks
from ..steps import new_path
from . import fixtures as X
from ._register import registrar

QUERIES: dict = {}
query = registrar(QUERIES)


@query(f"WITH {X.SNAPSHOT} SELECT path, kind, size, depth FROM snap WHERE (path = 'ASIA' OR starts_with(path, 'ASIA/')) AND depth BETWEEN 1 AND 3")
def written_snapshot(spark, sf_dir):
    """A snapshot in (depth, path) order; the reader's depth and prefix filters reach its row groups."""
    to = new_path(spark, "sink")
    sinks.write_snapshot(X.snapshot(spark, sf_dir), to, 4)
    return spark.read.parquet(to).where(P.in_depth("depth", 1, 3) & P.under("path", "ASIA")).select("path", "kind", "size", "depth")


@query(f"WITH {X.SNAPSHOT} SELECT path, kind, size FROM snap WHERE path = 'ASIA' OR starts_with(path, 'ASIA/')")
def chunked_snapshot(spark, sf_dir):
    """Large top directories in partitions of their own; the reader touches one of them and the rest."""
    to = new_path(spark, "sink")
    sinks.write_chunked(X.snapshot(spark, sf_dir), to, threshold=1000)
    return P.subtree(sinks.read_chunked(spark, to, "ASIA"), "ASIA").select("path", "kind", "size")


@query(f"WITH {X.SNAPSHOT} SELECT CAST(d AS VARCHAR) AS snapshot_date, path, size FROM snap, (SELECT unnest(['2026-01-01', '2026-01-02']) AS d) WHERE depth = CASE d WHEN '2026-01-01' THEN 2 ELSE 1 END")
def dated_snapshots(spark, sf_dir):
    """Two dates, the first imported twice; its second import replaces the first."""
    to, snap = new_path(spark, "sink"), X.stored_snapshot(spark, sf_dir)
    for date, depth in (("2026-01-01", 3), ("2026-01-02", 1), ("2026-01-01", 2)):
        sinks.write_dated(snap.where(F.col("depth") == depth), to, "b1", date)
    return spark.read.parquet(to).select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "path", "size")


@query(f"WITH {X.TREE} SELECT path, op, CAST(day AS VARCHAR) AS day, n_ops FROM tree WHERE day = (SELECT min(day) FROM tree) AND depth <= 1")
def written_access_tree(spark, sf_dir):
    """An access tree partitioned by day, read for its first day."""
    to = new_path(spark, "sink")
    sinks.write_access_tree(access.access_tree(X.access(spark, sf_dir)), to)
    rows = spark.read.parquet(to)
    first = rows.agg(F.min("day")).first()[0]
    return rows.where((F.col("day") == F.lit(first)) & (F.col("depth") <= 1)).select("path", "op", F.col("day").cast("string").alias("day"), "n_ops")


@query(f"WITH {X.ACCESS} SELECT op, count(*) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM access GROUP BY 1")
def written_access_rows(spark, sf_dir):
    to = new_path(spark, "sink")
    sinks.write_access_rows(X.access(spark, sf_dir), to)
    return spark.read.parquet(to).select(*access_logs.COLUMNS).groupBy("op").agg(F.count(F.lit(1)).alias("n_ops"), F.sum("bytes_out").alias("bytes_out"))
