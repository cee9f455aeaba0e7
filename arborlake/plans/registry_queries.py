"""Queries over the registry of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as G
from ..operators import update
from . import fixtures as X
from ._register import registrar

QUERIES: dict = {}
query = registrar(QUERIES)
_R = X.REGISTRY
_URI = "gcs://b1/BUILDING"


@query(f"WITH {_R}, k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY time DESC) AS k FROM registry) SELECT id, path, time, size FROM k WHERE k = 1")
def latest_scan_per_path(spark, sf_dir):
    return G.latest_per_path(X.registry(spark, sf_dir)).select("id", "path", "time", "size")


@query(f"WITH {_R} SELECT id, path, time, size FROM registry WHERE path = '{_URI}' ORDER BY time DESC LIMIT 1")
def freshest_covering_scan(spark, sf_dir):
    return G.freshest_covering(X.registry(spark, sf_dir), f"{_URI}/x/y").select("id", "path", "time", "size")


def _with_store(spark, sf_dir):
    """The registry and three scans of the whole bucket, and the rows of those."""
    reg = X.registry(spark, sf_dir)
    months = reg.groupBy("time").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_children"), F.max("n_desc").alias("n_desc"), F.max("mtime").alias("mtime")).where(F.month("time") == 1)
    whole = months.select((F.year("time") * 10).cast("long").alias("id"), F.lit("gcs://b1").alias("path"), "time", F.lit("").alias("blob"), F.lit(None).cast("int").alias("error_count"), F.lit(None).cast("string").alias("error_paths"), "size", "n_children", "n_desc", "mtime")
    rows = reg.where(F.month("time") == 1).select((F.year("time") * 10).cast("long").alias("scan_id"), F.substr("path", F.lit(10)).alias("path"), *G.STATS)
    roots = whole.select(F.col("id").alias("scan_id"), F.lit(".").alias("path"), *G.STATS)
    return reg.unionByName(whole.select(*reg.columns)), rows.unionByName(roots)


_STORE = f"{_R}, jan AS (SELECT * FROM registry WHERE month(time) = 1), store AS (SELECT CAST(year(time) * 10 AS BIGINT) AS id, 'gcs://b1' AS path, time, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_children, max(n_desc) AS n_desc, max(mtime) AS mtime FROM jan GROUP BY time)"


@query(f"WITH {_STORE} SELECT id, path AS scan_path, time, size, n_children, n_desc, mtime FROM registry WHERE path = '{_URI}' UNION ALL SELECT s.id, s.path, s.time, j.size, j.n_children, j.n_desc, j.mtime FROM store s JOIN jan j ON s.time = j.time AND j.path = '{_URI}'")
def scan_history(spark, sf_dir):
    return G.history(*_with_store(spark, sf_dir), _URI)


@query(f"WITH {_STORE}, h AS (SELECT id, path AS scan_path, time, size FROM registry WHERE path = '{_URI}' UNION ALL SELECT s.id, s.path, s.time, j.size FROM store s JOIN jan j ON s.time = j.time AND j.path = '{_URI}') SELECT * FROM h ORDER BY time DESC, id DESC LIMIT 1")
def freshest_holding_scan(spark, sf_dir):
    return G.freshest_holding(*_with_store(spark, sf_dir), _URI).select("id", "scan_path", "time", "size")


@query(f"WITH {_R} SELECT id, path, time, size, size - lag(size) OVER (PARTITION BY path ORDER BY time) AS size_delta FROM registry")
def series_delta(spark, sf_dir):
    return G.series(X.registry(spark, sf_dir))


@query(f"WITH {_R}, s AS (SELECT id, path, time, size, size - lag(size) OVER (PARTITION BY path ORDER BY time) AS size_delta FROM registry WHERE path = '{_URI}') SELECT * FROM s ORDER BY time DESC LIMIT 6")
def series_of_uri(spark, sf_dir):
    return G.series(X.registry(spark, sf_dir), _URI, limit=6)


@query(f"WITH {_R}, k AS (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY time DESC) AS k FROM registry) SELECT path, max(id) FILTER (WHERE k = 2) AS id_a, max(id) FILTER (WHERE k = 1) AS id_b FROM k WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2")
def latest_two_scans(spark, sf_dir):
    return G.latest_two(X.registry(spark, sf_dir))


@query(f"WITH {_R} SELECT path, count(*) AS n_scans FROM registry WHERE NOT (path = '{_URI}' AND time < TIMESTAMP '1996-01-01') GROUP BY 1")
def retention(spark, sf_dir):
    return G.expire(X.registry(spark, sf_dir), _URI, "1996-01-01").groupBy("path").agg(F.count(F.lit(1)).alias("n_scans"))


@query(f"WITH {_R} SELECT b AS bucket, 'gcs://' || b AS uri, CASE WHEN b = 'b1' THEN (SELECT max(time) FROM registry) END AS last_scan, CASE WHEN b = 'b1' THEN (SELECT count(*) FROM registry) ELSE 0 END AS n_scans FROM (SELECT unnest(['b1', 'b2']) AS b)")
def inventory_roll_call(spark, sf_dir):
    buckets = X.registry(spark, sf_dir).select(F.explode(F.array(F.lit("b1"), F.lit("b2"))).alias("bucket")).distinct()
    return G.roll_call(buckets, X.registry(spark, sf_dir), "gcs").drop("scan_path")


@query(f"WITH {_STORE} SELECT (SELECT count(*) FROM store) AS n_scans, (SELECT count(*) FROM store) + (SELECT count(*) FROM jan) AS n_rows, (SELECT CAST(sum(size) AS BIGINT) FROM store) AS total_size FROM (SELECT 1)")
def store_stats(spark, sf_dir):
    return G.store_stats(_with_store(spark, sf_dir)[1])


@query(f"WITH {X.SNAPSHOT} SELECT 'gcs://b1' AS path, size, n_children, n_desc, mtime FROM snap WHERE path = '.'")
def register_snapshot(spark, sf_dir):
    row = G.register(X.snapshot(spark, sf_dir), 1, X.SCHEME, "2024-01-01", "blob-1")
    return row.select("path", "size", "n_children", "n_desc", "mtime")


@query(f"WITH {_STORE} SELECT id, size, n_children FROM store UNION ALL SELECT id, size, n_children FROM registry")
def backfill_stats(spark, sf_dir):
    """Scans of the whole bucket lose their statistics and get them back from their snapshots."""
    reg, rows = _with_store(spark, sf_dir)
    blank = reg.withColumns({c: F.when(F.col("path") != "gcs://b1", F.col(c)) for c in G.STATS})
    return G.backfill_stats(blank, rows).select("id", "size", "n_children")


@query(f"WITH {X.SNAPSHOT} SELECT path, kind, depth FROM snap")
def backfill_depth(spark, sf_dir):
    return G.backfill_depth(X.snapshot(spark, sf_dir).withColumn("depth", F.lit(0))).select("path", "kind", "depth")


@query(f"""WITH {_R}, o AS (SELECT * FROM registry WHERE year(time) = 1995 AND month(time) = 1), n AS (SELECT * FROM registry WHERE time > TIMESTAMP '1995-01-01' AND path <> '{_URI}'), l AS (SELECT path, max(time) AS time FROM n GROUP BY 1)
SELECT o.path AS uri, coalesce(n.size, o.size) AS size, coalesce(n.n_desc, o.n_desc) AS n_desc, n.path IS NOT NULL AS patched FROM o LEFT JOIN l ON o.path = l.path LEFT JOIN n ON n.path = l.path AND n.time = l.time""")
def fresher_child_patch(spark, sf_dir):
    """Children as of January 1995; all but one have newer scans of their own."""
    reg = X.registry(spark, sf_dir)
    old = reg.where((F.year("time") == 1995) & (F.month("time") == 1)).select(F.col("path").alias("uri"), *G.STATS)
    return G.patch_children(old, reg.where(F.col("path") != _URI), "1995-01-01").select("uri", "size", "n_desc", "patched")


@query(f"""WITH {_R}, l AS (SELECT path, max_by(size, time) AS size FROM registry GROUP BY 1), live AS (SELECT DISTINCT path AS uri FROM registry WHERE path <> '{_URI}' UNION SELECT 'gcs://b1/new' UNION SELECT 'gcs://b1/deep')
SELECT v.uri, CASE WHEN l.path IS NOT NULL THEN 'true' WHEN v.uri = 'gcs://b1/deep' THEN 'partial' ELSE 'false' END AS scanned, CASE WHEN v.uri = 'gcs://b1/deep' THEN (SELECT size FROM l WHERE path = '{_URI}') ELSE l.size END AS size FROM live v LEFT JOIN l ON v.uri = l.path""")
def live_children(spark, sf_dir):
    """Scans of one child are known only below ``deep``."""
    reg = X.registry(spark, sf_dir)
    moved = reg.withColumn("path", F.when(F.col("path") == _URI, "gcs://b1/deep/inner").otherwise(F.col("path")))
    live = moved.where(~F.col("path").startswith("gcs://b1/deep")).select(F.col("path").alias("uri")).distinct()
    more = reg.select(F.explode(F.array(F.lit("gcs://b1/new"), F.lit("gcs://b1/deep"))).alias("uri")).distinct()
    return G.merge_live(live.unionByName(more).withColumn("kind", F.lit("dir")), moved, "gcs://b1").select("uri", "scanned", "size")


@query(f"WITH {_R} SELECT CAST(sum(size) AS BIGINT) AS size, count(*) AS n_children FROM (SELECT path, max_by(size, time) AS size FROM registry GROUP BY 1)")
def virtual_root(spark, sf_dir):
    reg = X.registry(spark, sf_dir)
    live = reg.select(F.col("path").alias("uri"), F.lit("dir").alias("kind")).distinct()
    return G.virtual_root(G.merge_live(live, reg, "gcs://b1")).select("size", "n_children")


@query(f"WITH {X.SNAPSHOT}, r AS (SELECT size, n_desc, n_children FROM snap WHERE path = '.'), g AS (SELECT size, n_desc FROM snap WHERE path = 'ASIA') SELECT r.size - g.size AS size, r.n_desc - g.n_desc AS n_desc, r.n_children - 1 AS n_children FROM r, g")
def stats_after_delete(spark, sf_dir):
    s = X.snapshot(spark, sf_dir)
    reg = G.register(s, 1, X.SCHEME, "2024-01-01", "blob-1")
    out, _ = update.delete_subtree(s, "ASIA")
    return update.refreshed_stats(reg, 1, out).select("size", "n_desc", "n_children")


