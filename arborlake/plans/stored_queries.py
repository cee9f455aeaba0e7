"""Queries over what is stored: sketches, manifests, snapshots found through the registry, arrivals, provider files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import access, audit, diff, rollup
from ..operators import registry as G
from ..sources import access_logs, sinks
from ..steps import materialise, new_path
from ..streaming import arrivals
from . import diff_queries
from . import fixtures as X
from ._register import registrar

QUERIES: dict = {}
query = registrar(QUERIES)


def _near(estimate: str, exact: str):
    return F.abs(F.col(estimate) - F.col(exact)) <= 0.05 * F.col(exact)


_UP = f"{X.ACCESS}, up AS (SELECT *, unnest(['.', string_split(path, '/')[1], array_to_string(string_split(path, '/')[1:2], '/'), path]) AS dir FROM access)"


@query(f"WITH {_UP} SELECT bucket, dir AS path, op, count(DISTINCT requester) AS n_exact, true AS near FROM up GROUP BY bucket, dir, op")
def stored_requesters(spark, sf_dir):
    """Requesters of every level and verb, over all days, from stored sketches; near is within 5 % of the exact number."""
    rows = X.access(spark, sf_dir)
    merged = access.merged_requesters(materialise(access.requester_sketches(rows), "requesters"), "bucket", "path", "op")
    up = rows.select("bucket", F.explode(P.ancestors("path", own=True)).alias("dir"), "op", "requester")
    exact = up.groupBy("bucket", P.named("dir").alias("path"), "op").agg(F.countDistinct("requester").alias("n_exact"))
    return exact.join(merged, ["bucket", "path", "op"], "left").select("bucket", "path", "op", "n_exact", F.coalesce(_near("n_requesters", "n_exact"), F.lit(False)).alias("near"))


@query(f"WITH {X.SNAPSHOT} SELECT kind, count(*) AS n_rows, count(DISTINCT regexp_extract(path, '[^/]*$')) AS n_exact, true AS near FROM snap WHERE path <> '.' GROUP BY 1")
def stored_names(spark, sf_dir):
    """Names by kind from sketches by depth and kind, merged over the depths."""
    snap = materialise(X.snapshot(spark, sf_dir).select("path", "kind"), "names")
    merged = audit.merged_names(materialise(audit.name_sketches(snap), "name-sketches"), "kind")
    exact = snap.where(F.col("path") != P.ROOT).groupBy("kind").agg(F.countDistinct(P.basename("path")).alias("n_exact"))
    return exact.join(merged, "kind", "left").select("kind", "n_rows", "n_exact", F.coalesce(_near("n_names", "n_exact"), F.lit(False)).alias("near"))


@query(f"WITH {X.SNAPSHOT} SELECT path, kind, size, depth FROM snap WHERE starts_with(path, 'EUROPE/') AND depth BETWEEN 2 AND 4")
def browse_by_manifest(spark, sf_dir):
    """A slice of a written snapshot; the manifest names the files to open."""
    to = new_path(spark, "sink")
    sinks.write_snapshot(X.snapshot(spark, sf_dir), to, 16)
    sinks.write_manifest(spark, to)
    return sinks.read_slice(spark, to, "EUROPE", 2, 4).select("path", "kind", "size", "depth")


@query(f"WITH {X.SNAPSHOT} SELECT count(*) AS n_rows, min(depth) AS least, max(depth) AS most, true AS apart FROM snap")
def snapshot_manifest(spark, sf_dir):
    """The manifest's totals; apart is that no two files overlap but in rows of one path."""
    to = new_path(spark, "sink")
    sinks.write_snapshot(X.snapshot(spark, sf_dir), to, 16)
    sinks.write_manifest(spark, to)
    files = spark.read.parquet(f"{to}.manifest")
    ends = F.array_sort(F.collect_list(F.struct("first", "last")))  # one pair per file of the snapshot
    apart = F.forall(F.sequence(F.lit(1), F.size(ends)), lambda k: (k == 1) | (F.element_at(ends, k).getField("first") >= F.element_at(ends, F.greatest(k - 1, F.lit(1))).getField("last")))
    return files.agg(F.sum("n_rows").alias("n_rows"), F.min("first.depth").alias("least"), F.max("last.depth").alias("most"), apart.alias("apart"))


def _stored_pair(spark, sf_dir):
    """Two scans of one URI, stored and registered."""
    rows = None
    for k, (snap, day) in enumerate(zip(X.two_snapshots(spark, sf_dir), ("2024-01-01", "2024-01-02"), strict=True), start=1):
        blob = new_path(spark, "scan")
        sinks.write_snapshot(snap, blob, derived=rollup.derived(X.SCHEME))
        row = G.register(spark.read.parquet(blob), k, X.SCHEME, day, blob)
        rows = row if rows is None else rows.unionByName(row)
    return materialise(rows, "registry")


@query(diff_queries.QUERIES["diff_recursive"][1])
def diff_latest_scans(spark, sf_dir):
    """The newest two scans of a URI, found through the registry; nothing is rolled up again."""
    return diff.recursive_diff(*G.latest_pair(spark, _stored_pair(spark, sf_dir), X.SCHEME))


@query(f"WITH {X.TWO} SELECT path, kind, size, n_desc FROM sb")
def reused_snapshot(spark, sf_dir):
    """The newest stored scan that has the columns; one that lacks a column is not used again."""
    reg = _stored_pair(spark, sf_dir)
    if G.reusable(spark, reg, X.SCHEME, ["n_read"]) is not None or G.reusable(spark, reg, f"{X.SCHEME}/x") is not None:
        raise ValueError("a snapshot without the columns was found")
    return G.reusable(spark, reg, X.SCHEME, ["path", "n_desc"]).select("path", "kind", "size", "n_desc")


@query(f"WITH {X.SNAPSHOT}, d AS (SELECT depth, count(*) AS n FROM snap GROUP BY 1) SELECT 'error' AS policy, false AS refused, n AS n_rows FROM d WHERE depth = 1 UNION ALL SELECT 'error again', true, n FROM d WHERE depth = 1 UNION ALL SELECT 'reuse', false, n FROM d WHERE depth = 1 UNION ALL SELECT 'clear', false, n FROM d WHERE depth = 2")
def sink_policies(spark, sf_dir):
    """One target written under each policy, and the rows that stand there afterwards."""
    to, snap, out = new_path(spark, "sink"), X.stored_snapshot(spark, sf_dir), None
    for name, policy, depth in (("error", "error", 1), ("error again", "error", 2), ("reuse", "reuse", 2), ("clear", "clear", 2)):
        refused = False
        try:
            sinks.write_snapshot(snap.where(F.col("depth") == depth), to, exists=policy)
        except AnalysisException:
            refused = True
        rows = materialise(spark.read.parquet(to).agg(F.lit(name).alias("policy"), F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n_rows")), "policy")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {X.SNAPSHOT} SELECT r_name || '/' || n_name AS prefix, count(*) AS n_rows, CAST(sum(s.size) FILTER (WHERE kind = 'file') AS BIGINT) AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey JOIN snap s ON s.path = r_name || '/' || n_name OR starts_with(s.path, r_name || '/' || n_name || '/') GROUP BY 1")
def covered_by_prefix(spark, sf_dir):
    """A table of prefixes and what each covers; rows meet on their first directory."""
    t = lambda n: X.table(spark, sf_dir, n)
    prefixes = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("prefix"), F.col("r_name").alias("top"))
    met = X.snapshot(spark, sf_dir).withColumn("top", P.first_segment("path")).join(prefixes, "top").where(P.covers("prefix", "path"))
    return met.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("kind") == "file", F.col("size"))).alias("bytes"))


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n_buckets, CAST(sum(o_orderkey * 24) AS BIGINT) AS byte_hours FROM orders GROUP BY 1")
def storage_daily(spark, sf_dir):
    """Orders as rows of a daily storage CSV: a bucket and its byte-hours."""
    to, o = new_path(spark, "storage"), X.table(spark, sf_dir, "orders")
    o.select(F.to_date("o_orderdate").cast("string").alias("day"), F.concat(F.lit("b"), F.col("o_orderkey")).alias("bucket"), (F.col("o_orderkey") * 24).alias("storage_byte_hours")).write.option("header", True).csv(to)
    rows = access_logs.parse_storage_daily(spark, to)
    return rows.groupBy("day").agg(F.count("bucket").alias("n_buckets"), F.sum(F.col("storage_byte_hours").cast("long")).alias("byte_hours"))


@query(f"WITH {X.ACCESS} SELECT op, count(*) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, count(DISTINCT path) AS n_paths FROM access GROUP BY 1")
def plugged_in_parser(spark, sf_dir):
    """A provider of JSON lines, registered as a plug-in and found by its name."""
    to = new_path(spark, "log")
    X.access(spark, sf_dir).write.json(to)
    schema = X.access(spark, sf_dir).schema
    access_logs.register_parser("jsonl", lambda session, path, store: session.read.schema(schema).json(path).withColumn("store", F.lit(store)))
    rows = access_logs.parser_for("jsonl")(spark, to, "jsonl")
    return rows.where("store = 'jsonl'").groupBy("op").agg(F.count(F.lit(1)).alias("n_ops"), F.sum("bytes_out").alias("bytes_out"), F.countDistinct("path").alias("n_paths"))


@query("""WITH e AS (SELECT event_id AS k, ts, event_id % 100 NOT IN (7, 13) AS has_id FROM events), m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM e WHERE k % 10 <> 3),
a AS (SELECT * FROM e WHERE k % 10 <> 3 UNION ALL SELECT * FROM e WHERE k % 20 = 0), b AS (SELECT e.*, ts < mark AS late FROM e, m WHERE k % 10 = 3 OR k % 20 = 0)
SELECT CAST(0 AS BIGINT) AS batch, count(*) AS n_rows, (SELECT count(*) FROM e WHERE k % 10 <> 3) AS n_kept, CAST(0 AS BIGINT) AS n_late, (SELECT count(*) FROM e WHERE k % 20 = 0) AS n_repeated FROM a
UNION ALL SELECT 1, count(*), count(*) FILTER (WHERE NOT late AND k % 10 = 3), count(*) FILTER (WHERE late), count(*) FILTER (WHERE NOT late AND k % 20 = 0) FROM b""")
def arrival_counts(spark, sf_dir):
    """Two arrivals: most requests, a twentieth of them twice; then the others and that twentieth again, most of them late."""
    rows = X.access(spark, sf_dir).withColumn("k", F.col("request_id").cast("long"))
    rows = rows.withColumn("request_id", F.when(~(F.col("k") % 100).isin(7, 13), F.col("request_id")))
    twice = rows.where("k % 20 = 0")
    base, schema = new_path(spark, "arrivals"), rows.drop("k").schema
    arrivals.create(spark, base, schema)
    for part in (rows.where("k % 10 <> 3").unionByName(twice), rows.where("k % 10 = 3").unionByName(twice)):
        part.drop("k").write.mode("append").parquet(f"{base}/in")
        arrivals.run_arrivals(spark, f"{base}/in", schema, base, f"{base}/state").awaitTermination()
    return arrivals.counts(spark, base).drop("newest")
