"""Queries over access rows, batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..operators import access
from ..sources import access_logs
from ..steps import materialise, new_path
from ..streaming import access as stream
from ..streaming import snapshots
from . import fixtures as X
from ._register import registrar

QUERIES: dict = {}
query = registrar(QUERIES)


@query(f"WITH {X.ACCESS} SELECT count(*) FILTER (WHERE event_id % 100 <> 7) AS n_ids, count(*) FILTER (WHERE event_id % 100 = 7) AS n_nulls FROM access")
def access_dedupe(spark, sf_dir):
    rows = access_logs.dedupe(X.access_repeated(spark, sf_dir))
    return rows.agg(F.count("request_id").alias("n_ids"), F.count_if(F.col("request_id").isNull()).alias("n_nulls"))


def _plain_days(df):
    """Days as text, which every engine writes alike."""
    return df.drop("last_ts").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {X.LEAF} SELECT bucket, path, CAST(day AS VARCHAR) AS day, op, n_ops, bytes_out, bytes_in, n_requesters FROM leaf")
def access_leaf(spark, sf_dir):
    return _plain_days(access.access_leaf(X.access(spark, sf_dir)))


@query(f"WITH {X.TREE} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM tree")
def access_tree(spark, sf_dir):
    return _plain_days(access.access_tree(X.access(spark, sf_dir)))


@query(f"WITH {X.TREE} SELECT * EXCLUDE (bucket) REPLACE (CAST(day AS VARCHAR) AS day) FROM tree")
def access_tree_parity(spark, sf_dir):
    return _plain_days(access.access_tree(X.access(spark, sf_dir), parity=True))


@query(None)
def access_tree_hll(spark, sf_dir):
    return access.access_tree_distinct(X.access(spark, sf_dir))


@query(f"WITH {X.ACCESS} SELECT count(*) AS rows_in, count(DISTINCT path) AS n_paths, count(DISTINCT CAST(ts AS DATE)) AS n_days, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM access")
def access_summary(spark, sf_dir):
    return access.access_summary(X.access(spark, sf_dir))


@query(f"WITH {X.TREE} SELECT bucket, path, op, CAST(sum(n_ops) AS BIGINT) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, max(n_requesters) AS n_requesters FROM tree WHERE depth = 1 AND op = 'GET' GROUP BY ALL ORDER BY bytes_out DESC, path LIMIT 5")
def access_top(spark, sf_dir):
    return access.hot_prefixes(access.access_tree(X.access(spark, sf_dir)), depth=1, n=5, op="GET", by="bytes")


@query(f"WITH {X.ACCESS}, l AS (SELECT bucket, path, max(ts) AS t FROM access WHERE op = 'GET' GROUP BY ALL), u AS (SELECT bucket, unnest(['.', string_split(path, '/')[1], array_to_string(string_split(path, '/')[1:2], '/'), path]) AS path, t FROM l) SELECT bucket, path, max(t) AS last_read FROM u GROUP BY ALL")
def read_recency(spark, sf_dir):
    return access.read_recency(X.access(spark, sf_dir))


@query(f"""WITH {X.ACCESS}, l AS (SELECT path, max(ts) FILTER (WHERE op = 'GET') AS t, CAST(sum(bytes_out) AS BIGINT) AS size, CAST(sum(CAST(floor(epoch(ts)) AS HUGEINT) * bytes_out) AS DOUBLE) / CAST(nullif(sum(bytes_out), 0) AS DOUBLE) AS m FROM access GROUP BY 1)
SELECT path, size, round((size / 1e12) * ((1800000000 - coalesce(CAST(floor(epoch(t)) AS DOUBLE), m)) / (365.25 * 86400)) * 1e9, 6) AS score FROM l WHERE size > 0""")
def unread_score(spark, sf_dir):
    """Sizes are the bytes that the requests moved, by path; reads are the GETs."""
    rows = X.access(spark, sf_dir)
    w = F.sum(F.unix_seconds("ts").cast("decimal(19,0)") * F.col("bytes_out").cast("decimal(18,0)")).cast("double")
    sizes = rows.groupBy("bucket", "path").agg(F.sum("bytes_out").alias("size"), w.alias("w")).where("size > 0")
    sizes = sizes.withColumn("mtime_mean", F.col("w") / F.col("size").cast("double"))
    out = access.unread_score(sizes, access.read_recency(rows), F.lit(1_800_000_000))
    return out.select("path", "size", F.round(F.col("unread_tb_years") * 1e9, 6).alias("score"))


@query(f"WITH {X.ACCESS} SELECT op, count(*) AS n_ops FROM access WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1")
def access_between(spark, sf_dir):
    return access_logs.between(X.access(spark, sf_dir), "2024-01-03", "2024-01-10").groupBy("op").agg(F.count(F.lit(1)).alias("n_ops"))


_VERBS = {"view": "storage.get", "purchase": "PUT_Object", "signup": "LIST_Bucket", "click": "HEAD_Object", "error": "WEIRD_OP"}


@query("SELECT CASE event_type WHEN 'purchase' THEN 'PUT' WHEN 'signup' THEN 'LIST' WHEN 'click' THEN 'HEAD' WHEN 'view' THEN 'GET' ELSE 'OTHER' END AS op, count(*) AS n_ops, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS bytes_out, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE user_id % 13 <> 0 GROUP BY 1")
def gcs_usage_log(spark, sf_dir):
    """Events as GCS usage rows; a verb comes from the operation, or from the method without one."""
    e = X.table(spark, sf_dir, "events")
    operation = F.when(F.col("event_type") == "view", F.lit(None))
    for k, v in _VERBS.items():
        if k != "view":
            operation = operation.when(F.col("event_type") == k, v)
    s = lambda c: c.cast("string")
    raw = e.select(s(F.unix_micros(F.col("ts").cast("timestamp"))).alias("time_micros"), s(F.col("user_id")).alias("c_ip"), F.lit("GET").alias("cs_method"), F.lit("200").alias("sc_status"), F.lit(None).cast("string").alias("cs_bytes"), F.get_json_object("props", "$.k").alias("sc_bytes"), F.lit("").alias("cs_user_agent"), s(F.col("event_id")).alias("s_request_id"), operation.alias("cs_operation"), F.when(F.col("user_id") % 13 != 0, "b1").alias("cs_bucket"), F.lit("x").alias("cs_object"))
    rows = access_logs.from_gcs(raw.unionByName(raw))
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n_ops"), F.sum("bytes_out").alias("bytes_out"), F.sum(F.col("request_id").cast("long")).alias("ids"))


@query("SELECT CASE event_type WHEN 'purchase' THEN 'PUT' WHEN 'signup' THEN 'LIST' WHEN 'click' THEN 'HEAD' WHEN 'view' THEN 'GET' ELSE 'DELETE' END AS op, count(*) AS n_ops, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS bytes_out, min(date_trunc('second', ts)) AS first_ts FROM events GROUP BY 1")
def s3_access_log(spark, sf_dir):
    """Events as S3 access log lines."""
    e = X.table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "purchase", "REST.PUT.OBJECT").when(F.col("event_type") == "signup", "REST.GET.BUCKET").when(F.col("event_type") == "click", "REST.HEAD.OBJECT").when(F.col("event_type") == "view", "REST.GET.OBJECT").otherwise("REST.DELETE.OBJECT")
    at = F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss Z")
    line = F.concat_ws(" ", F.lit("own b1"), F.concat(F.lit("["), at, F.lit("]")), F.lit("10.0.0.1 -"), F.concat(F.lit("R"), F.col("event_id").cast("string")), op, F.lit('a/b "GET /a/b HTTP/1.1" 200 -'), F.get_json_object("props", "$.k"), F.lit('- 5 4 "-" "agent x" -'))
    rows = access_logs.from_s3_lines(e.select(line.alias("value")))
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n_ops"), F.sum("bytes_out").alias("bytes_out"), F.min("ts").alias("first_ts"))


@query("SELECT CASE event_type WHEN 'purchase' THEN 'PUT' WHEN 'signup' THEN 'LIST' ELSE 'GET' END AS op, count(*) AS n_ops, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS bytes_out, count(DISTINCT user_id) AS n_paths FROM events GROUP BY 1")
def r2_log(spark, sf_dir):
    """Events as R2 log rows, of requests before the bucket."""
    e = X.table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    raw = e.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("EdgeStartTimestamp"), none.alias("BucketName"), F.lit("cdn.example.com").alias("ClientRequestHost"), F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("?v=1")).alias("ClientRequestURI"), none.alias("ObjectKey"), F.when(F.col("event_type") == "purchase", "PUT").otherwise("GET").alias("ClientRequestMethod"), F.when(F.col("event_type") == "signup", "ListObjects").alias("Operation"), F.lit(200).alias("EdgeResponseStatus"), F.get_json_object("props", "$.k").cast("long").alias("EdgeResponseBytes"), F.lit(None).cast("long").alias("ClientRequestBytes"), none.alias("ClientIP"), none.alias("ClientRequestUserAgent"), F.col("event_id").cast("string").alias("RayID"))
    rows = access_logs.from_r2(raw)
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n_ops"), F.sum("bytes_out").alias("bytes_out"), F.countDistinct("path").alias("n_paths"))


@query("SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS period, o_orderpriority AS service, o_orderstatus AS sku, CAST(count(*) AS DOUBLE) AS usage, CAST(sum(o_shippriority_n) AS DOUBLE) AS cost, count(*) AS n_rows FROM (SELECT *, o_orderkey % 10 AS o_shippriority_n FROM orders) GROUP BY ALL")
def cost_summary(spark, sf_dir):
    """Orders as cost rows: a month, a service, a unit used and a whole-number cost."""
    o = X.table(spark, sf_dir, "orders").withColumn("units", F.lit(1)).withColumn("price", F.col("o_orderkey") % 10)
    out = access.cost_summary(access.normalize_costs(o, {"period": "o_orderdate", "service": "o_orderpriority", "sku": "o_orderstatus", "usage": "units", "cost": "price"}))
    return out.withColumn("period", F.col("period").cast("string"))


def _stream(spark, sf_dir, rows):
    base = new_path(spark, "stream")
    rows.write.parquet(f"{base}/in")
    return base, spark.read.parquet(f"{base}/in").schema


@query(f"""WITH {X.ACCESS}, u AS (SELECT bucket, unnest(['.', string_split(path, '/')[1], array_to_string(string_split(path, '/')[1:2], '/'), path]) AS path, CAST(ts AS DATE) AS day, op, bytes_out, bytes_in FROM access),
m AS (SELECT max(ts) AS t FROM access) SELECT bucket, path, CAST(day AS VARCHAR) AS day, op, count(*) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in FROM u, m WHERE day + INTERVAL 1 DAY <= t - INTERVAL 2 HOUR GROUP BY ALL""")
def access_stream_daily(spark, sf_dir):
    """Requests as a file stream, a twentieth repeated, others without an id; days are written once they are two hours past."""
    rows = X.access(spark, sf_dir)
    rows = rows.unionByName(rows.where("cast(request_id as long) % 20 = 0"))
    rows = rows.withColumn("request_id", F.when(F.col("request_id").cast("long") % 100 != 7, F.col("request_id")))
    base, schema = _stream(spark, sf_dir, rows)
    # the files come in one trigger, so that no row is late; the second, empty trigger emits what is complete
    stream.run_daily_tree(spark, f"{base}/in", schema, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("bucket", "path", F.col("day").cast("string").alias("day"), "op", "n_ops", "bytes_out", "bytes_in")


def _merged_stream(spark, sf_dir):
    """A listing arrives in three loads of as many files as tasks write; the first two batches are compacted into a base, the third stays a delta."""
    base, rows = new_path(spark, "stream"), materialise(X.objects(spark, sf_dir), "listing")
    snapshots.create(spark, f"{base}/out")
    for load in range(3):
        part = rows.where(F.pmod(F.hash("name"), F.lit(3)) == load)
        part.write.mode("append").option("compression", "zstd").parquet(f"{base}/in")
        snapshots.run_snapshot_merge(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/state", compact_every=2, files=None).awaitTermination()
    return f"{base}/out"


@query(f"WITH {X.SNAPSHOT} SELECT path, kind, parent, depth, size, mtime, n_desc, n_files, n_children FROM snap")
def stream_snapshot_merge(spark, sf_dir):
    """Base and deltas, merged when read, are the rollup of the whole listing."""
    return snapshots.read_snapshot(spark, _merged_stream(spark, sf_dir), X.SCHEME).select("path", "kind", "parent", "depth", "size", "mtime", "n_desc", "n_files", "n_children")


@query(f"WITH {X.SNAPSHOT} SELECT path, size, n_desc, n_files, n_children FROM snap WHERE depth <= 2 AND (path = 'ASIA' OR starts_with(path, 'ASIA/'))")
def stream_snapshot_browse(spark, sf_dir):
    """A browse of the merged snapshot: the filter reaches the base's and the deltas' files."""
    rows = snapshots.read_snapshot(spark, _merged_stream(spark, sf_dir), X.SCHEME).where(P.under("path", "ASIA") & P.in_depth("depth", most=2))
    return rows.select("path", "size", "n_desc", "n_files", "n_children")


@query("SELECT event_type, CASE event_type WHEN 'purchase' THEN 'PUT' WHEN 'signup' THEN 'LIST' ELSE 'OTHER' END AS verb, count(*) AS n_rows FROM events GROUP BY ALL")
def verbs(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    operation = F.when(F.col("event_type") == "purchase", "post_uploads").when(F.col("event_type") == "signup", "List_Buckets").otherwise("Frob")
    return e.select("event_type", S.verb(F.lit("GET"), operation).alias("verb")).groupBy("event_type", "verb").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_rows FROM events GROUP BY ALL")
def times(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    iso = e.select("t", S.iso_time(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("back"))
    return iso.select(S.epoch_seconds("back").alias("seconds"), S.utc_day("t").cast("string").alias("day")).groupBy("seconds", "day").agg(F.count(F.lit(1)).alias("n_rows"))


