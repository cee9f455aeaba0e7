"""The inputs of the registered queries, derived from the given tables by Spark, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup as R
from ..steps import materialise

SCHEME = "gcs://b1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    # the orders are placed before the lines meet them, so that lines, which are the most, are dealt once
    order = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    order = order.join(t("nation").select("n_nationkey", "n_regionkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    order = order.join(t("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))


def objects(spark: SparkSession, sf_dir: str, bucket=None, unique: bool = True) -> DataFrame:
    """A listing of one object per order line, under region/nation/segment/order."""
    last = ["l_linenumber", "l_partkey", "l_suppkey"] if unique else ["l_linenumber"]
    name = F.concat(F.concat_ws("/", "r_name", "n_name", "c_mktsegment", F.col("o_orderkey").cast("string"), F.concat_ws("-", *[F.col(c).cast("string") for c in last])), F.lit(".bin"))
    tier = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 4).otherwise(0)
    return _joined(spark, sf_dir).select((F.lit("b1") if bucket is None else bucket).alias("bucket"), name.alias("name"), F.col("l_quantity").cast("long").alias("size_bytes"), F.col("l_shipdate").cast("timestamp").alias("created"), tier.alias("storage_class_id"))


def objects_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir, bucket=F.col("o_orderstatus"))


def snapshot(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return R.rollup_listing(objects(spark, sf_dir), SCHEME, **how)


def snapshot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and kind of the snapshot's rows."""
    return R.paths(R.listing_rows(objects(spark, sf_dir)))


def stored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot as a step, for what reads it several times or by depth: rolled up once, and filters reach its file."""
    return materialise(snapshot(spark, sf_dir), "snapshot")


def two_listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines shipped before 2000, and lines shipped from 1996 on with returned ones a byte larger."""
    rows = objects(spark, sf_dir)
    a = rows.where(F.col("created") < F.lit("2000-01-01").cast("timestamp"))
    b = rows.where(F.col("created") >= F.lit("1996-01-01").cast("timestamp"))
    return a, b.withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("storage_class_id") == 4, 1).otherwise(0))


def two_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = two_listings(spark, sf_dir)
    return R.rollup_listing(a, SCHEME), R.rollup_listing(b, SCHEME)


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event."""
    verbs = {"view": "GET", "purchase": "PUT", "signup": "LIST", "click": "HEAD", "error": "DELETE"}
    op = F.lit("OTHER")
    for k, v in verbs.items():
        op = F.when(F.col("event_type") == k, v).otherwise(op)
    path = F.concat(F.lit("u"), F.pmod("user_id", F.lit(10)).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit("/"), F.pmod("event_id", F.lit(50)).cast("string"))
    n = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("gcs").alias("store"), F.lit("b1").alias("bucket"), path.alias("path"), op.alias("op"), F.col("event_type").alias("op_raw"), F.lit(200).alias("status"), F.coalesce(n, F.lit(0)).cast("long").alias("bytes_out"), F.lit(0).cast("long").alias("bytes_in"), F.col("user_id").cast("string").alias("requester"), F.lit("").alias("user_agent"), F.col("event_id").cast("string").alias("request_id"))


def access_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests, a twentieth of them twice, and a hundredth without an id."""
    rows = access(spark, sf_dir).withColumn("k", F.col("request_id").cast("long"))
    both = rows.unionByName(rows.where("k % 20 = 0"))
    return both.withColumn("request_id", F.when(F.col("k") % 100 == 7, F.lit(None)).otherwise(F.col("request_id"))).drop("k")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan per market segment and month of order: its size is the number of orders."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    rows = o.groupBy("c_mktsegment", month.alias("time")).agg(F.count(F.lit(1)).alias("size"), F.countDistinct("o_custkey").alias("n_children"), F.max("o_orderkey").cast("long").alias("n_desc"))
    scan_id = (F.year("time") * 100 + F.month("time")) * 100 + F.ascii("c_mktsegment")
    return rows.select(scan_id.cast("long").alias("id"), F.concat(F.lit("gcs://b1/"), F.col("c_mktsegment")).alias("path"), "time", F.lit("").alias("blob"), F.lit(None).cast("int").alias("error_count"), F.lit(None).cast("string").alias("error_paths"), "size", "n_children", "n_desc", F.unix_seconds("time").alias("mtime"))


def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as objects: host and path of the URL."""
    url = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(F.lit("web").alias("bucket"), url.alias("name"), F.length("html").cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("created"), F.lit(0).alias("storage_class_id"))


def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"))
    return d.select(F.lit("docs").alias("bucket"), name.alias("name"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("created"), F.lit(0).alias("storage_class_id"))


# The same in SQL: each is a list of CTEs.

OBJECTS = """
lines AS (SELECT l.*, o_orderkey, o_orderstatus, c_mktsegment, n_name, r_name FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
objects AS (SELECT 'b1' AS bucket, r_name || '/' || n_name || '/' || c_mktsegment || '/' || o_orderkey || '/' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '.bin' AS name,
  CAST(l_quantity AS BIGINT) AS size, CAST(l_shipdate AS TIMESTAMP) AS created, o_orderstatus AS status,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 4 ELSE 0 END AS tier FROM lines)"""


def files(source: str = "objects", name: str = "files", where: str = "TRUE", size: str = "size") -> str:
    return f"""{name} AS (SELECT name AS path, CAST({size} AS BIGINT) AS size, coalesce(CAST(floor(epoch(created)) AS BIGINT), 0) AS mtime, tier,
  CASE WHEN contains(name, '/') THEN regexp_replace(name, '/[^/]*$', '') ELSE '' END AS parent FROM {source} WHERE {where})"""


def snap(name: str = "snap", src: str = "files", extra: str = "", root: str = SCHEME) -> str:
    """CTEs of a snapshot of ``src``. ``extra`` is further aggregates over its rows, for directories."""
    p = name
    more = f", {extra}" if extra else ""
    return f"""
{p}_up AS (SELECT f.*, unnest(list_transform(range(len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS dir FROM {src} f),
{p}_sum AS MATERIALIZED (SELECT dir, CAST(sum(size) AS BIGINT) AS size, max(mtime) AS mtime, count(*) AS n_files, count(*) FILTER (WHERE parent = dir) AS own{more} FROM {p}_up GROUP BY dir),
{p}_sub AS (SELECT dir AS sub, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END AS parent, unnest(list_transform(range(len(string_split(dir, '/'))), lambda i: array_to_string(string_split(dir, '/')[1:i], '/'))) AS dir FROM {p}_sum WHERE dir <> ''),
{p}_cnt AS (SELECT dir, count(*) AS n, count(*) FILTER (WHERE parent = dir) AS own FROM {p}_sub GROUP BY dir),
{p}_dirs AS (SELECT CASE WHEN s.dir = '' THEN '.' ELSE s.dir END AS path, s.size, s.mtime, 1 + s.n_files + coalesce(c.n, 0) AS n_desc, s.n_files, s.own + coalesce(c.own, 0) AS n_children, 'dir' AS kind,
  CASE WHEN s.dir = '' THEN '' WHEN contains(s.dir, '/') THEN regexp_replace(s.dir, '/[^/]*$', '') ELSE '.' END AS parent, s.* EXCLUDE (dir, size, mtime, n_files, own) FROM {p}_sum s LEFT JOIN {p}_cnt c ON s.dir = c.dir),
{p} AS MATERIALIZED (SELECT path, size, mtime, n_desc, n_files, n_children, kind, parent, CASE WHEN path = '.' THEN '{root}' ELSE '{root}/' || path END AS uri, CAST(CASE WHEN path = '.' THEN 0 ELSE length(path) - length(replace(path, '/', '')) + 1 END AS INT) AS depth FROM {p}_dirs
  UNION ALL SELECT path, size, mtime, 1, 1, 0, 'file', parent, '{root}/' || path, CAST(length(path) - length(replace(path, '/', '')) + 1 AS INT) FROM {src})"""


SNAPSHOT = f"{OBJECTS}, {files()}, {snap()}"
TWO = f"""{OBJECTS}, {files(name='fa', where="created < TIMESTAMP '2000-01-01'")}, {files(name='fb', where="created >= TIMESTAMP '1996-01-01'", size='size + CASE WHEN tier = 4 THEN 1 ELSE 0 END')}, {snap('sa', 'fa')}, {snap('sb', 'fb')}"""
ACCESS = """access AS (SELECT ts, 'b1' AS bucket, 'u' || (user_id % 10) || '/' || user_id || '/' || (event_id % 50) AS path,
  CASE event_type WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'PUT' WHEN 'signup' THEN 'LIST' WHEN 'click' THEN 'HEAD' WHEN 'error' THEN 'DELETE' ELSE 'OTHER' END AS op,
  coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS bytes_out, CAST(0 AS BIGINT) AS bytes_in, CAST(user_id AS VARCHAR) AS requester, event_id FROM events)"""
LEAF = f"""{ACCESS}, leaf AS (SELECT bucket, path, CAST(ts AS DATE) AS day, op, count(*) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, count(DISTINCT requester) AS n_requesters FROM access GROUP BY ALL)"""
TREE = f"""{LEAF}, up AS (SELECT l.*, unnest(list_append(list_transform(range(len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')), path)) AS dir FROM leaf l),
tree AS (SELECT bucket, CASE WHEN dir = '' THEN '.' ELSE dir END AS path, CASE WHEN dir = '' THEN '' WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '.' END AS parent,
  CAST(CASE WHEN dir = '' THEN 0 ELSE length(dir) - length(replace(dir, '/', '')) + 1 END AS INT) AS depth, CASE WHEN dir <> '' AND dir IN (SELECT path FROM leaf) THEN 'file' ELSE 'dir' END AS kind, day, op,
  CAST(sum(n_ops) AS BIGINT) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(n_requesters) AS BIGINT) AS n_requesters FROM up GROUP BY bucket, dir, day, op)"""
REGISTRY = """registry AS (SELECT CAST((year(t) * 100 + month(t)) * 100 + ascii(c_mktsegment) AS BIGINT) AS id, 'gcs://b1/' || c_mktsegment AS path, t AS time, n AS size, kids AS n_children, top AS n_desc, CAST(floor(epoch(t)) AS BIGINT) AS mtime FROM
  (SELECT c_mktsegment, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, count(*) AS n, count(DISTINCT o_custkey) AS kids, CAST(max(o_orderkey) AS BIGINT) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""
