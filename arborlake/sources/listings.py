"""Object listings, inventories and walk dumps as one layer-1 table:
bucket, name, size_bytes, created, storage_class_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import scalars as S

LAYER1 = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("name", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("created", T.TimestampType()), T.StructField("storage_class_id", T.IntegerType())])
COLUMNS = LAYER1.fieldNames()


def from_raw(df: DataFrame) -> DataFrame:
    """bucket, name, size_bytes, perhaps created and storage_class_id."""
    created = F.col("created").cast("timestamp") if "created" in df.columns else F.lit(None).cast("timestamp")
    tier = F.coalesce(F.col("storage_class_id").cast("int"), F.lit(0)) if "storage_class_id" in df.columns else F.lit(0)
    return df.select("bucket", "name", F.col("size_bytes").cast("long").alias("size_bytes"), created.alias("created"), tier.alias("storage_class_id"))


def from_gcs_inventory(df: DataFrame) -> DataFrame:
    """GCS Storage Insights rows; soft-deleted objects are left out."""
    if "timeDeleted" in df.columns:
        df = df.where(F.col("timeDeleted").isNull())
    tier = S.tier("storageClass", S.GCS_TIERS) if "storageClass" in df.columns else F.lit(0)
    return df.select("bucket", "name", F.col("size").cast("long").alias("size_bytes"), F.col("timeCreated").cast("timestamp").alias("created"), tier.alias("storage_class_id"))


def from_s3_inventory(df: DataFrame) -> DataFrame:
    """S3 Inventory rows; delete markers and old versions are left out, a null flag keeps the row."""
    if "IsDeleteMarker" in df.columns:
        df = df.where(~F.coalesce(F.col("IsDeleteMarker").cast("boolean"), F.lit(False)))
    if "IsLatest" in df.columns:
        df = df.where(F.coalesce(F.col("IsLatest").cast("boolean"), F.lit(True)))
    created = F.col("LastModifiedDate").cast("timestamp") if "LastModifiedDate" in df.columns else F.lit(None).cast("timestamp")
    tier = S.tier("StorageClass", S.S3_TIERS) if "StorageClass" in df.columns else F.lit(0)
    return df.select(F.col("Bucket").alias("bucket"), F.col("Key").alias("name"), F.col("Size").cast("long").alias("size_bytes"), created.alias("created"), tier.alias("storage_class_id"))


def normalize_listing(df: DataFrame) -> DataFrame:
    """Tell the schema by its columns; an unknown one is an error that names them."""
    have = set(df.columns)
    if {"bucket", "name", "size_bytes"} <= have:
        return from_raw(df)
    if {"bucket", "name", "size", "timeCreated"} <= have:
        return from_gcs_inventory(df)
    if {"Bucket", "Key", "Size"} <= have:
        return from_s3_inventory(df)
    raise ValueError(f"not a listing: {sorted(have)}")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return normalize_listing(spark.read.parquet(path))


def merge_listings(listings: list[DataFrame]) -> DataFrame:
    """All listings as one; for a bucket in several, only the first one's rows. Null buckets are dropped."""
    tagged = [normalize_listing(df).where("bucket is not null").withColumn("__prio", F.lit(i)) for i, df in enumerate(listings)]
    rows = reduce(DataFrame.unionByName, tagged)
    first = rows.groupBy("bucket").agg(F.min("__prio").alias("__prio"))
    return rows.join(first, ["bucket", "__prio"], "left_semi").drop("__prio")


def list_buckets(df: DataFrame) -> DataFrame:
    return df.select("bucket").where("bucket is not null").distinct().orderBy("bucket")


def of_bucket(df: DataFrame, bucket: str) -> DataFrame:
    """One bucket's rows; an absent bucket is an error."""
    rows = df.where(F.col("bucket") == bucket)
    if not rows.head(1):
        raise ValueError(f"no rows for bucket {bucket!r}")
    return rows


def parse_walk(lines: DataFrame, root: str, uri: str) -> DataFrame:
    """NUL-separated records ``kind blocks mtime path`` in column ``value`` as layer-2 input rows.

    Records outside ``root`` or malformed are left out; mtimes lose their fraction.
    """
    top = root.rstrip("/")
    f = F.split("value", " ", 4)
    rows = lines.where(F.size(f) == 4).select(F.get(f, F.lit(0)).alias("kind"), F.expr("try_cast(get(split(value, ' ', 4), 1) as bigint)").alias("blocks"), F.floor(F.expr("try_cast(get(split(value, ' ', 4), 2) as double)")).cast("long").alias("mtime"), F.get(f, F.lit(3)).alias("full"))
    rows = rows.where(P.under("full", top) if top else F.lit(True)).where("blocks is not null and mtime is not null")
    path = F.when(F.col("full") == top, "").otherwise(F.substr("full", F.lit(len(top) + 2)))
    kind = F.when(F.col("kind") == "f", "file").when(F.col("kind") == "d", "dir").otherwise(F.col("kind"))
    rows = rows.select(path.alias("path"), S.blocks_to_bytes("blocks").alias("size"), "mtime", kind.alias("kind"))
    return rows.withColumn("parent", F.when(F.col("path") == "", F.lit(None)).otherwise(P.parent_of("path"))).withColumn("uri", P.uri_of(uri, "path"))


def parse_recursive_listing(lines: DataFrame, bucket_uri: str, prefix: str = "") -> DataFrame:
    """Lines ``date time size key`` in column ``value`` as file rows and a row for each directory above them."""
    r = r"^(\S+)\s+(\S+)\s+(\d+)\s+(.*)$"
    v = F.col("value")
    rows = lines.where(v.rlike(r)).select(F.concat_ws(" ", F.regexp_extract(v, r, 1), F.regexp_extract(v, r, 2)).alias("at"), F.regexp_extract(v, r, 3).cast("long").alias("size"), F.regexp_extract(v, r, 4).alias("key"))
    base = bucket_uri
    if prefix:
        stray = rows.where(~P.under("key", prefix))
        if stray.head(1):
            raise ValueError(f"a key is outside {prefix!r}")
        rows = rows.where(F.col("key") != prefix).withColumn("path", F.substr("key", F.lit(len(prefix) + 2)))
        base = f"{bucket_uri}/{prefix}"
    else:
        rows = rows.withColumn("path", F.col("key"))
    files = rows.select("path", "size", F.unix_seconds(F.to_timestamp("at")).alias("mtime"), F.lit("file").alias("kind"), P.parent_of("path").alias("parent"), P.uri_of(base, "path").alias("uri"))
    dirs = files.select(F.explode(P.ancestors("path")).alias("path")).distinct()
    dirs = dirs.select("path", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit("dir").alias("kind"), F.when(F.col("path") == "", F.lit(None)).otherwise(P.parent_of("path")).alias("parent"), P.uri_of(base, "path").alias("uri"))
    return files.unionByName(dirs)


def walk_errors(lines: DataFrame, keep: int = 100) -> DataFrame:
    """n_errors and the first ``keep`` paths of ``find: 'path': Permission denied`` lines, by path."""
    r = "^[^:]*find: [‘'`]?(.*?)[’']?: Permission denied$"
    denied = lines.where(F.col("value").rlike(r)).select(F.regexp_extract("value", r, 1).alias("path"))
    first = denied.orderBy("path").limit(keep).agg(F.sort_array(F.collect_list("path")).alias("error_paths"))
    return first.select(F.lit(denied.count()).cast("long").alias("n_errors"), "error_paths")
