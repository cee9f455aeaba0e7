"""Provider access logs as one table of requests:
ts, store, bucket, path, op, op_raw, status, bytes_out, bytes_in, requester, user_agent, request_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

COLUMNS = ["ts", "store", "bucket", "path", "op", "op_raw", "status", "bytes_out", "bytes_in", "requester", "user_agent", "request_id"]
#: Columns of the GCS usage log.
GCS_COLUMNS = ["time_micros", "c_ip", "c_ip_type", "c_ip_region", "cs_method", "cs_uri", "sc_status", "cs_bytes", "sc_bytes", "time_taken_micros", "cs_host", "cs_referer", "cs_user_agent", "s_request_id", "cs_operation", "cs_bucket", "cs_object"]


def dedupe(rows: DataFrame, strict_parity: bool = False) -> DataFrame:
    """One row per request id. Rows without one all stay, unless ``strict_parity`` leaves one of them."""
    if strict_parity:
        return rows.dropDuplicates(["request_id"])
    return rows.where("request_id is not null").dropDuplicates(["request_id"]).unionByName(rows.where("request_id is null"))


def between(rows: DataFrame, since=None, until=None) -> DataFrame:
    """Rows with since <= ts < until."""
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return rows.where(F.col("ts") < F.lit(until).cast("timestamp")) if until is not None else rows


def from_gcs(raw: DataFrame, store: str = "gcs") -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0).cast("long"))
    rows = raw.where("cs_bucket is not null").select(
        F.timestamp_micros(F.expr("try_cast(time_micros as bigint)")).alias("ts"), F.lit(store).alias("store"), F.col("cs_bucket").alias("bucket"), text("cs_object").alias("path"),
        S.verb(text("cs_method"), "cs_operation").alias("op"), F.coalesce("cs_operation", "cs_method", F.lit("")).alias("op_raw"), F.expr("try_cast(sc_status as int)").alias("status"),
        number("sc_bytes").alias("bytes_out"), number("cs_bytes").alias("bytes_in"), text("c_ip").alias("requester"), text("cs_user_agent").alias("user_agent"), F.col("s_request_id").alias("request_id"),
    )
    return dedupe(rows)


def parse_gcs(spark: SparkSession, path, store: str = "gcs") -> DataFrame:
    """GCS usage CSV files, matched by header name; a column that a file lacks is null."""
    raw = spark.read.option("header", True).csv(path)
    for c in GCS_COLUMNS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return from_gcs(raw, store)


def parse_storage_daily(spark: SparkSession, path) -> DataFrame:
    """The daily storage CSV as it is."""
    return spark.read.option("header", True).csv(path)


#: Fixed value: the start of an S3 server access log line, as the public log format documents it.
S3_LINE = r'^(\S+) (\S+) \[([^\]]+)\] (\S+) (\S+) (\S+) (\S+) (\S+) ("[^"]*"|-) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) ("[^"]*"|-) ("[^"]*"|-)'


def from_s3_lines(lines: DataFrame, store: str = "s3") -> DataFrame:
    """S3 server access log lines in column ``value``; lines of another form are left out."""
    def field(k: int):
        c = F.regexp_extract("value", S3_LINE, k)
        return F.when(c == "-", F.lit(None)).otherwise(F.regexp_replace(c, '^"|"$', ""))

    raw = field(7)  # REST.GET.OBJECT
    listing = raw.rlike(r"^REST\.GET\.BUCKET") | (F.regexp_extract("value", S3_LINE, 9).contains("list-type="))
    op = F.when(listing, "LIST").otherwise(S.verb(F.coalesce(F.split(raw, r"\.")[1], raw)))
    rows = lines.where(F.col("value").rlike(S3_LINE)).select(
        F.try_to_timestamp(field(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"), F.lit(store).alias("store"), field(2).alias("bucket"), F.coalesce(field(8), F.lit("")).alias("path"),
        op.alias("op"), raw.alias("op_raw"), field(10).cast("int").alias("status"), F.coalesce(field(12).cast("long"), F.lit(0)).alias("bytes_out"),
        F.when(op == "PUT", F.coalesce(field(13).cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long").alias("bytes_in"),
        F.coalesce(field(5), field(4), F.lit("")).alias("requester"), F.coalesce(field(17), F.lit("")).alias("user_agent"), field(6).alias("request_id"),
    )
    return dedupe(rows.where("bucket is not null"))


def parse_s3(spark: SparkSession, path, store: str = "s3") -> DataFrame:
    return from_s3_lines(spark.read.text(path), store)


R2_SCHEMA = "EdgeStartTimestamp string, BucketName string, ClientRequestHost string, ClientRequestURI string, ObjectKey string, ClientRequestMethod string, Operation string, EdgeResponseStatus int, EdgeResponseBytes long, ClientRequestBytes long, ClientIP string, ClientRequestUserAgent string, RayID string"


def from_r2(raw: DataFrame, store: str = "r2") -> DataFrame:
    """R2 Logpush rows, of HTTP requests before a bucket or of the bucket's own operations."""
    uri = F.regexp_replace(F.split(F.coalesce("ClientRequestURI", F.lit("")), r"\?")[0], "^/", "")
    rows = raw.select(
        S.iso_time("EdgeStartTimestamp").alias("ts"), F.lit(store).alias("store"), F.coalesce("BucketName", "ClientRequestHost").alias("bucket"), F.coalesce("ObjectKey", uri).alias("path"),
        S.verb(F.coalesce("ClientRequestMethod", F.lit("")), "Operation").alias("op"), F.coalesce("Operation", "ClientRequestMethod", F.lit("")).alias("op_raw"), F.col("EdgeResponseStatus").alias("status"),
        F.coalesce("EdgeResponseBytes", F.lit(0).cast("long")).alias("bytes_out"), F.coalesce("ClientRequestBytes", F.lit(0).cast("long")).alias("bytes_in"),
        F.coalesce("ClientIP", F.lit("")).alias("requester"), F.coalesce("ClientRequestUserAgent", F.lit("")).alias("user_agent"), F.col("RayID").alias("request_id"),
    )
    return dedupe(rows.where("bucket is not null"))


def parse_r2(spark: SparkSession, path, store: str = "r2") -> DataFrame:
    return from_r2(spark.read.schema(R2_SCHEMA).json(path), store)


PARSERS: dict[str, Callable[..., DataFrame]] = {"gcs": parse_gcs, "s3": parse_s3, "r2": parse_r2}


def register_parser(store: str, parse: Callable[..., DataFrame]) -> None:
    """Add a provider: ``parse(spark, path, store)`` returns access rows."""
    PARSERS[store] = parse


def parser_for(store: str) -> Callable[..., DataFrame]:
    if store not in PARSERS:
        raise ValueError(f"unknown store {store!r}; known: {sorted(PARSERS)}")
    return PARSERS[store]
