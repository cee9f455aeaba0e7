"""Streams of access rows: ingest without repeats, daily rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import paths as P

LATE = "2 hours"


def ingest(rows: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of access rows without repeated request ids. State is kept for ``late``; rows without an id all stay."""
    timed = rows.withWatermark("ts", late)
    once = timed.where("request_id is not null").dropDuplicatesWithinWatermark(["request_id"])
    return once.unionByName(timed.where("request_id is null"))


def daily_tree(rows: DataFrame, late: str = LATE) -> DataFrame:
    """bucket, path, day, op, n_ops, bytes_out, bytes_in at every level, for days that are complete.

    ``rows`` carries a watermark (see :func:`ingest`); later rows are dropped and counted by Spark.
    """
    up = rows.select("ts", "bucket", F.explode(P.ancestors(F.coalesce("path", F.lit("")), own=True)).alias("path"), "op", "bytes_out", "bytes_in")
    by = up.groupBy(F.window("ts", "1 day").alias("w"), "bucket", "path", "op").agg(F.count(F.lit(1)).alias("n_ops"), F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_in").alias("bytes_in"))
    return by.select("bucket", P.named("path").alias("path"), F.to_date("w.start").alias("day"), "op", "n_ops", "bytes_out", "bytes_in")


def run_daily_tree(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, late: str = LATE, parse=None) -> StreamingQuery:
    """Start the daily tree over Parquet files that arrive under ``source``; complete days are appended to ``target``."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    out = daily_tree(ingest(parse(raw) if parse else raw, late), late)
    return out.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()
