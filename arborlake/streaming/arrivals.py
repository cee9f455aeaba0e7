"""Access rows as they arrive: rows kept once, late rows put aside, and the counts of both for every batch.

Spark's watermark drops late rows inside its operators and counts them after a partial aggregation. Where each row must be
accounted for, batches are written here under one folder:

- ``rows/batch=<k>``: what is kept, in order of ``ts``, so that a filter on times prunes row groups;
- ``late/batch=<k>``: rows older than the watermark, whole;
- ``counts/batch=<k>``: n_rows, n_kept, n_late, n_repeated and the newest ``ts``.

The watermark of a batch is the newest ``ts`` of the batches before it less ``late``. A row is repeated if its request id is already kept,
in this batch or at a time not before the watermark in an earlier one. One of them stays. Rows without an id are never repeated; rows
without a ``ts`` are never late, and compared inside their batch only. A batch that runs again writes the same again, from the batches before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..steps import discard, materialise

COUNTS = "batch long, n_rows long, n_kept long, n_late long, n_repeated long, newest timestamp"


def create(spark: SparkSession, folder: str, schema: StructType) -> None:
    none = spark.createDataFrame([], schema)
    for kind in ("rows", "late"):
        none.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{kind}/batch=-1")
    spark.createDataFrame([], COUNTS).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch=-1")


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """batch, n_rows, n_kept, n_late, n_repeated, newest of every batch."""
    return spark.read.schema(COUNTS).parquet(f"{folder}/counts")


def kept(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The kept rows of all batches, with their batch."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")


def watermark(spark: SparkSession, folder: str, before: int, late: str):
    """Microseconds since 1970 of the newest time before a batch less ``late``; None before the first."""
    newest = counts(spark, folder).where(F.col("batch") < before).agg(F.max("newest").alias("t"))
    return newest.select(F.unix_micros(F.expr(f"t - interval {late}"))).first()[0]


def add_batch(batch: DataFrame, number: int, folder: str, late: str = "2 hours") -> None:
    spark, names = batch.sparkSession, batch.columns
    mark = watermark(spark, folder, number, late)
    rows = materialise(batch, "arrived")
    is_late = F.lit(False) if mark is None else F.coalesce(F.col("ts") < F.timestamp_micros(F.lit(mark)), F.lit(False))
    timely = rows.where(~is_late)
    seen = kept(spark, folder, batch.schema).where(F.col("batch") < number)
    if mark is not None:
        seen = seen.where(F.col("ts") >= F.timestamp_micros(F.lit(mark)))
    once = timely.where("request_id is not null").dropDuplicates(["request_id"])
    once = once.join(seen.where("request_id is not null").select("request_id").distinct(), "request_id", "left_anti")
    new = once.select(*names).unionByName(timely.where("request_id is null"))
    new.repartitionByRange("ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    rows.where(is_late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
    of = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(is_late).alias("n_late"), F.max("ts").alias("newest"))
    n_kept = spark.read.schema(batch.schema).parquet(f"{folder}/rows/batch={number}").count()
    out = of.withColumn("n_kept", F.lit(n_kept).cast("long")).select("n_rows", "n_kept", "n_late", (F.col("n_rows") - F.col("n_kept") - F.col("n_late")).alias("n_repeated"), "newest")
    out.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
    discard(rows)


def run_arrivals(spark: SparkSession, source: str, schema: StructType, folder: str, checkpoint: str, late: str = "2 hours", parse=None) -> StreamingQuery:
    """Take what has arrived under ``source`` since the last run, as one batch; ``parse`` turns raw rows into access rows."""
    raw = spark.readStream.schema(schema).parquet(source)
    rows = parse(raw) if parse else raw
    return rows.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, folder, late)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
