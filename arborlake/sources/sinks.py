"""Sinks: sorted snapshots, access rows, access trees, snapshots split by top-level directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..steps import materialise

#: What a writer does with a target that exists. A target that was not written to its end is never reused.
MODES = {"error": "errorifexists", "reuse": "ignore", "clear": "overwrite"}
ROW_GROUP_BYTES = 32 * 1024 * 1024
ROW_GROUP_ROWS = 262_144
#: Rows that one task sorts and writes; a snapshot gets as many files as this asks for.
FILE_ROWS = 1_048_576
#: Snapshots are written once and read in part; paths take half the bytes in it.
CODEC = "zstd"


def complete(spark: SparkSession, path: str) -> bool:
    """Spark's marker of a write that came to its end stands in the folder."""
    return _stands(spark, f"{path}/_SUCCESS")


def _stands(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _mode(df: DataFrame, path: str, exists: str) -> str:
    return "overwrite" if exists == "reuse" and not complete(df.sparkSession, path) else MODES[exists]


def _computed(df: DataFrame, path: str, exists: str) -> DataFrame:
    """The rows as a step, since dealing them by range reads them twice. Where the target refuses or keeps what it has, none are computed."""
    kept = {"error": _stands, "reuse": complete}.get(exists)
    return df if kept and kept(df.sparkSession, path) else materialise(df, "to-write", CODEC)


def write_snapshot(df: DataFrame, path: str, partitions: int | None = None, exists: str = "error", row_group_rows: int = ROW_GROUP_ROWS, file_rows: int = FILE_ROWS, derived: dict[str, Column] | None = None) -> None:
    """A snapshot in global (depth, path) order, so that depth and prefix filters prune row groups; bounded by rows and bytes.

    At least ``partitions`` files, and more where one would hold over some ``file_rows`` rows: what a task sorts does not grow with the snapshot.
    ``derived``: columns that follow from the others; they are neither stored as a step nor dealt, but computed where the rows are written.
    """
    keys = [F.col("depth"), F.col("path"), F.col("kind")]
    narrow = df.drop(*derived) if derived else df
    rows = _computed(narrow, path, exists)
    ranged = rows.repartitionByRange(max(partitions or 1, -(-rows.count() // file_rows)), *keys) if rows is not narrow else narrow
    whole = ranged.sortWithinPartitions(*keys).withColumns(derived or {}).select(*df.columns)
    whole.write.mode(_mode(df, path, exists)).option("compression", CODEC).option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.block.row.count.limit", row_group_rows).parquet(path)


def write_manifest(spark: SparkSession, path: str) -> None:
    """``<path>.manifest``: file, n_rows, first and last (depth, path) of each file of a snapshot. It reads the two columns only."""
    at = F.struct("depth", "path")
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(at).alias("first"), F.max(at).alias("last"))
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}.manifest")


def slice_files(spark: SparkSession, path: str, under: str, least: int, most: int) -> list[str]:
    """The files that can hold rows of a subtree between two depths, by the manifest."""
    inner = under not in ("", P.ROOT)

    def meets(depth):
        low = F.struct(depth.alias("depth"), F.lit(under if inner else "").alias("path"))
        high = F.struct(depth.alias("depth"), F.lit(f"{under}0").alias("path")) if inner else F.struct((depth + 1).alias("depth"), F.lit("").alias("path"))
        return (F.col("first") < high) & (F.col("last") >= low)

    depths = F.sequence(F.lit(least), F.lit(most))
    return [r["file"] for r in spark.read.parquet(f"{path}.manifest").where(F.exists(depths, meets)).select("file").collect()]


def read_slice(spark: SparkSession, path: str, under: str = "", least: int = 0, most: int = 1_000) -> DataFrame:
    """The rows of a subtree between two depths. Files that cannot hold any are not opened, row groups are pruned in the others."""
    files = slice_files(spark, path, under, least, most)
    schema = spark.read.parquet(path).schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(P.in_depth("depth", least, most) & P.under("path", under))


def write_access_rows(df: DataFrame, path: str, exists: str = "error") -> None:
    """By day, a day's rows in few files, however many tasks read them; Spark's committer shows them once all are written."""
    df.withColumn("day", F.to_date("ts")).repartitionByRange("day", "ts").write.mode(_mode(df, path, exists)).partitionBy("day").parquet(path)


def write_access_tree(df: DataFrame, path: str, exists: str = "error") -> None:
    """By day, in (depth, path) order; a large day is shared out among tasks by ranges."""
    ranged = _computed(df, path, exists).repartitionByRange("day", "depth", "path")
    ranged.sortWithinPartitions("day", "depth", "path", "op").write.mode(_mode(df, path, exists)).partitionBy("day").parquet(path)


def write_chunked(df: DataFrame, path: str, threshold: int = 100_000, exists: str = "error") -> None:
    """Top-level directories with at least ``threshold`` descendants get a partition of their own, in (depth, path) order."""
    df = _computed(df, path, exists)
    large = df.where((F.col("depth") == 1) & (F.col("kind") == "dir") & (F.col("n_desc") >= threshold)).select(F.col("path").alias("chunk"))
    top = P.first_segment("path")
    rows = df.withColumn("__top", top).join(large.withColumn("__top", F.col("chunk")), "__top", "left").drop("__top")
    keys = ["chunk", "depth", "path"]
    ranged = rows.withColumn("chunk", F.coalesce("chunk", F.lit(P.ROOT))).repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode(_mode(df, path, exists)).partitionBy("chunk").parquet(path)


def read_chunked(spark: SparkSession, path: str, under: str | None = None) -> DataFrame:
    """The whole snapshot again; ``under`` reads the partitions that can hold the subtree, no others."""
    df = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(path)
    if under and under != P.ROOT:
        df = df.where(F.col("chunk").cast("string").isin(P.ROOT, under.split("/")[0]))
    return df.drop("chunk")


def write_dated(df: DataFrame, path: str, bucket: str, date: str) -> None:
    """Put one bucket's snapshot of one date; writing it again replaces that partition and no other."""
    rows = df.withColumn("bucket", F.lit(bucket)).withColumn("snapshot_date", F.lit(date).cast("date"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "snapshot_date").parquet(path)
