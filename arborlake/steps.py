"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Where that is unset a local session gets a
    temporary folder; a cluster session must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and executors share")
    folder = tempfile.mkdtemp(prefix="arborlake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/arborlake/{name}-{uuid.uuid4().hex}"


#: Steps as large as the table, whose bytes count for more than their time; unless told otherwise they are written with zstd.
PACKED = frozenset({"diff-rows", "diff-shown", "listing", "batch-directories", "merged-directories"})


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a step to the shared folder as Parquet and read it back.

    This cuts the lineage: a lost executor costs the unfinished step, not the steps before it, and
    what reads the step several times plans and computes it once.
    """
    path = new_path(df.sparkSession, name)
    codec = codec or ("zstd" if name in PACKED else None)
    df.write.options(**({"compression": codec} if codec else {})).parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step.step_path = path
    return step


def dealt_step(df: DataFrame, key: str, name: str) -> DataFrame:
    """:func:`materialise`, dealt by ``key`` into as many buckets as a shuffle has partitions, so that joins on it do not move these rows again.

    Buckets are known to the catalog only, which forgets the table at once; the files stay, as those of other steps.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"arborlake_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    step = spark.table(table)
    step.step_path = path
    spark.sql(f"DROP TABLE {table}")
    return step


def discard(*steps: DataFrame) -> None:
    """Empty steps of :func:`materialise` that nothing reads any more; what was made of them must be written by now."""
    for step in steps:
        step.sparkSession.createDataFrame([], step.schema).coalesce(1).write.mode("overwrite").parquet(step.step_path)
