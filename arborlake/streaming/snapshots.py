"""Snapshots that grow by batches: a base, deltas of what each batch touched, merged when read.

Under one folder stand

- ``base/upto=<n>``: a whole snapshot of all batches up to n;
- ``delta/batch=<k>``: of batch k its files, and for each directory above one of them what the batch adds to it;
- ``commits/upto=<n>``: written after a base is complete; readers take the largest.

Everything in a delta is a sum or a maximum, also ``n_desc`` and ``n_children``: a batch looks up which of the directories that it
touches are new, and only these count. So a snapshot is the base and the later deltas, added up by path, a filter on paths reaches every
file, and the bytes written for a batch follow the batch. Every ``compact_every`` deltas a new base is written and what it
covers is emptied.

A batch that runs again writes the same delta again, from the state before it; one that a base covers is passed over. A restart
therefore changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import paths as P
from ..operators import rollup as R
from ..steps import materialise

_SUMS = ["size", "n_desc", "n_files", "n_children"]
SCHEMA = "path string, size long, mtime long, n_desc long, n_files long, n_children long, kind string"
_KEYS = ["depth", "path", "kind"]


def create(spark: SparkSession, folder: str) -> None:
    """An empty snapshot: a root without files."""
    none = R.rollup(spark.createDataFrame([], "path string, size long, mtime long, kind string"), "")
    _write(none.select(*_names()), f"{folder}/base/upto=-1")
    _write(none.limit(0).select(*_names()), f"{folder}/delta/batch=-1")
    _commit(spark, folder, -1)


def _names() -> list[str]:
    return [c.split()[0] for c in SCHEMA.split(", ")]


def _write(df: DataFrame, path: str) -> None:
    """In (depth, path) order, so that depth and prefix filters prune row groups. Dealing by range reads the rows twice: they stand in files, and what is computed is a step."""
    rows = df.withColumn("depth", P.depth_of("path"))
    rows.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS).drop("depth").write.mode("overwrite").option("compression", "zstd").parquet(path)


def _commit(spark: SparkSession, folder: str, upto: int) -> None:
    spark.range(1).select(F.lit(upto).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/upto={upto}")


def covered(spark: SparkSession, folder: str) -> int:
    """The last batch that the newest complete base holds; -1 for none."""
    return spark.read.schema("batch long").parquet(f"{folder}/commits").agg(F.max("batch")).first()[0]


def _layers(spark: SparkSession, folder: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The base, and the deltas that it does not cover (those before a batch, if that is given)."""
    upto = covered(spark, folder)
    deltas = spark.read.schema(f"{SCHEMA}, batch long").parquet(f"{folder}/delta").where(F.col("batch") > upto)
    if before is not None:
        deltas = deltas.where(F.col("batch") < before)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/base/upto={upto}"), deltas


def _merged_dirs(layers: DataFrame) -> DataFrame:
    dirs = layers.where("kind = 'dir'").groupBy("path", "kind").agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("mtime").alias("mtime"))
    return dirs.select(*_names())


def _files(layers: DataFrame) -> DataFrame:
    return layers.where("kind = 'file'").select(*_names())


def read_snapshot(spark: SparkSession, folder: str, scan_root: str = "") -> DataFrame:
    """The snapshot as of the last batch, in the columns of a rollup."""
    base, deltas = _layers(spark, folder)
    layers = base.unionByName(deltas.drop("batch"))
    rows = _merged_dirs(layers).unionByName(_files(layers))
    parent = F.when(F.col("kind") == "dir", P.dir_parent(P.bare("path"))).otherwise(P.parent_of("path"))
    return rows.select(*_names(), parent.alias("parent"), P.uri_of(scan_root, "path").alias("uri"), P.depth_of("path").alias("depth"))


def delta_of(listing: DataFrame, known: DataFrame) -> DataFrame:
    """What a listing adds to a snapshot whose directories are ``known`` (path): its files, and sums for each directory above them."""
    part = R.rollup_listing(listing, "")
    dirs = part.where("kind = 'dir'").select(P.bare("path").alias("dir"), "size", "mtime", "n_files", "n_children")
    held = known.select(P.bare("path").alias("dir")).distinct().withColumn("held", F.lit(True))
    dirs = materialise(dirs.join(held, "dir", "left").withColumn("is_new", F.col("held").isNull()).drop("held"), "batch-directories")
    below = dirs.where("dir <> ''").select(F.col("dir").alias("sub"), "is_new", F.explode(P.ancestors("dir")).alias("dir"))
    own, new = P.parent_of("sub") == F.col("dir"), F.col("is_new")
    # a step, since only what has directories below it is there, and its size tells how to join it
    below = materialise(below.groupBy("dir").agg(F.count_if(new).alias("n_new"), F.count_if(own).alias("own_sub"), F.count_if(own & new).alias("own_new")), "batch-parents")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    n_desc, n_children = F.col("n_files") + zero("n_new") + F.col("is_new").cast("long"), F.col("n_children") - zero("own_sub") + zero("own_new")
    added = dirs.join(below, "dir", "left").select(P.named("dir").alias("path"), "size", "mtime", n_desc.alias("n_desc"), "n_files", n_children.alias("n_children"), F.lit("dir").alias("kind"))
    return added.unionByName(_files(part))


def add_batch(listing: DataFrame, number: int, folder: str, compact_every: int = 8) -> None:
    """Take a batch of a listing into the snapshot. The same number again leaves the same snapshot."""
    spark = listing.sparkSession
    if number <= covered(spark, folder):
        return
    base, deltas = _layers(spark, folder, before=number)
    known = base.where("kind = 'dir'").select("path").unionByName(deltas.where("kind = 'dir'").select("path"))
    _write(delta_of(listing, known), f"{folder}/delta/batch={number}")
    if (number + 1) % compact_every == 0:
        compact(spark, folder, number)


def compact(spark: SparkSession, folder: str, upto: int) -> None:
    """Write the snapshot of all batches up to ``upto`` as a base, then empty the base and the deltas that it covers."""
    old, (base, deltas) = covered(spark, folder), _layers(spark, folder, before=upto + 1)
    held = [r[0] for r in deltas.select("batch").distinct().collect()]  # at most compact_every numbers
    layers = base.unionByName(deltas.drop("batch"))
    _write(materialise(_merged_dirs(layers), "merged-directories").unionByName(_files(layers)), f"{folder}/base/upto={upto}")
    _commit(spark, folder, upto)
    empty = spark.createDataFrame([], SCHEMA).coalesce(1)
    for path in [f"base/upto={old}", *[f"delta/batch={k}" for k in held]]:
        empty.write.mode("overwrite").parquet(f"{folder}/{path}")


def run_snapshot_merge(spark: SparkSession, source: str, schema: StructType, folder: str, checkpoint: str, compact_every: int = 8, files: int | None = 1) -> StreamingQuery:
    """Start taking the listing files that arrive under ``source`` into the snapshot under ``folder``, ``files`` a batch (None: all that stand there)."""
    stream = spark.readStream.schema(schema)
    arrived = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(source)
    return arrived.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, folder, compact_every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
