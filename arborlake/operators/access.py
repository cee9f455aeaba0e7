"""Access trees: requests per (path, day, verb), rolled up to every directory.

Keys hold the bucket, so equal paths in two buckets stay apart; ``parity=True`` leaves it out and merges
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def access_leaf(rows: DataFrame, parity: bool = False) -> DataFrame:
    """bucket, path, day, op, n_ops, bytes_out, bytes_in, n_requesters (exact), last_ts."""
    keys = ["path", "day", "op"] if parity else ["bucket", "path", "day", "op"]
    day = rows.withColumn("day", F.to_date("ts")).withColumn("path", F.coalesce("path", F.lit("")))
    return day.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ops"), F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_in").alias("bytes_in"), F.countDistinct("requester").alias("n_requesters"), F.max("ts").alias("last_ts"))


def access_tree(rows: DataFrame, parity: bool = False) -> DataFrame:
    """The leaves' sums at every ancestor-or-self: path, parent, depth, kind, day, op, n_ops, bytes, n_requesters.

    Requesters of a directory are the sum over its leaves, an upper bound; see :func:`access_tree_distinct`.
    A path that requests name is a file, the root and all others are directories.
    """
    leaf = access_leaf(rows, parity)
    group = [] if parity else ["bucket"]
    up = leaf.withColumn("__up", F.explode(P.ancestors("path", own=True)))
    tree = up.groupBy(*group, F.col("__up"), "day", "op").agg(*[F.sum(c).cast("long").alias(c) for c in ("n_ops", "bytes_out", "bytes_in", "n_requesters")], F.max("last_ts").alias("last_ts"), F.max((F.col("__up") == F.col("path")).cast("int")).alias("__own"))
    named = leaf.select(*group, F.col("path").alias("__up")).distinct().withColumn("__leaf", F.lit(True))
    tree = tree.join(named, [*group, "__up"], "left")
    kind = F.when(F.col("__up") == "", "dir").when(F.col("__leaf"), "file").otherwise("dir")
    parent = F.when(F.col("__up") == "", "").otherwise(P.named(P.parent_of("__up")))
    return tree.select(*group, P.named("__up").alias("path"), parent.alias("parent"), P.depth_of("__up").alias("depth"), kind.alias("kind"), "day", "op", "n_ops", "bytes_out", "bytes_in", "n_requesters", "last_ts")


def access_tree_distinct(rows: DataFrame, parity: bool = False) -> DataFrame:
    """path, day, op and ``n_requesters_hll``: distinct requesters at every level, by sketches merged upwards."""
    group = [] if parity else ["bucket"]
    day = rows.withColumn("day", F.to_date("ts")).withColumn("path", F.coalesce("path", F.lit("")))
    leaf = day.groupBy(*group, "path", "day", "op").agg(F.hll_sketch_agg(F.col("requester").cast("string"), F.lit(14)).alias("sketch"))
    up = leaf.withColumn("__up", F.explode(P.ancestors("path", own=True)))
    merged = up.groupBy(*group, F.col("__up"), "day", "op").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*group, P.named("__up").alias("path"), "day", "op", F.hll_sketch_estimate("sketch").alias("n_requesters_hll"))


def requester_sketches(rows: DataFrame) -> DataFrame:
    """bucket, path, depth, day, op, sketch: at every level a binary sketch of its requesters, to be stored beside the tree.

    Sketches are built once per leaf and merged upwards; days that come later are appended.
    """
    day = rows.withColumn("day", F.to_date("ts")).withColumn("path", F.coalesce("path", F.lit("")))
    leaf = day.groupBy("bucket", "path", "day", "op").agg(F.hll_sketch_agg(F.col("requester").cast("string"), F.lit(14)).alias("sketch"))
    up = leaf.select("bucket", F.explode(P.ancestors("path", own=True)).alias("dir"), "day", "op", "sketch")
    merged = up.groupBy("bucket", "dir", "day", "op").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("bucket", P.named("dir").alias("path"), P.depth_of("dir").alias("depth"), "day", "op", "sketch")


def merged_requesters(sketches: DataFrame, *by: str) -> DataFrame:
    """``by`` and ``n_requesters``: stored sketches merged over all that ``by`` leaves out, such as days, verbs or buckets."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_requesters"))


def access_summary(rows: DataFrame) -> DataFrame:
    """rows_in, n_paths, n_days, bytes_out."""
    return rows.agg(F.count(F.lit(1)).alias("rows_in"), F.countDistinct("bucket", F.coalesce("path", F.lit(""))).alias("n_paths"), F.countDistinct(F.to_date("ts")).alias("n_days"), F.coalesce(F.sum("bytes_out"), F.lit(0)).cast("long").alias("bytes_out"))


def hot_prefixes(tree: DataFrame, depth: int = 1, n: int = 20, op: str | None = None, by: str = "ops") -> DataFrame:
    """path, op, n_ops, bytes_out, n_requesters of the busiest paths of a depth, over all days."""
    rows = tree.where(F.col("depth") == depth)
    if op:
        rows = rows.where(F.col("op") == op)
    keys = [c for c in ("bucket",) if c in tree.columns]
    sums = rows.groupBy(*keys, "path", "op").agg(F.sum("n_ops").cast("long").alias("n_ops"), F.sum("bytes_out").cast("long").alias("bytes_out"), F.max("n_requesters").alias("n_requesters"))
    return sums.orderBy(F.col("n_ops" if by == "ops" else "bytes_out").desc(), "path", "op").limit(n)


def read_recency(rows: DataFrame, verbs: tuple[str, ...] = ("GET",)) -> DataFrame:
    """bucket, path, last_read at every level."""
    leaf = rows.where(F.col("op").isin(*verbs)).groupBy("bucket", F.coalesce("path", F.lit("")).alias("path")).agg(F.max("ts").alias("last_read"))
    up = leaf.select("bucket", F.explode(P.ancestors("path", own=True)).alias("path"), "last_read")
    return up.groupBy("bucket", P.named("path").alias("path")).agg(F.max("last_read").alias("last_read"))


def unread_score(sizes: DataFrame, recency: DataFrame, now: Column) -> DataFrame:
    """The size tree with ``last_read`` and ``unread_tb_years``; what was never read counts from its mean mtime."""
    from ..functions import scalars as S

    rows = sizes.join(recency, ["bucket", "path"], "left")
    since = F.coalesce(F.unix_seconds("last_read").cast("double"), F.col("mtime_mean"))
    return rows.withColumn("unread_tb_years", S.staleness("size", since, now))


def normalize_costs(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """period, service, sku, usage, cost: ``names`` maps these to a provider's columns."""
    return df.select(F.date_trunc("month", F.col(names["period"]).cast("timestamp")).cast("date").alias("period"), *[F.col(names[c]).cast("string").alias(c) for c in ("service", "sku")], *[F.col(names[c]).cast("double").alias(c) for c in ("usage", "cost")])


def cost_summary(costs: DataFrame) -> DataFrame:
    return costs.groupBy("period", "service", "sku").agg(F.sum("usage").alias("usage"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n_rows"))
