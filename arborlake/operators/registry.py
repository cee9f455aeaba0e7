"""The registry of snapshots: id, path, time, blob, error_count, error_paths, size, n_children, n_desc, mtime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from . import rollup as R

STATS = ["size", "n_children", "n_desc", "mtime"]


def register(snapshot: DataFrame, scan_id: int, path: str, time: str, blob: str, errors: list[str] | None = None) -> DataFrame:
    """The registry row of a snapshot, with its root's statistics; append it to the registry table."""
    root = R.root_stats(snapshot)
    listed = F.to_json(F.array(*[F.lit(e) for e in errors])) if errors else F.lit(None).cast("string")
    return root.select(F.lit(scan_id).cast("long").alias("id"), F.lit(path).alias("path"), F.lit(time).cast("timestamp").alias("time"), F.lit(blob).alias("blob"), F.lit(len(errors) if errors else None).cast("int").alias("error_count"), listed.alias("error_paths"), *STATS)


def error_list(registry: DataFrame) -> DataFrame:
    """id and each path that its scan could not read."""
    return registry.select("id", F.explode(F.from_json("error_paths", "array<string>")).alias("error_path"))


def latest_per_path(registry: DataFrame) -> DataFrame:
    """The newest scan of each path, newest first; of scans of one time the one with the larger id."""
    cols = [c for c in registry.columns if c != "path"]
    best = registry.groupBy("path").agg(F.max_by(F.struct(*cols), F.struct("time", "id")).alias("__r"))
    return best.select("path", *[F.col(f"__r.{c}").alias(c) for c in cols]).orderBy(F.col("time").desc(), "path")


def uri_ancestors(uri: str) -> list[str]:
    """The URI and all above it; a local path's end at ``/``, a store's at its bucket."""
    head, sep, rest = uri.partition("://")
    lead = f"{head}{sep}" if sep else "/"
    parts = [p for p in (rest if sep else uri).split("/") if p]
    out = [lead + "/".join(parts[:k]) for k in range(len(parts), 0, -1)]
    return out if sep else [*out, "/"]


def covering(registry: DataFrame, uri: str) -> DataFrame:
    return registry.where(F.col("path").isin(uri_ancestors(uri)))


def freshest_covering(registry: DataFrame, uri: str, scan_id: int | None = None) -> DataFrame:
    """The newest scan of the URI or of an ancestor; a given id is checked to cover it."""
    rows = covering(registry, uri)
    if scan_id is not None:
        rows = rows.where(F.col("id") == scan_id)
        if not rows.head(1):
            raise ValueError(f"scan {scan_id} does not cover {uri}")
    return rows.orderBy(F.col("time").desc(), F.col("id").desc()).limit(1)


def _inside(uri: str) -> Column:
    """The URI's path inside a scan of ``path``."""
    own = F.when(F.col("path") == "/", F.lit(uri.lstrip("/"))).otherwise(F.substr(F.lit(uri), F.length("path") + 2))
    return F.when(F.col("path") == uri, P.ROOT).otherwise(own)


def history(registry: DataFrame, snapshots: DataFrame, uri: str) -> DataFrame:
    """id, scan_path, time and the URI's statistics in its own scans and inside its ancestors' scans.

    ``snapshots`` is the rows of all scans, with ``scan_id``; scans that do not hold the URI are left out.
    """
    scans = covering(registry, uri).withColumn("rel", _inside(uri))
    rows = snapshots.select("scan_id", F.col("path").alias("rel"), *[F.col(c).alias(f"in_{c}") for c in STATS])
    met = scans.join(rows, (scans["id"] == rows["scan_id"]) & (scans["rel"] == rows["rel"]), "left").drop(rows["rel"])
    own = F.col("path") == uri
    kept = met.where(own | F.col("scan_id").isNotNull())
    return kept.select("id", F.col("path").alias("scan_path"), "time", *[F.when(own, F.col(c)).otherwise(F.col(f"in_{c}")).alias(c) for c in STATS])


def freshest_holding(registry: DataFrame, snapshots: DataFrame, uri: str) -> DataFrame:
    """As :func:`freshest_covering`, but a scan that does not hold the URI falls through to the next."""
    return history(registry, snapshots, uri).orderBy(F.col("time").desc(), F.col("id").desc()).limit(1)


def series(registry: DataFrame, uri: str | None = None, limit: int | None = None, with_ancestors: bool = False) -> DataFrame:
    """Scans newest first, with the change of size since the scan before of the same path."""
    rows = registry if uri is None else covering(registry, uri) if with_ancestors else registry.where(F.col("path") == uri)
    w = Window.partitionBy("path").orderBy("time", "id")
    rows = rows.select("id", "path", "time", "size", (F.col("size") - F.lag("size").over(w)).alias("size_delta"))
    rows = rows.orderBy(F.col("time").desc(), F.col("id").desc())
    return rows.limit(limit) if limit is not None else rows


def latest_two(registry: DataFrame) -> DataFrame:
    """path, id_a, id_b: the scan before the newest and the newest, of paths that have both."""
    w = Window.partitionBy("path").orderBy(F.col("time").desc(), F.col("id").desc())
    rows = registry.select("path", "id", F.row_number().over(w).alias("k")).where("k <= 2")
    return rows.groupBy("path").agg(F.max(F.when(F.col("k") == 2, F.col("id"))).alias("id_a"), F.max(F.when(F.col("k") == 1, F.col("id"))).alias("id_b")).where("id_a is not null")


def expire(registry: DataFrame, path: str, cutoff: str) -> DataFrame:
    """The registry without the scans of a path that are older than the cutoff."""
    return registry.where(~((F.col("path") == path) & (F.col("time") < F.lit(cutoff).cast("timestamp"))))


def expired(registry: DataFrame, path: str, cutoff: str) -> DataFrame:
    """What :func:`expire` drops; its blobs are to be deleted."""
    return registry.where((F.col("path") == path) & (F.col("time") < F.lit(cutoff).cast("timestamp")))


def bucket_of(path) -> Column:
    """``scheme://bucket`` of a store URL."""
    return F.regexp_extract(P._col(path), "^([a-z0-9]+://[^/]+)", 1)


def roll_call(buckets: DataFrame, registry: DataFrame, scheme: str) -> DataFrame:
    """bucket, uri and the newest scan at or under each bucket (null without one)."""
    scans = registry.withColumn("uri", bucket_of("path")).where("uri <> ''").groupBy("uri").agg(F.max("time").alias("last_scan"), F.max_by("path", F.struct("time", "id")).alias("scan_path"), F.count(F.lit(1)).alias("n_scans"))
    named = buckets.select("bucket", F.concat(F.lit(f"{scheme}://"), F.col("bucket")).alias("uri"))
    return named.join(scans, "uri", "left").select("bucket", "uri", "last_scan", "scan_path", F.coalesce("n_scans", F.lit(0)).alias("n_scans"))


def store_stats(snapshots: DataFrame) -> DataFrame:
    """n_scans, n_rows and the bytes of all scans' roots."""
    return snapshots.agg(F.countDistinct("scan_id").alias("n_scans"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("path") == P.ROOT, F.col("size"))), F.lit(0)).cast("long").alias("total_size"))


def large_subtrees(snapshot: DataFrame, threshold: int) -> DataFrame:
    """path, size, n_desc of the top-level directories that get a partition of their own."""
    return snapshot.where((P.depth_of("path") == 1) & (F.col("kind") == "dir") & (F.col("n_desc") >= threshold)).select("path", "size", "n_desc")


def backfill_depth(snapshot: DataFrame) -> DataFrame:
    """An old snapshot with ``depth`` derived from its paths, in snapshot order."""
    return R.in_order(snapshot.withColumn("depth", P.depth_of("path")))


def backfill_stats(registry: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Registry rows whose statistics are null take them from their snapshot's root."""
    roots = snapshots.where(F.col("path") == P.ROOT).select(F.col("scan_id").alias("id"), *[F.col(c).alias(f"in_{c}") for c in STATS])
    rows = registry.join(roots, "id", "left")
    return rows.select(*[F.coalesce(c, f"in_{c}").alias(c) if c in STATS else F.col(c) for c in registry.columns])


def reusable(spark: SparkSession, registry: DataFrame, path: str, needs: list[str] | None = None) -> DataFrame | None:
    """The latest snapshot of a path, unless there is none or it lacks a needed column."""
    last = latest_per_path(registry.where(F.col("path") == path)).first()
    if last is None or not last["blob"]:
        return None
    df = spark.read.parquet(last["blob"])
    return df if set(needs or []) <= set(df.columns) else None


def latest_pair(spark: SparkSession, registry: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored snapshots of the scan before the newest of a path, and of the newest."""
    last = registry.where(F.col("path") == path).orderBy(F.col("time").desc(), F.col("id").desc()).limit(2).collect()
    if len(last) < 2:
        raise ValueError(f"{path} has fewer than two scans")
    return spark.read.parquet(last[1]["blob"]), spark.read.parquet(last[0]["blob"])


def patch_children(children: DataFrame, registry: DataFrame, parent_time: str) -> DataFrame:
    """Direct children (with ``uri``) with the statistics of their own newer scans; ``patched`` marks them."""
    fresh = latest_per_path(registry.where(F.col("time") > F.lit(parent_time).cast("timestamp"))).select(F.col("path").alias("uri"), *[F.col(c).alias(f"new_{c}") for c in STATS], F.lit(True).alias("__p"))
    rows = children.join(fresh, "uri", "left")
    patched = [F.when(F.col("__p"), F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c) if c in STATS else F.col(c) for c in children.columns]
    return rows.select(*patched, F.coalesce("__p", F.lit(False)).alias("patched"))


def merge_live(live: DataFrame, registry: DataFrame, parent: str) -> DataFrame:
    """Live children (uri, kind) with ``scanned``: true for an own scan, partial if only something below has one."""
    newest = latest_per_path(registry)
    exact = newest.select(F.col("path").alias("uri"), *STATS, F.lit(True).alias("__own"))
    lead = parent.rstrip("/") + "/"
    below = newest.where(F.startswith("path", F.lit(lead))).select(F.concat(F.lit(lead), P.first_segment(F.substr("path", F.lit(len(lead) + 1)))).alias("uri"), F.col("path").alias("deep"), F.col("size").alias("deep_size"))
    below = below.where("deep <> uri").groupBy("uri").agg(F.sum("deep_size").alias("deep_size"), F.count(F.lit(1)).alias("n_deep"))
    rows = live.join(exact, "uri", "left").join(below, "uri", "left")
    scanned = F.when(F.col("__own"), "true").when(F.col("n_deep") > 0, "partial").otherwise("false")
    rows = rows.select("uri", "kind", scanned.alias("scanned"), F.coalesce("size", "deep_size").alias("size"), "n_desc")
    return rows.orderBy((F.col("scanned") == "true").desc(), F.col("size").desc_nulls_last(), "uri")


def virtual_root(merged: DataFrame) -> DataFrame:
    """size, n_desc, n_children, n_scanned of a root that has no scan of its own."""
    return merged.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"), F.coalesce(F.sum("n_desc"), F.lit(0)).cast("long").alias("n_desc"), F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("scanned") == "true").alias("n_scanned"))
