"""Byte-weighted age histograms of the children of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..steps import materialise


def age_edges(files: DataFrame, bins: int) -> list[float]:
    """Equal widths from the oldest to the newest mtime; a single mtime gets one second."""
    lo, hi = files.agg(F.min("mtime"), F.max("mtime")).first()
    if lo is None:
        return []
    lo, hi = float(lo), float(hi)
    if hi <= lo:
        hi = lo + 1
    return [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]


def drilled_files(snapshot: DataFrame, under: str = "") -> DataFrame:
    """child, deeper, size, mtime of the files below a path that have an mtime."""
    rows = P.subtree(snapshot, under).where("kind = 'file' and mtime is not null")
    rel = F.col("path") if under in ("", P.ROOT) else F.substr("path", F.lit(len(under) + 2))
    rows = rows.select(rel.alias("rel"), F.coalesce("size", F.lit(0)).alias("size"), "mtime").where("rel <> ''")
    return rows.select(P.first_segment("rel").alias("child"), F.contains("rel", F.lit("/")).alias("deeper"), "size", "mtime")


def _by_time(snapshot: DataFrame, under: str) -> DataFrame:
    """child, mtime, size, n_files, deeper: the files of one time summed, read from the snapshot once."""
    files = drilled_files(snapshot, under).groupBy("child", "mtime").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_files"), F.max("deeper").alias("deeper"))
    return materialise(files, "ages")


def _bins(files: DataFrame, edges: list[float]) -> DataFrame:
    if len(edges) < 2:
        raise ValueError("two edges or more are needed")
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    at = F.size(F.filter(inner, lambda e: e <= F.col("mtime")))
    return files.groupBy("child", at.alias("bin")).agg(F.sum("size").alias("bytes"), F.sum("n_files").alias("n_files"), F.max("deeper").alias("deeper"))


def age_bins(snapshot: DataFrame, under: str = "", bins: int = 40, edges: list[float] | None = None) -> DataFrame:
    """child, bin, bytes, n_files, deeper: the long form. Mtimes outside given edges fall into the end bins."""
    files = _by_time(snapshot, under)
    return _bins(files, (age_edges(files, bins) or [0.0, 1.0]) if edges is None else edges)


def age_histograms(snapshot: DataFrame, under: str = "", bins: int = 40, limit: int | None = None, edges: list[float] | None = None) -> DataFrame:
    """path, kind, bytes (array), total_bytes, n_files, edges, omitted, omitted_bytes per child, largest first.

    With ``limit`` the smaller children are left out; every row says how many and how many bytes.
    """
    files = _by_time(snapshot, under)
    edges = edges or age_edges(files, bins) or [0.0, 1.0]
    n = len(edges) - 1
    long = materialise(_bins(files, edges), "age-bins")
    rows = long.groupBy("child").agg(F.sum("bytes").alias("total_bytes"), F.sum("n_files").alias("n_files"), F.max("deeper").alias("deeper"), F.map_from_entries(F.collect_list(F.struct("bin", "bytes"))).alias("by_bin"))
    full = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("by_bin", i), F.lit(0)).cast("long"))
    rows = rows.select(F.col("child").alias("path"), F.when(F.col("deeper"), "dir").otherwise("file").alias("kind"), full.alias("bytes"), "total_bytes", "n_files", F.array(*[F.lit(int(e)).cast("long") for e in edges]).alias("edges"))
    if limit is None:
        return rows.withColumn("omitted", F.lit(0).cast("long")).withColumn("omitted_bytes", F.lit(0).cast("long"))
    kept = rows.orderBy(F.col("total_bytes").desc(), "path").limit(limit)
    every, seen = rows.agg(F.count(F.lit(1)), F.sum("total_bytes")).first(), kept.agg(F.count(F.lit(1)), F.sum("total_bytes")).first()
    return kept.withColumn("omitted", F.lit(every[0] - seen[0]).cast("long")).withColumn("omitted_bytes", F.lit((every[1] or 0) - (seen[1] or 0)).cast("long"))


