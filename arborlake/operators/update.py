"""Deleting subtrees from a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..steps import materialise
from . import rollup as R


def delete_subtree(snapshot: DataFrame, path: str) -> tuple[DataFrame, dict | None]:
    """The snapshot without a path and all below it, and the statistics of what went (None if it is absent).

    Ancestors lose the size, ``n_desc``, ``n_files`` and pivot sums; the parent loses one child. ``mtime`` and
    the mean are maxima and quotients of what is gone and are left as they were.
    """
    found = snapshot.where(F.col("path") == path).orderBy("kind").first()
    if found is None:
        return snapshot, None
    gone = found.asDict()
    parts = path.split("/")
    above = [P.ROOT, *["/".join(parts[:k]) for k in range(1, len(parts))]]
    sums = [c for c in snapshot.columns if c in ("size", "n_desc", "n_files") or c.startswith("sum_")]
    hit = F.col("path").isin(above) & (F.col("kind") == "dir")
    out = snapshot.where(~P.under("path", path))
    changed = {c: F.when(hit, F.col(c) - F.lit(gone[c] or 0)).otherwise(F.col(c)) for c in sums}
    changed["n_children"] = F.when((F.col("path") == above[-1]) & (F.col("kind") == "dir"), F.col("n_children") - 1).otherwise(F.col("n_children"))
    return out.withColumns(changed), {c: gone[c] for c in ("path", "kind", "size", "n_desc", "n_files", "n_children")}


def delete_prefixes(snapshot: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The snapshot without the paths of a table of any size (``path``) and all below them.

    Of nested paths the outermost counts. What each takes with it is its own row's statistics; these are summed once for every
    ancestor and taken off in one join. As with one path, ``mtime`` and the mean stay, and a directory that loses all its children stays,
    empty. Absent paths change nothing; the root cannot be deleted.
    """
    tops = P.outermost(prefixes.select("path").where(~F.col("path").isin("", P.ROOT)))
    tops = materialise(tops.withColumn("__n", F.size(F.split("path", "/"))), "deleted-prefixes")
    levels = [r[0] for r in tops.select("__n").distinct().collect()]  # as many as the deepest path has segments
    if not levels:
        return snapshot
    sums = [c for c in snapshot.columns if c in ("size", "n_desc", "n_files") or c.startswith("sum_")]
    gone = snapshot.join(tops.select("path"), "path", "left_semi").select("path", *sums)
    lost = gone.select(F.explode(P.ancestors("path")).alias("__up"), P.parent_of("path").alias("__parent"), *sums).groupBy("__up").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"__{c}") for c in sums], F.count_if(F.col("__parent") == F.col("__up")).alias("__n_children"))
    # a row is under a deleted path if its first n segments are one, for one of the levels
    parted = snapshot.select("path", F.size(F.split("path", "/")).alias("__n"))
    at = F.array(*[F.when(F.col("__n") >= n, F.substring_index("path", "/", n)) for n in levels])
    tested = parted.select("path", F.explode(at).alias("__top")).where("__top is not null")
    under = tested.join(tops.select(F.col("path").alias("__top")), "__top", "left_semi").select("path")
    kept = snapshot.join(under, "path", "left_anti")
    met = kept.join(lost, (P.bare("path") == F.col("__up")) & (F.col("kind") == "dir"), "left")
    return met.select(*[(F.col(c) - F.coalesce(f"__{c}", F.lit(0))).alias(c) if c in [*sums, "n_children"] else F.col(c) for c in snapshot.columns])


def refreshed_stats(registry: DataFrame, scan_id: int, snapshot: DataFrame) -> DataFrame:
    """The registry with one scan's root statistics taken from its changed snapshot."""
    stats = R.root_stats(snapshot).select(F.lit(scan_id).cast("long").alias("id"), *[F.col(c).alias(f"new_{c}") for c in ("size", "n_children", "n_desc", "mtime")])
    rows = registry.join(F.broadcast(stats), "id", "left")
    return rows.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ("size", "n_children", "n_desc", "mtime") else F.col(c) for c in registry.columns])
