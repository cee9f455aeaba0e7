"""Tree rollup: every directory's sums over all that is below it.

Files are summed by their own directory first; only the distinct directories are spread to their
ancestors, so rows times depth is paid for directories and not for files. Three aggregations, all
combined before their shuffle, the last of which counts subdirectories: the plan does not depend on the depth of
the tree, and the root, to which every row belongs, arrives as one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S

MAX_PIVOT_VALUES = 32
_WIDE = "decimal(38,0)"


def pivot_columns(df: DataFrame, column: str) -> dict[str, Column]:
    """sum_<column>_<value> for each value that is not null, in order. More than 32 values are an error."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_PIVOT_VALUES + 1).collect()]
    if len(found) > MAX_PIVOT_VALUES:
        raise ValueError(f"{column} has more than {MAX_PIVOT_VALUES} values")
    return {f"sum_{column}_{v}": F.when(F.col(column) == v, F.col("size")).otherwise(F.lit(0)).cast("long") for v in sorted(found)}


def _weight() -> Column:
    return F.col("mtime").cast("decimal(19,0)") * F.col("size").cast("decimal(18,0)")


def _mean(weight: Column, size: Column) -> Column:
    return F.when(size == 0, F.lit(None)).otherwise(weight.cast("double") / size.cast("double"))


def rollup(rows: DataFrame, scan_root: str, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, mean_mtime: bool = False, xors: dict[str, Column] | None = None) -> DataFrame:
    """The snapshot of walk rows (path, size, mtime, kind; the root's path is ``''``).

    Directory rows add their own size and mtime. Rows of other kinds (links and so on) count in sizes and
    ``n_desc`` only. ``sums`` and ``maxes`` are further columns, over the rows' columns, that go up the
    tree unchanged; ``xors`` go up by exclusive-or. ``mean_mtime`` adds the exact size-weighted mean.
    """
    sums, maxes, xors = dict(sums or {}), dict(maxes or {}), dict(xors or {})
    extra = [*sums, *maxes, *xors]
    rows = rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).withColumn("mtime", F.coalesce("mtime", F.lit(0)).cast("long"))
    weight = ["__w"] if mean_mtime else []  # decimals are slow, so only where they are asked for
    rows = rows.select("path", "size", "mtime", "kind", *[_weight().alias(w) for w in weight], *[c.alias(n) for n, c in {**sums, **maxes, **xors}.items()])

    merged = [F.sum("size").alias("size"), F.max("mtime").alias("mtime"), F.sum("n_files").alias("n_files"), F.sum("n_other").alias("n_other"), *[F.sum(w).alias(w) for w in weight], *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes], *[F.bit_xor(c).alias(c) for c in xors]]
    at = F.when(F.col("kind") == "dir", F.col("path")).otherwise(P.parent_of("path"))
    other = ((F.col("kind") != "file") & (F.col("kind") != "dir")).cast("long")
    own = rows.select(at.alias("dir"), (F.col("kind") == "file").cast("long").alias("n_files"), other.alias("n_other"), "size", "mtime", *weight, *extra)
    # the root exists whatever the input holds
    root = rows.sparkSession.range(1).select(F.lit("").alias("dir"), *[F.lit(0).cast("long").alias(c) for c in ("n_files", "n_other", "size", "mtime")], *[F.lit(0).cast(_WIDE).alias(w) for w in weight], *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in extra])
    by_dir = own.unionByName(root).groupBy("dir").agg(*merged)
    spread = by_dir.select(F.explode(P.ancestors("dir", own=True)).alias("up"), "*")
    dirs = spread.groupBy("up").agg(*merged, F.sum(F.when(F.col("up") == F.col("dir"), F.col("n_files"))).alias("own_files"), F.sum(F.when(F.col("up") == F.col("dir"), F.col("n_other"))).alias("own_other"))
    # a directory's own row meets its subdirectories in one more aggregation, so that the sums are computed once and not joined
    held = [c for c in dirs.columns if c != "up"]
    near = dirs.select(F.explode(P.ancestors("up", own=True)).alias("dir"), "*").withColumn("__own", F.col("dir") == F.col("up"))
    is_child = ~F.col("__own") & (P.parent_of("up") == F.col("dir"))
    full = near.groupBy("dir").agg(*[F.max(F.when(F.col("__own"), F.col(c))).alias(c) for c in held], F.count_if(~F.col("__own")).alias("n_sub"), F.count_if(is_child).alias("own_sub"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    mean = [_mean(F.col("__w"), F.col("size")).alias("mtime_mean")] if mean_mtime else []
    keep_extra = [*[zero(c).alias(c) for c in sums], *[F.col(c) for c in maxes], *[zero(c).alias(c) for c in xors]]
    out_dirs = full.select(
        P.named("dir").alias("path"), "size", "mtime", (1 + zero("n_files") + zero("n_other") + zero("n_sub")).cast("long").alias("n_desc"), zero("n_files").alias("n_files"),
        (zero("own_files") + zero("own_other") + zero("own_sub")).cast("long").alias("n_children"), F.lit("dir").alias("kind"), P.dir_parent("dir").alias("parent"), *keep_extra, *mean,
        P.uri_of(scan_root, "dir").alias("uri"), P.depth_of("dir").alias("depth"),
    )
    one, nil = F.lit(1).cast("long"), F.lit(0).cast("long")
    own_mean = [F.col("mtime").cast("double").alias("mtime_mean")] if mean_mtime else []
    out_files = rows.where("kind = 'file'").select("path", "size", "mtime", one.alias("n_desc"), one.alias("n_files"), nil.alias("n_children"), "kind", P.parent_of("path").alias("parent"), *keep_extra, *own_mean, P.uri_of(scan_root, "path").alias("uri"), P.depth_of("path").alias("depth"))
    return out_dirs.unionByName(out_files)


def derived(scan_root: str) -> dict[str, Column]:
    """The columns of a snapshot that follow from path and kind."""
    return {"parent": F.when(F.col("kind") == "dir", P.dir_parent(P.bare("path"))).otherwise(P.parent_of("path")), "uri": P.uri_of(scan_root, "path")}


def paths(rows: DataFrame) -> DataFrame:
    """path and kind of the rows of :func:`rollup`, for what reads no sums: two aggregations of directories, none of values."""
    at = F.when(F.col("kind") == "dir", F.col("path")).otherwise(P.parent_of("path"))
    root = rows.sparkSession.range(1).select(F.lit("").alias("dir"))
    own = rows.select(at.alias("dir")).unionByName(root).distinct()
    dirs = own.select(F.explode(P.ancestors("dir", own=True)).alias("dir")).distinct()
    return dirs.select(P.named("dir").alias("path"), F.lit("dir").alias("kind")).unionByName(rows.where("kind = 'file'").select("path", "kind"))


def listing_rows(listing: DataFrame) -> DataFrame:
    """Layer-1 objects as walk rows: canonical keys, null sizes 0, epoch seconds. Other columns stay."""
    rest = [c for c in listing.columns if c not in ("name", "size_bytes", "created", "path", "size", "mtime", "kind")]
    return listing.select(P.canonical_key("name").alias("path"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size"), S.epoch_seconds("created").alias("mtime"), F.lit("file").alias("kind"), *rest)


def rollup_listing(listing: DataFrame, scan_root: str, pivots: list[str] | None = None, mean_mtime: bool = False) -> DataFrame:
    rows = listing_rows(listing)
    sums: dict[str, Column] = {}
    for c in pivots or []:
        sums |= pivot_columns(rows, c)
    return rollup(rows, scan_root, sums=sums, mean_mtime=mean_mtime)


def merge_rollups(parts: DataFrame) -> DataFrame:
    """One snapshot of the partial rollups of disjoint shards of a listing (all in one table).

    Sums and maxima add up; a directory that several shards hold counts itself once.
    """
    sums = [c for c in parts.columns if c.startswith("sum_")]
    dirs = parts.where("kind = 'dir'").groupBy("path").agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"), F.sum("n_files").alias("n_files"), *[F.sum(c).alias(c) for c in sums], F.first("uri").alias("uri"))
    inside = P.bare("path")
    below = dirs.select(inside.alias("sub")).where("sub <> ''").select(F.explode(P.ancestors("sub")).alias("dir"), "sub")
    below = below.groupBy("dir").agg(F.count(F.lit(1)).alias("n_sub"), F.count_if(P.parent_of("sub") == F.col("dir")).alias("own_sub"))
    files = parts.where("kind = 'file'")
    own = files.groupBy(F.col("parent").alias("dir")).agg(F.count(F.lit(1)).alias("own_files"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    full = dirs.withColumn("dir", inside).join(below, "dir", "left").join(own, "dir", "left")
    out = full.select("path", "size", "mtime", (1 + zero("n_files") + zero("n_sub")).cast("long").alias("n_desc"), "n_files", (zero("own_files") + zero("own_sub")).cast("long").alias("n_children"), F.lit("dir").alias("kind"), P.dir_parent("dir").alias("parent"), *sums, "uri", P.depth_of("path").alias("depth"))
    return out.unionByName(files.select(*out.columns))


def root_stats(snapshot: DataFrame) -> DataFrame:
    """n_rows and the root's size, mtime, n_desc, n_files, n_children."""
    return snapshot.agg(F.count(F.lit(1)).alias("n_rows"), *[F.max(F.when(F.col("path") == P.ROOT, F.col(c))).alias(c) for c in ("size", "mtime", "n_desc", "n_files", "n_children")])


def point_stats(snapshot: DataFrame, path: str) -> DataFrame:
    return snapshot.where(F.col("path") == (path or P.ROOT)).select("path", "kind", "size", "mtime", "n_desc", "n_files", "n_children")


def in_order(snapshot: DataFrame) -> DataFrame:
    return snapshot.orderBy("depth", "path", "kind")
