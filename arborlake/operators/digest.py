"""Merkle digests of directories, and directories that moved.

A directory's digest is made of its children only: of each file's name and size, of each directory's name and digest. Files
are taken in by one aggregation over their parents; then digests go up level by level, each level one aggregation over that level's
directories. No file is spread over its depth. The combination is that of a multiset: two salted 64-bit hashes of each child, added
up in halves, so repeated children count and order does not.

Equal subtrees have equal digests wherever they hang, and equal heights, which :func:`moved` goes down by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..steps import materialise
from .index import ranks

_SUMS = [f"{half}{k}" for k in (1, 2) for half in ("lo", "hi")]
_HALF = (1 << 32) - 1


def _child(name: Column, kind: str, content: str) -> list[Column]:
    """A child's share of the four sums; 2^31 children of a directory fit."""
    out = []
    for k in (1, 2):
        h = F.xxhash64(F.lit(k), name, F.lit(kind), F.col(content))
        out += [h.bitwiseAND(F.lit(_HALF)).alias(f"lo{k}"), F.shiftrightunsigned(h, 32).alias(f"hi{k}")]
    return out


def _level(path: str) -> Column:
    """Number of directories above; a leading slash is no level."""
    p = F.col(path)
    return P.depth_of(p) - F.startswith(p, F.lit("/")).cast("int")


def directory_digests(files: DataFrame) -> DataFrame:
    """path, size, n_files, height, digest (32 hex digits) of every directory above files (path, size); the root is ``.``."""
    one, nil = F.lit(1).cast("long"), F.lit(0)
    own = files.select(P.parent_of("path").alias("dir"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), P.basename("path").alias("name"))
    own = own.select("dir", "size", one.alias("n_files"), one.alias("n"), nil.alias("height"), *_child(F.col("name"), "file", "size"))
    root = files.sparkSession.range(1).select(F.lit("").alias("dir"), *[F.lit(0).cast("long").alias(c) for c in ("size", "n_files", "n")], nil.alias("height"), *[F.lit(0).cast("long").alias(c) for c in _SUMS])
    gathered = [*[F.sum(c).alias(c) for c in ("size", "n_files", "n", *_SUMS)], F.max("height").alias("height")]
    by_dir = materialise(own.unionByName(root).groupBy("dir").agg(*gathered).withColumn("level", _level("dir")), "files-by-directory")
    up, out = None, None
    for level in range(by_dir.agg(F.max("level")).first()[0], -1, -1):
        rows = by_dir.where(F.col("level") == level).drop("level")
        if up is not None:
            rows = rows.unionByName(up).groupBy("dir").agg(*gathered)
        digest = F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "n", *_SUMS)), 16, "0") for k in (1, 2)]))
        done = materialise(rows.select("dir", "size", "n_files", "height", digest.alias("digest")), "digests")
        up = done.where("dir <> ''").select(P.parent_of("dir").alias("dir"), "size", "n_files", one.alias("n"), (F.col("height") + 1).alias("height"), *_child(P.basename("dir"), "dir", "digest"))
        out = done if out is None else out.unionByName(done)
    return out.select(P.named("dir").alias("path"), "size", "n_files", "height", "digest")


def equal_groups(digests: DataFrame) -> DataFrame:
    """Every directory with n_equal, how many hold the same, and first_equal, the first of these by path."""
    groups = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n_equal"), F.min("path").alias("first_equal"))
    return digests.join(groups, "digest")


def _nth(rows: DataFrame, name: str) -> DataFrame:
    """digest, nth, path: places among equal digests by path; a digest that many directories share is ranked by many tasks."""
    ranked = materialise(ranks(rows.select("digest", "path"), ["digest", "path"], "r"), "equal-digests")
    first = ranked.groupBy("digest").agg(F.min("r").alias("r0"))
    return ranked.join(first, "digest").select("digest", (F.col("r") - F.col("r0")).alias("nth"), F.col("path").alias(name))


def _pairs(gone: DataFrame, new: DataFrame) -> DataFrame:
    """digest, path_from, path_to of equal digests; where one side has several, in the order of their paths."""
    def count(df, s):
        return df.groupBy("digest").agg(F.count(F.lit(1)).alias(f"n_{s}"), F.min("path").alias(f"path_{s}"))

    both = materialise(count(gone, "from").join(count(new, "to"), "digest"), "shared-digests")
    single = (F.col("n_from") == 1) & (F.col("n_to") == 1)
    found, several = both.where(single).select("digest", "path_from", "path_to"), both.where(~single).select("digest")
    if several.isEmpty():
        return found
    left, right = (_nth(df.join(several, "digest", "left_semi"), f"path_{s}") for df, s in ((gone, "from"), (new, "to")))
    return found.unionByName(left.join(right, ["digest", "nth"]).select("digest", "path_from", "path_to"))


def _outside(rows: DataFrame, tops: DataFrame | None, column: str) -> DataFrame:
    if tops is None:
        return rows
    up = rows.select("path", F.explode(P.ancestors("path")).alias("up"))
    return rows.join(up.join(tops.select(F.col(column).alias("up")), "up", "left_semi").select("path").distinct(), "path", "left_anti")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """path_from, path_to, size, n_files: directories that are gone under one path and new under another with the same content.

    Only the highest are told: the two sides are matched from the highest subtrees down, and what lies in a matched directory
    takes no further part. Where several directories hold the same, they are paired in the order of their paths and the
    rest of the longer side stays unpaired. Rounds are as many as the tree is high.
    """
    cols = ["path", "size", "n_files", "height", "digest"]
    gone = before.where(F.col("path") != P.ROOT).select(*cols).join(after.select("path"), "path", "left_anti")
    new = after.where(F.col("path") != P.ROOT).select(*cols).join(before.select("path"), "path", "left_anti")
    gone, new = materialise(gone, "gone"), materialise(new, "new")
    heights = [r[0] for r in gone.select("height").distinct().intersect(new.select("height").distinct()).collect()]  # as many as levels
    found = None
    for h in sorted(heights, reverse=True):
        left, right = (_outside(df.where(F.col("height") == h), found, c) for df, c in ((gone, "path_from"), (new, "path_to")))
        pairs = materialise(_pairs(left, right).select("path_from", "path_to"), "moved")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = gone.limit(0).select(F.col("path").alias("path_from"), F.col("path").alias("path_to"))
    told = gone.select(F.col("path").alias("path_from"), "size", "n_files")
    return found.join(told, "path_from").select("path_from", "path_to", "size", "n_files")
