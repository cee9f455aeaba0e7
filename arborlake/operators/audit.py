"""Audits of listings: prefix weights, key ranges, duplicate and sparse keys, cardinalities, file pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..steps import materialise


def prefix_weights(listing: DataFrame) -> DataFrame:
    """prefix, n_objects of the first one and two levels; a level counts only where a slash ends it."""
    parts = F.split("name", "/")
    one = listing.where(F.contains("name", F.lit("/"))).select(F.concat(parts[0], F.lit("/")).alias("prefix"))
    two = listing.where(F.size(parts) >= 3).select(F.concat(parts[0], F.lit("/"), parts[1], F.lit("/")).alias("prefix"))
    return one.unionByName(two).groupBy("prefix").agg(F.count(F.lit(1)).alias("n_objects"))


def key_ranges(listing: DataFrame, prefix: str, k: int) -> DataFrame:
    """tile, first_key: where to cut the keys below a heavy prefix into ``k`` ranges of equal weight.

    The cuts are exact: keys are dealt by range, sorted and numbered in each partition, and the cuts' ranks
    are found by the partitions' counts. Fewer distinct keys than ranges leave the prefix whole.
    """
    spark = listing.sparkSession
    keys = listing.where(F.startswith("name", F.lit(prefix))).select("name")
    dealt = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "name").sortWithinPartitions("name")
    dealt = materialise(dealt.select("name", F.monotonically_increasing_id().alias("at")), "key-ranges")
    held = sorted((r["part"], r["n"]) for r in dealt.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    small, more = divmod(sum(n for _, n in held), k)
    cuts, before = [], 0
    ranks = [(t + 1, t * small + min(t, more)) for t in range(k if small else more)]
    for part, n in held:
        cuts += [(t, (part << 33) + rank - before) for t, rank in ranks if before <= rank < before + n]
        before += n
    wanted = F.broadcast(spark.createDataFrame(cuts, "tile int, at long"))
    tiles = dealt.join(wanted, "at").select("tile", F.col("name").alias("first_key"))
    if tiles.select("first_key").distinct().count() < k:
        return tiles.where("tile = 1")
    return tiles


def duplicate_keys(listing: DataFrame, worst: int = 5) -> DataFrame:
    """bucket, name, n_rows of the keys with most rows, if more than one."""
    return listing.groupBy("bucket", "name").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").orderBy(F.col("n_rows").desc(), "bucket", "name").limit(worst)


def duplicate_summary(listing: DataFrame) -> DataFrame:
    by_key = listing.groupBy("bucket", "name").agg(F.count(F.lit(1)).alias("n"))
    return by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"))


def sparse_keys(listing: DataFrame) -> DataFrame:
    """n_rows and how many keys are not in canonical form."""
    return listing.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(P.is_sparse("name")).alias("n_sparse"))


def cardinalities(snapshot: DataFrame) -> DataFrame:
    """n_rows, n_names, n_dir_names (both approximate beyond a few thousand)."""
    rows = snapshot.where(F.col("path") != P.ROOT).select(P.basename("path").alias("name"), "kind")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct("name").alias("n_names"), F.approx_count_distinct(F.when(F.col("kind") == "dir", F.col("name"))).alias("n_dir_names"))


def name_sketches(snapshot: DataFrame) -> DataFrame:
    """depth, kind, n_rows, sketch: a binary sketch of the names of each depth and kind, to be stored beside a snapshot."""
    rows = snapshot.where(F.col("path") != P.ROOT).select(P.depth_of("path").alias("depth"), "kind", P.basename("path").alias("name"))
    return rows.groupBy("depth", "kind").agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg("name", F.lit(14)).alias("sketch"))


def merged_names(sketches: DataFrame, *by: str) -> DataFrame:
    """``by``, n_rows, n_names: stored sketches merged over the depths, kinds or snapshots that ``by`` leaves out."""
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_names"))


def rows_by_depth(snapshot: DataFrame) -> DataFrame:
    """depth, n_rows and the rows of that depth or less."""
    by = snapshot.groupBy(P.depth_of("path").alias("depth")).agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # one row per depth
    return by.select("depth", "n_rows", F.sum("n_rows").over(w).alias("n_rows_so_far"))


def media_pairs(files: DataFrame, pattern: str = r"VID_(\d{8}_\d{6})_(\d\d)_(\d\d\d)\.(.*)$", extra: str = "mp4", partner: str = "insv") -> DataFrame:
    """path, partner_0, partner_1, size: files of one kind whose (date, index) group has exactly two partners."""
    name = P.basename("path")
    rows = files.select("path", "size", F.regexp_extract(name, pattern, 1).alias("dt"), F.regexp_extract(name, pattern, 3).alias("idx"), F.endswith(name, F.lit(f".{extra}")).alias("is_extra"), F.endswith(name, F.lit(f".{partner}")).alias("is_partner")).where("dt <> ''")
    sides = rows.where("is_partner").groupBy("dt", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("partner_0"), F.max("path").alias("partner_1")).where("n = 2")
    return rows.where("is_extra").join(sides, ["dt", "idx"]).select("path", "partner_0", "partner_1", "size")
