"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted.
Rows are combined three times, each time on (digest, whole normalised text), so contents and not
only digests are compared:

1. locally: the salt is the number of the task that reads the row, so the map side of the first
   aggregation leaves one row per text and task;
2. by salt: the tasks' winners of one text meet in up to ``salts`` groups, so that a text that a third
   of all rows share is not the work of one task;
3. globally: the winners of the salts meet, at most ``salts`` rows per text.

Only winners carry text through a shuffle. The documents then look up their group by digest alone;
digests that stand for several contents (none in practice) are resolved by content. Groups of more
than one row in ``HEAVY`` are fewer than ``HEAVY``, whatever the input: they are broadcast, and their
documents, which would crowd one task, are not shuffled at all.

Defined results: null text counts as empty; equal texts form one group whatever their other
columns; of a group the row with the most code points in the original text stays, then the smallest
``doc_id`` (a null id comes last); rows that agree in both are the same row written twice and are all
marked kept (:func:`keep_one` leaves one of them); extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SALTS = 16
#: A group of more than one in so many rows is looked up by broadcast.
HEAVY = 1024
BLANK_CLASS = "[\\x20\\x09-\\x0D]+"
_LAST = 9_223_372_036_854_775_807


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_CLASS, "")


def _rank(chars: Column, doc_id: Column) -> Column:
    """Larger is better: more code points, then a smaller id. A decimal fits Spark's hash aggregate."""
    wide = "decimal(38,0)"
    return (chars.cast(wide) * F.lit("18446744073709551616").cast("decimal(20,0)") + (F.lit(_LAST).cast(wide) - F.coalesce(doc_id, F.lit(_LAST)).cast(wide))).cast(wide)


def _look_up(light: DataFrame, tops: DataFrame) -> DataFrame:
    """The rows with their group's columns; rows whose digest ``tops`` lacks are left out."""
    limit = (tops.agg(F.sum("group_size")).first()[0] or 0) // HEAVY
    heavy = F.broadcast(tops.where(F.col("group_size") > limit)) if limit else None
    if heavy is None:
        return light.join(tops, "digest")
    rest = light.join(heavy.select("digest"), "digest", "left_anti").join(tops.where(F.col("group_size") <= limit), "digest")
    found = light.join(heavy, "digest")
    return found.unionByName(rest)


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digest = digest or (lambda text: F.sha2(text.cast("binary"), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"), F.length(F.coalesce(F.col("text"), F.lit(""))).alias("chars"))
    rows = rows.withColumn("digest", digest(F.col("norm"))).withColumn("best", _rank(F.col("chars"), F.col("doc_id")))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    # the exchange by digest below serves both the last combination and the count of contents
    winners = salted.groupBy("digest", "norm", "salt").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    groups = winners.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    groups = materialise(groups.select("digest", "best", F.col("n").alias("group_size"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "exact-groups")

    clash = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest")
    light = materialise(rows.select("doc_id", "digest", "best"), "exact-rows")
    tops = groups.withColumnRenamed("best", "top")
    if clash.isEmpty():
        found = _look_up(light, tops)
    else:
        one = _look_up(light, tops.join(clash, "digest", "left_anti"))
        shared = rows.join(clash, "digest", "left_semi")
        contents = shared.groupBy("digest", "norm").agg(F.max("best").alias("top"), F.count(F.lit(1)).alias("group_size"))
        many = shared.join(contents, ["digest", "norm"]).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
        found = one.unionByName(many.select(*one.columns))
    keep = F.lit(_LAST).cast("decimal(38,0)") - F.pmod(F.col("top"), F.lit("18446744073709551616").cast("decimal(20,0)"))
    keep = F.when(keep == F.lit(_LAST), F.lit(None).cast("long")).otherwise(keep.cast("long"))
    return found.select("doc_id", keep.alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("best") == F.col("top")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents, all columns, without exact copies; of a row written twice one stays."""
    n = "__exact_dedup_"
    rows = docs.select("*", normalised(F.col("text")).alias(f"{n}norm"))
    rows = rows.withColumn(f"{n}digest", F.sha2(F.col(f"{n}norm").cast("binary"), 256)).drop(f"{n}norm")
    kept = exact_groups(docs, salts).where("kept").groupBy(F.col("text_sha256").alias(f"{n}sha"), F.col("keep_id").alias(f"{n}keep")).agg(F.count(F.lit(1)).alias(f"{n}rows"))
    kept = materialise(kept, "exact-kept")
    match = (F.col(f"{n}digest") == F.col(f"{n}sha")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{n}keep"))
    again = kept.where(f"{n}rows > 1")
    if again.isEmpty():
        return rows.join(kept, match, "left_semi").select(*docs.columns)
    # rows written more than once in HEAVY are fewer than HEAVY keys: broadcast, combined before the shuffle
    limit = max(1, kept.agg(F.sum(f"{n}rows")).first()[0] // HEAVY)
    heavy = F.broadcast(kept.where(F.col(f"{n}rows") > limit))
    rest = rows.join(heavy, match, "left_anti")
    found = rest.join(kept.where(f"{n}rows = 1"), match, "left_semi").select(*docs.columns)
    twice = rest.join(again.where(F.col(f"{n}rows") <= limit), match, "left_semi").unionByName(rows.join(heavy, match, "left_semi"))
    longest = F.max_by(F.struct(*docs.columns), F.length(F.coalesce(F.col("text"), F.lit("")))).alias(f"{n}row")
    first = twice.groupBy(f"{n}digest", F.col("doc_id").cast("long").alias(f"{n}id")).agg(longest)
    return found.unionByName(first.select(f"{n}row.*"))
