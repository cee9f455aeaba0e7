"""Row numbers and running totals inside keys of any size, without a task that holds a whole key.

A window by key alone puts a key that holds a third of all rows into one task. Here only keys of at most
``MOST`` rows are numbered that way. Longer ones are dealt by range of (key, order), so that many tasks share
a key, numbered inside each range, and shifted by the rows of the ranges before. At most one key goes on from a range
to the next, so the table of shifts has at most two rows a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

MOST = 4096


def ranked(df: DataFrame, key: str, order: list[Column], name: str, most: int = MOST) -> DataFrame:
    """``df`` with ``name``: the row's number, from 1, inside its key by ``order``; rows equal in it come in any order."""
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    long = materialise(df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("__key"), "long-keys")
    if long.isEmpty():
        return df.withColumn(name, number(key))
    same = F.col(key).eqNullSafe(F.col("__key"))
    few = df.join(long, same, "left_anti").withColumn(name, number(key))
    many = df.join(long, same, "left_semi").withColumn("__tie", F.monotonically_increasing_id())
    dealt = many.repartitionByRange(F.col(key).asc_nulls_first(), *order, "__tie").withColumn("__part", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__range")).agg(F.count(F.lit(1)).alias("n"))
    shift = shift.select("__key", "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    inside = dealt.withColumn("__at", number("__part", key))
    met = inside.join(shift, (F.col("__part") == F.col("__range")) & same)
    return few.unionByName(met.withColumn(name, F.col("__at") + F.col("__shift")).select(*few.columns))


def running(df: DataFrame, key: str, at: str, totals: dict[str, tuple], block: int = MOST, last_first: bool = False) -> DataFrame:
    """``df`` with a running total for each name of ``totals``, a pair (aggregate, column), over a key's rows by ``at``, its own row included.

    Rows are totalled inside blocks of ``block`` numbers; keys of several blocks add the totals of the blocks before
    (after, with ``last_first``). ``agg`` is ``F.sum`` or ``F.bit_xor``.
    """
    way = (lambda c: F.col(c).desc()) if last_first else F.col
    join = lambda agg, a, b: a.bitwiseXOR(b) if agg is F.bit_xor else a + b
    cut = df.withColumn("__block", F.floor(F.col(at) / F.lit(block)).cast("long"))
    inner = Window.partitionBy(key, "__block").orderBy(way(at)).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({n: agg(c).over(inner) for n, (agg, c) in totals.items()})
    several = df.groupBy(F.col(key).alias("__key")).agg(F.max(at).alias("__far")).where(F.floor(F.col("__far") / F.lit(block)) > 0).select("__key")
    several = materialise(several, "several-blocks")
    if several.isEmpty():
        return cut.drop("__block")
    whole = df.join(several, F.col(key) == F.col("__key"), "left_semi").groupBy(F.col(key).alias("__key"), F.floor(F.col(at) / F.lit(block)).cast("long").alias("__of")).agg(*[agg(c).alias(f"__{n}") for n, (agg, c) in totals.items()])
    before = Window.partitionBy("__key").orderBy(way("__of")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("__key", "__of", *[agg(f"__{n}").over(before).alias(f"__{n}") for n, (agg, _) in totals.items()])
    met = cut.join(whole, (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__of")), "left")
    met = met.withColumns({n: join(agg, F.col(n), F.coalesce(F.col(f"__{n}"), F.lit(0).cast("long"))) for n, (agg, _) in totals.items()})
    return met.drop("__block", "__key", "__of", *[f"__{n}" for n in totals])
