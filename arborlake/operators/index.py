"""A snapshot on disk with a name index that lets searches skip data.

:func:`write_indexed` writes four tables under one folder:

- ``rows``: the snapshot in (depth, path) order, in partitions ``slice`` of ``slice_rows`` rows each, by exact rank;
- ``slices``: what each slice holds, from (depth, path) to (depth, path), for browsing;
- ``names``: every basename with its counts, its number and the slices that hold it;
- ``postings``: for each trigram of a name, lower-cased, and each block of ``POSTING`` name numbers the numbers that have it, so no
  row grows with the number of names.

A search turns its pattern into trigrams that a match must hold (:func:`required`), combines their posting rows block by
block with array intersections and unions, tests the names that are left, and joins the slices of these names to the
rows. The join is on the partition column with a broadcast of slice numbers, so Spark prunes partitions at run time and opens
the files of those slices only. Rows are tested again, so the index decides what is read and never what matches.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..steps import materialise
from . import search as Q

SLICE_ROWS, POSTING = 262_144, 4096
#: Rows that one task sorts.
RANGE_ROWS = 1_048_576
#: Names whose postings one task gathers.
TASK_NAMES = 524_288
_ORDER = ["depth", "path", "kind"]
_BITS = 33
#: Longs that hold the numbers of a trigram while they are gathered.
_WORDS = 8
#: What :func:`write_indexed` can write.
TABLES = ("rows", "slices", "names", "postings")


def ranks(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's exact rank, from 0, in the order of ``keys``.

    Rows are computed once as a step, dealt by range, sorted and numbered in their partition; the partitions' counts, one row each, shift
    the numbers. The ranges follow the rows, so no task sorts more as the table grows.
    """
    df = materialise(df, "to-rank")
    return _counted(_dealt(df, keys).sortWithinPartitions(*keys), name)


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """A step dealt by range; the ranges follow its rows."""
    return df.repartitionByRange(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RANGE_ROWS)), *keys)


def _counted(dealt: DataFrame, name: str) -> DataFrame:
    """Sorted ranges with ``name``, the number of each row."""
    dealt = materialise(dealt.withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", _BITS)
    held, before = [], 0
    for r in sorted(dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        held.append((r["part"], before))
        before += r["n"]
    shift = F.broadcast(dealt.sparkSession.createDataFrame(held, "__part long, __before long"))  # one row a partition
    ranked = dealt.join(shift, part == F.col("__part")).withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << _BITS) - 1)))
    return ranked.drop("__id", "__part", "__before")


def folded(name) -> Column:
    """Lower case, with the four letters that regular expressions take for s, k and i without regard to case."""
    plain = F.octet_length(P._col(name)) == F.length(P._col(name))  # ASCII has none of them
    return F.when(plain, F.lower(P._col(name))).otherwise(F.lower(F.translate(P._col(name), "ſKİı", "skii")))


def _stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the files of a table, without opening them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{folder}/rows")
    own = F.xxhash64(F.substring_index("path", "/", -2), "length", F.unix_micros("modificationTime"))
    return tuple(files.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(own), F.lit(0))).first())


def _by_slice(sliced: DataFrame) -> DataFrame:
    """name, slice, n_dirs and n: the rows of a name in a slice; the root has no name."""
    if "child_scan_id" in sliced.columns and sliced.where("child_scan_id is not null").head(1):
        raise ValueError("a chunked snapshot must be merged before it is indexed")
    rows = sliced.where(F.col("path") != P.ROOT).select(P.basename("path").alias("name"), (F.col("kind") == "dir").cast("long").alias("dir"), "slice")
    return rows.groupBy("name", "slice").agg(F.sum("dir").alias("n_dirs"), F.count(F.lit(1)).alias("n"))


def _by_name(by: DataFrame) -> DataFrame:
    return by.groupBy("name").agg(F.sum("n_dirs").alias("n_dirs"), F.sum(F.col("n") - F.col("n_dirs")).alias("n_files"), F.sort_array(F.collect_list("slice")).alias("row_groups"))


def vocabulary(sliced: DataFrame) -> DataFrame:
    """name, n_dirs, n_files and row_groups, the sorted slices that hold it; the root has no name."""
    return _by_name(_by_slice(sliced))


def numbered_vocabulary(sliced: DataFrame) -> DataFrame:
    """:func:`vocabulary` with ``name_id``, the name's rank. Names are dealt by range and sorted once, and gathered and numbered where they are."""
    by = materialise(_by_slice(sliced), "names-by-slice")
    own = Window.partitionBy("name").orderBy("slice")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = _dealt(by, ["name"]).select("name", F.row_number().over(own).alias("__k"), F.sum("n_dirs").over(whole).alias("n_dirs"), F.sum(F.col("n") - F.col("n_dirs")).over(whole).alias("n_files"), F.collect_list("slice").over(whole).alias("row_groups"))
    return _counted(found.where("__k = 1").drop("__k").sortWithinPartitions("name"), "name_id")


def _set_bits(mask: Column, first: int) -> Column:
    """The places of a long's bits that are 1, from ``first``; bytes of zeros are passed over."""
    byte = lambda j: F.call_function("shiftrightunsigned", mask, j * 8).bitwiseAND(F.lit(255))
    some = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: byte(j) != 0)
    held = F.flatten(F.transform(some, lambda j: F.filter(F.sequence(j * 8, j * 8 + 7), lambda i: F.getbit(mask, i) == 1)))
    return F.when(mask == 0, F.array().cast("array<int>")).otherwise(F.transform(held, lambda i: i + first) if first else held)


def postings(names: DataFrame, posting: int = POSTING) -> DataFrame:
    """trigram, block, n_names, numbers: the names (name, name_id) of one block that hold a trigram, at most ``posting``.

    Numbers are gathered as bits of at most ``_WORDS`` longs, which an aggregation changes in place; lists would be sorted twice.
    """
    # names are dealt by block, so that what they hold, many times as many rows, is grouped where it is
    tasks = max(names.sparkSession.sparkContext.defaultParallelism, -(-names.count() // TASK_NAMES))
    dealt = names.select("name_id", folded("name").alias("low"), F.floor(F.col("name_id") / F.lit(posting)).cast("int").alias("block")).repartition(tasks, "block")
    rows = dealt.where(F.length("low") >= 3).select(F.pmod("name_id", F.lit(posting)).cast("int").alias("number"), "block", "low", F.explode(F.sequence(F.lit(1), F.length("low") - 2)).alias("at"))
    words = min(_WORDS, -(-posting // 64))
    parts = -(-posting // (64 * words))
    rows = rows.select(F.substr("low", F.col("at"), F.lit(3)).alias("trigram"), "block", F.expr("shiftleft(1L, number & 63)").alias("bit"), (F.shiftright("number", 6) % words).alias("word"), *([F.floor(F.shiftright("number", 6) / F.lit(words)).cast("int").alias("part")] if parts > 1 else []))
    held = [f"w{w}" for w in range(words)]
    by = rows.groupBy("trigram", "block", *(["part"] if parts > 1 else [])).agg(*[F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).alias(held[w]) for w in range(words)])
    own = F.concat(*[_set_bits(F.col(w), 64 * k) for k, w in enumerate(held)])
    if parts == 1:
        by = by.select("trigram", "block", own.alias("numbers"))
    else:
        moved = by.select("trigram", "block", F.transform(own, lambda n: n + F.col("part") * (64 * words)).alias("some"))
        by = moved.groupBy("trigram", "block").agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("numbers"))
    return by.select("trigram", "block", F.size("numbers").cast("long").alias("n_names"), "numbers")


def write_indexed(snapshot: DataFrame, folder: str, slice_rows: int = SLICE_ROWS, posting: int = POSTING, mode: str = "errorifexists", part_slices: int = 1, tables: tuple[str, ...] = TABLES) -> None:
    """Write a snapshot with its index. The index is stamped with the files it was made of, last of all.

    ``part_slices`` small slices in a row share a partition ``part``, so that folders stay few; ``slice`` is then a column of the rows.
    ``tables`` leaves out what nobody will read: a search does not read ``slices``, a browse no ``names``. Postings need names.
    """
    spark = snapshot.sparkSession
    ranked = ranks(snapshot.withColumn("depth", P.depth_of("path")), _ORDER, "rank").withColumn("slice", F.floor(F.col("rank") / F.lit(slice_rows)).cast("int"))
    if "rows" in tables:
        by = "slice" if part_slices == 1 else "part"
        rows = ranked if part_slices == 1 else ranked.withColumn("part", _part(part_slices))
        rows.sortWithinPartitions(by, "rank").drop("rank").write.mode(mode).partitionBy(by).parquet(f"{folder}/rows")
    if "slices" in tables:
        # ranks tell each slice's ends, so no slice is gathered
        nth = F.col("rank") % F.lit(slice_rows)
        top = ranked.agg(F.max("rank")).first()[0]
        ends = ranked.where((nth == 0) | (nth == slice_rows - 1) | (F.col("rank") == F.lit(top))).withColumn("at", F.struct("depth", "path"))
        ends = ends.groupBy("slice").agg((F.max("rank") - F.min("rank") + 1).alias("n_rows"), F.min_by("at", "rank").alias("first"), F.max_by("at", "rank").alias("last"))
        ends.coalesce(1).write.mode(mode).parquet(f"{folder}/slices")  # one row a slice
    if "names" in tables:
        numbered_vocabulary(ranked).write.mode(mode).parquet(f"{folder}/names")
    _finish(spark, folder, posting, mode, part_slices, tables)


def write_names(snapshot: DataFrame, folder: str, posting: int = POSTING, mode: str = "errorifexists") -> None:
    """The names and postings alone, for what asks which names match and not where they are: no row is ranked and names know no slices."""
    names = snapshot.where(F.col("path") != P.ROOT).select(P.basename("path").alias("name")).distinct()
    ranks(names, ["name"], "name_id").write.mode(mode).parquet(f"{folder}/names")
    _finish(snapshot.sparkSession, folder, posting, mode, 1, ("names", "postings"))


def _finish(spark: SparkSession, folder: str, posting: int, mode: str, part_slices: int, tables: tuple[str, ...] = TABLES) -> None:
    """Postings of the names that stand in a folder, and the stamp."""
    if "postings" in tables:
        # sorted where they were gathered: a search reads the pages of its trigrams in each file, and the lists, far more rows than names, are not dealt again
        lists = postings(spark.read.parquet(f"{folder}/names").select("name", "name_id"), posting)
        lists.sortWithinPartitions("trigram", "block").write.mode(mode).parquet(f"{folder}/postings")
    held = _stamp(spark, folder) if "rows" in tables else (0, 0)
    spark.createDataFrame([(*held, posting, part_slices)], "n long, digest long, posting int, part_slices int").coalesce(1).write.mode(mode).parquet(f"{folder}/stamp")


def _part(part_slices: int) -> Column:
    return F.floor(F.col("slice") / F.lit(part_slices)).cast("int")


def index_rows(spark: SparkSession, folder: str, posting: int = POSTING, mode: str = "overwrite", part_slices: int = 1) -> None:
    """Make the index of the rows that stand in a folder."""
    rows = spark.read.parquet(f"{folder}/rows")
    ends = rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("depth", "path")).alias("first"), F.max(F.struct("depth", "path")).alias("last"))
    ends.coalesce(1).write.mode(mode).parquet(f"{folder}/slices")  # one row a slice
    numbered_vocabulary(rows).write.mode(mode).parquet(f"{folder}/names")
    _finish(spark, folder, posting, mode, part_slices)


def is_fresh(spark: SparkSession, folder: str) -> bool:
    """The index was made of the rows' files as they are."""
    stamp = spark.read.parquet(f"{folder}/stamp").first()
    return (stamp["n"], stamp["digest"]) == _stamp(spark, folder)


# What a pattern requires: None for nothing, a trigram, or ("and" | "or", parts).


def _all_of(parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _one_of(parts: list):
    if any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_text(text: str):
    """Trigrams of the ASCII runs of a literal text; other letters have several lower-case forms and require nothing."""
    runs = re.findall("[\x00-\x7f]{3,}", text.lower())
    return _all_of([run[k : k + 3] for run in runs for k in range(len(run) - 2)])


def _of_tree(items) -> object:
    """Walks the tree that Python's own parser makes of a regular expression; whatever it does not know requires nothing."""
    found, run = [], []

    def ended():
        found.append(_of_text("".join(run)))
        run.clear()

    for op, arg in items:
        kind = str(op)
        if kind == "LITERAL":
            run.append(chr(arg))
            continue
        if kind == "AT":
            continue
        ended()
        if kind == "SUBPATTERN":
            found.append(_of_tree(arg[-1]))
        elif kind == "ATOMIC_GROUP":
            found.append(_of_tree(arg))
        elif kind == "BRANCH":
            found.append(_one_of([_of_tree(way) for way in arg[1]]))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            found.append(_of_tree(arg[2]))
    ended()
    return _all_of(found)


def required(query: str, case_sensitive: bool = False):
    """What the trigrams of every name that the query matches must satisfy."""
    kind, pattern = Q._compiled(query, case_sensitive)
    return None if kind == "all" else _of_text(pattern) if kind == "text" else _of_tree(re._parser.parse(pattern))


def _leaves(need) -> set[str]:
    return {need} if isinstance(need, str) else set().union(*map(_leaves, need[1]))


def _held(need, lists: Column) -> Column:
    """The numbers of one block that satisfy a requirement."""
    if isinstance(need, str):
        return F.coalesce(lists[need], F.array().cast("array<int>"))
    return reduce(F.array_intersect if need[0] == "and" else F.array_union, [_held(p, lists) for p in need[1]])


def names_with(posted: DataFrame, need, posting: int = POSTING) -> DataFrame:
    """name_id of the names that satisfy a requirement: one row per trigram of a block meets, at most ``posting`` numbers each."""
    rows = posted.where(F.col("trigram").isin(sorted(_leaves(need))))
    blocks = rows.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "numbers"))).alias("lists"))
    held = blocks.select("block", F.explode(_held(need, F.col("lists"))).alias("number"))
    return held.select((F.col("block").cast("long") * posting + F.col("number")).alias("name_id"))


def matching_names(spark: SparkSession, folder: str, query: str, case_sensitive: bool = False) -> DataFrame:
    """The rows of ``names`` that a query on basenames matches; exact."""
    names, need = spark.read.parquet(f"{folder}/names"), required(query, case_sensitive)
    # the comparison tells the optimizer that this side is worth pruning by
    test = Q.compile_query(query, case_sensitive)("name") & (F.col("name") >= "")
    if need is None:
        return names.where(test)
    size = spark.read.parquet(f"{folder}/stamp").first()["posting"]
    return names.join(names_with(spark.read.parquet(f"{folder}/postings"), need, size), "name_id", "left_semi").where(test)


def pruned(spark: SparkSession, folder: str, slices: DataFrame) -> DataFrame:
    """The rows of some slices; files of the others are not opened. At most one number a slice is broadcast."""
    rows, wanted = spark.read.parquet(f"{folder}/rows"), slices.select("slice").distinct()
    if "part" in rows.columns:
        wanted = materialise(wanted, "wanted-slices")
        parts = wanted.select(_part(spark.read.parquet(f"{folder}/stamp").first()["part_slices"]).alias("part")).where("part >= 0").distinct()
        rows = rows.join(F.broadcast(parts), "part", "left_semi").drop("part")
    return rows.join(F.broadcast(wanted), "slice", "left_semi")


def candidate_rows(spark: SparkSession, folder: str, query: str, case_sensitive: bool = False) -> DataFrame:
    """The rows that can match: those of the slices that hold a matching name. A pattern with a slash spans names; for it and for an empty one all can."""
    if not query.strip() or Q.query_mode(query) == "path":
        return spark.read.parquet(f"{folder}/rows")
    return pruned(spark, folder, matching_names(spark, folder, query, case_sensitive).select(F.explode("row_groups").alias("slice")))


def indexed_search(spark: SparkSession, folder: str, query: str, case_sensitive: bool = False) -> DataFrame:
    """:func:`search.search` over a snapshot on disk, through its index if that is fresh."""
    rows = candidate_rows(spark, folder, query, case_sensitive) if is_fresh(spark, folder) else spark.read.parquet(f"{folder}/rows")
    return Q.search(rows, query, case_sensitive)


def browse(spark: SparkSession, folder: str, under: str = P.ROOT, min_depth: int = 0, max_depth: int = 0) -> DataFrame:
    """Rows of a subtree between two depths, from the slices whose range holds some of them."""
    ends = spark.read.parquet(f"{folder}/slices")
    at = lambda d, p: F.struct(d.alias("depth"), p.alias("path"))
    whole = under in ("", P.ROOT)
    low, high = (F.lit(""), F.lit("\U0010ffff")) if whole else (F.lit(under), F.lit(under + "0"))
    levels = ends.select("slice", "first", "last", F.explode(F.sequence(F.lit(min_depth), F.lit(max_depth))).alias("d"))
    some = levels.where((at(F.col("d"), low) <= F.col("last")) & (at(F.col("d"), high) >= F.col("first")))
    return pruned(spark, folder, some).where(P.in_depth("depth", min_depth, max_depth) & P.under("path", under))
