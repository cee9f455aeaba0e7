"""Name search: compiled queries, outermost matches, their sums at every ancestor. ``index`` has the index of names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..steps import materialise

_SLASHED = re.compile(r"/(.*)/([gimsuy]*)")


def _valid(pattern: str, flags: str) -> bool:
    """Both Python's and the JVM's regular expressions accept it."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    spark = SparkSession.getActiveSession()
    if spark is None:
        return True
    try:
        spark.range(1).select(F.lit("").rlike(flags + pattern)).collect()
    except SparkRuntimeException as e:
        if (e.getCondition() or "").startswith("INVALID_PARAMETER_VALUE"):
            return False
        raise
    return True


def _compiled(query: str, case_sensitive: bool) -> tuple[str, str]:
    """('all' | 'regex' | 'text', pattern)."""
    q = query.strip()
    if not q:
        return "all", ""
    if m := _SLASHED.fullmatch(q):
        on = sorted(set(m[2]) & set("sm") | ({"i"} if "i" in m[2] or not case_sensitive else set()))
        flags = f"(?{''.join(on)}{'u' if 'i' in on else ''})" if on else ""
        if _valid(m[1], flags):
            return "regex", flags + m[1]
    return "text", q


def compile_query(query: str, case_sensitive: bool = False) -> Callable[[Column], Column]:
    """``/pattern/flags`` is a regular expression, anything else a substring; nothing matches all.

    Flags i, s and m count, g, u and y do not. An invalid pattern is a substring, slashes included.
    """
    kind, pattern = _compiled(query, case_sensitive)
    if kind == "all":
        return lambda c: F.lit(True)
    if kind == "regex":
        return lambda c: F.coalesce(P._col(c).rlike(pattern), F.lit(False))
    if case_sensitive:
        return lambda c: F.coalesce(F.contains(P._col(c), F.lit(pattern)), F.lit(False))
    return lambda c: F.coalesce(F.contains(F.lower(P._col(c)), F.lit(pattern.lower())), F.lit(False))


def query_mode(query: str) -> str:
    """``path`` if the pattern has a slash, else ``segment``: what the query is tested on."""
    kind, pattern = _compiled(query, True)
    if kind == "all":
        return "segment"
    body = query.strip()[1 : query.strip().rindex("/")] if kind == "regex" else pattern
    return "path" if "/" in body else "segment"


def _tests(query: str, case_sensitive: bool) -> Callable[[Column], Column]:
    """What the query tests, as a function of a path: the whole of it or its basename."""
    test = compile_query(query, case_sensitive)
    return test if query_mode(query) == "path" else lambda path: test(P.basename(path))


def matches(snapshot: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Rows (without the root) that the query matches, with ``depth`` derived from the path."""
    return snapshot.where((F.col("path") != P.ROOT) & _tests(query, case_sensitive)(F.col("path"))).withColumn("depth", P.depth_of("path"))


def outermost(found: DataFrame) -> DataFrame:
    """Matches that have no matched directory above them, so that no byte counts twice."""
    # semi- and anti-joins pass over repeats, so no task holds a table of distinct paths
    dirs = found.where("kind = 'dir'").select(F.col("path").alias("__up"))
    inner = found.select("path", F.explode(P.ancestors("path")).alias("__up")).join(dirs, "__up", "left_semi").select("path")
    return found.join(inner, "path", "left_anti")


def search(snapshot: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Outermost matches. Only a match below a path that the query matches too has to meet the directories; the others pass without a join."""
    cols = ["path", "depth", "kind", "size"]
    found = matches(snapshot, query, case_sensitive).withColumn("size", F.coalesce("size", F.lit(0))).select(*cols)
    test = _tests(query, case_sensitive)
    found = found.withColumn("__above", F.filter(P.ancestors("path"), lambda p: (p != "") & test(p)))
    found = materialise(found, "matches")  # the snapshot is read once
    below = found.where(F.size("__above") > 0)
    dirs = found.where("kind = 'dir'").select(F.col("path").alias("__up"))
    inner = below.select("path", F.explode("__above").alias("__up")).join(dirs, "__up", "left_semi").select("path")
    return found.where(F.size("__above") == 0).select(*cols).unionByName(below.select(*cols).join(inner, "path", "left_anti"))


def filter_rollup(snapshot: DataFrame, query: str, display_depth: int = 4, case_sensitive: bool = False) -> DataFrame:
    """path, depth, kind, size, n_matches, matched: matches and their ancestors down to ``display_depth``."""
    found = search(snapshot, query, case_sensitive)
    up = found.select("size", F.explode(F.slice(P.ancestors("path"), F.lit(2), F.lit(display_depth))).alias("path"))
    above = up.groupBy("path").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_matches"))
    above = above.select("path", P.depth_of("path").alias("depth"), F.lit("dir").alias("kind"), "size", "n_matches", F.lit(False).alias("matched"))
    own = found.where(F.col("depth") <= display_depth).select("path", "depth", "kind", "size", F.lit(1).cast("long").alias("n_matches"), F.lit(True).alias("matched"))
    return above.unionByName(own)


def filter_totals(snapshot: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """total_size, n_matches over all depths, and max_depth_scanned."""
    found = search(snapshot, query, case_sensitive).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"), F.count(F.lit(1)).alias("n_matches"))
    deepest = snapshot.agg(F.max(P.depth_of("path"))).first()[0] or 0
    return found.withColumn("max_depth_scanned", F.lit(int(deepest)))


def filter_progress(snapshot: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """depth, n_matches, total_size: what is known after each depth, shallow first."""
    levels = snapshot.select(P.depth_of("path").alias("depth")).where("depth > 0").distinct()
    by = search(snapshot, query, case_sensitive).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    so_far = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # one row per depth
    rows = levels.join(by, "depth", "left")
    return rows.select("depth", F.sum(F.coalesce("n", F.lit(0))).over(so_far).alias("n_matches"), F.sum(F.coalesce("s", F.lit(0))).over(so_far).alias("total_size"))


def filter_tree(nodes: DataFrame) -> DataFrame:
    """The nodes with ``parent``, the nearest ancestor among them (``.`` for none), and ``expandable``."""
    up = nodes.select("path", F.explode(P.ancestors("path")).alias("__up"))
    near = up.join(nodes.select(F.col("path").alias("__up")).distinct(), "__up").groupBy("path").agg(F.max_by("__up", F.length("__up")).alias("parent"))
    return nodes.join(near, "path", "left").withColumn("parent", F.coalesce("parent", F.lit(P.ROOT))).withColumn("expandable", F.col("matched") & (F.col("kind") == "dir"))


def top_matches(nodes: DataFrame, n: int) -> DataFrame:
    """The largest ``n`` nodes, shown in (depth, path) order."""
    return nodes.orderBy(F.col("size").desc(), "path", F.col("matched").desc()).limit(n).orderBy("depth", "path", "matched")
