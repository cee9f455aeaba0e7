"""Comparing two snapshots.

One full outer join on the path classifies every row. A directory is descendable if it is one on both
sides and its (size, n_desc, n_children, mtime) differ. It is reached if all directories above it, below
the compared root, are descendable: an anti-join of its ancestors. A row is shown if its parent is
reached and it is not unchanged. No loop over levels, no reads per directory.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..steps import materialise

STATS = ["size", "n_desc", "n_children", "mtime"]


def differs(a, b) -> Column:
    """Null-safe inequality."""
    return ~P._col(a).eqNullSafe(P._col(b))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, kind_a, kind_b and both sides' statistics; one row per path and side, directories first.

    Both sides are dealt by path as plain rows and meet in one aggregation; paths hardly repeat, so nothing is combined before.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("path", "kind", *[(F.col(c) if c in df.columns else F.lit(None).cast("long")).alias(c) for c in STATS], F.lit(s).alias("__side"))

    rows = side(a, "a").unionByName(side(b, "b")).repartition("path")
    own = F.struct("kind", *STATS)
    both = rows.groupBy("path").agg(*[F.min(F.when(F.col("__side") == s, own)).alias(s) for s in "ab"])
    return both.select("path", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("kind", *STATS)])


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _status(swap: bool) -> Column:
    if swap:  # nothing and 0 are the same size here
        changed = differs(_zero("size_a"), _zero("size_b")) | differs(_zero("n_desc_a"), _zero("n_desc_b")) | (F.col("kind_a") != F.col("kind_b"))
    else:
        changed = differs("size_a", "size_b") | differs("n_desc_a", "n_desc_b")
    return F.when(F.col("kind_a").isNull(), "added").when(F.col("kind_b").isNull(), "removed").when(changed, "changed").otherwise("unchanged")


def _measured(df: DataFrame) -> DataFrame:
    return df.withColumn("size_delta", _zero("size_b") - _zero("size_a")).withColumn("n_desc_delta", _zero("n_desc_b") - _zero("n_desc_a"))


def compare_children(a: DataFrame, b: DataFrame, under: str = "") -> DataFrame:
    """One level: path, kind, status, both sizes and counts, deltas. A change of kind alone is no change."""
    rows = paired(P.children(a, under), P.children(b, under)).withColumn("status", _status(False))
    return _measured(rows).select("path", F.coalesce("kind_b", "kind_a").alias("kind"), "status", "size_a", "size_b", "n_desc_a", "n_desc_b", "size_delta", "n_desc_delta")


def _replay(queue: list[tuple[str, str, int]], budget: int, start: str = "") -> list[str]:
    """The first ``budget`` expansions in order, best first, over (path, parent, abs delta) rows. The start is one."""
    children: dict[str, list[tuple[str, int]]] = {}
    for path, parent, delta in sorted(queue):
        children.setdefault(parent, []).append((path, delta))
    heap, seq, done = [(0, 0, 0, start)], 0, []
    while heap and len(done) < budget:
        _, depth, _, at = heapq.heappop(heap)
        done.append(at)
        for path, delta in children.get(at, ()):
            seq += 1
            heapq.heappush(heap, (-delta, depth + 1, seq, path))
    return done


def _first_expansions(reached: DataFrame, budget: int) -> set[str]:
    """The paths that a best-first walk expands first: ``budget`` of them, the root ``''`` among them.

    ``reached``: path, parent, depth, gain of the directories that the walk can come to. What it expands goes by the bottleneck, the
    least gain on the way down from the start, and is settled in rounds:

    1. Directories above the last bottleneck that fits are all expanded; they are fewer than the budget.
    2. Of those that tie with it, each belongs to the nearest directory at or above it whose own gain is the tie. The walk
       takes these by depth, so depths are filled from counts; below the last depth all are taken.
    3. At the last depth they go in the order in which their parents were expanded, then by name. The parents are known from the first two
       steps and are replayed on the driver. They are taken, with what belongs to them, while the budget lasts.
    4. If it ends inside one of them, the next round starts there, with what is left.

    What comes to the driver is at most the budget, however many tie.
    """
    if budget <= 0:
        return set()
    done, start, left = {""}, "", budget - 1
    nodes = materialise(reached.select("path", "parent", "depth", "gain"), "can-expand")
    while left > 0:
        if nodes.limit(left + 1).count() <= left:
            return done | {r["path"] for r in nodes.select("path").collect()}
        above = nodes.select("path", F.explode(P.ancestors("path", own=True)).alias("up"))
        least = above.join(nodes.select(F.col("path").alias("up"), F.col("gain").alias("up_gain")), "up").groupBy("path").agg(F.min("up_gain").alias("bottleneck"))
        ranked = materialise(nodes.join(least, "path"), "bottlenecks")
        tie = ranked.orderBy(F.col("bottleneck").desc()).limit(left).agg(F.min("bottleneck")).first()[0]
        known = [(r["path"], r["parent"], r["gain"]) for r in ranked.where(F.col("bottleneck") > tie).select("path", "parent", "gain").collect()]
        ties = ranked.where(F.col("bottleneck") == tie)
        heads = ties.where(F.col("gain") == tie).select(F.col("path").alias("head"), F.col("depth").alias("head_depth"))
        belongs = ties.select("path", F.explode(P.ancestors("path", own=True)).alias("head")).join(heads, "head")
        nearest = belongs.groupBy("path").agg(F.max_by("head", "head_depth").alias("head"), F.max("head_depth").alias("head_depth"))
        ties = materialise(ties.join(nearest, "path"), "ties")
        room = left - len(known)
        for r in ties.groupBy("head_depth").agg(F.count(F.lit(1)).alias("n")).orderBy("head_depth").collect():  # one row a level
            last = r["head_depth"]
            if r["n"] > room:
                break
            room -= r["n"]
            last += 1
        known += [(r["path"], r["parent"], r["gain"]) for r in ties.where(F.col("head_depth") < last).select("path", "parent", "gain").collect()]
        order = _replay(known, len(known) + 1, start)
        done |= set(order)
        if not room:
            return done
        places = nodes.sparkSession.createDataFrame([(p, k) for k, p in enumerate(order)], "parent string, place long")
        level = ties.where(F.col("head_depth") == last)
        first = level.where("path = head").join(F.broadcast(places), "parent").orderBy("place", "path").limit(room).select("head", "place")  # at most the budget
        sizes = level.join(F.broadcast(first), "head").groupBy("place", "head").agg(F.count(F.lit(1)).alias("n")).orderBy("place", "head").collect()
        whole, start = [], None
        for r in sizes:
            if r["n"] > room:
                start = r["head"] if room else None
                break
            whole.append(r["head"])
            room -= r["n"]
        if whole:
            taken = nodes.sparkSession.createDataFrame([(p,) for p in whole], "head string")
            done |= {r["path"] for r in level.join(F.broadcast(taken), "head").select("path").collect()}
        if start is None:
            return done
        done.add(start)
        left = room - 1
        nodes = level.where((F.col("head") == start) & (F.col("path") != start)).select("path", "parent", "depth", "gain")
    return done


def recursive_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """path and size_delta of every path of either side."""
    return _measured(paired(a, b)).select("path", "size_delta")


def recursive_diff(a: DataFrame, b: DataFrame, budget: int | None = None, max_depth: int | None = None, include_unchanged: bool = False) -> DataFrame:
    """path, depth, kind, status, sizes, counts, deltas, expanded, pruned.

    With a ``budget`` directories are expanded by falling absolute delta (see :func:`_first_expansions`).
    """
    rows = paired(a, b).where(~F.col("path").isin("", P.ROOT))
    stats = [differs(f"{c}_a", f"{c}_b") for c in STATS]
    descend = (F.col("kind_a") == "dir") & (F.col("kind_b") == "dir") & (stats[0] | stats[1] | stats[2] | stats[3])
    rows = rows.select("path", F.coalesce("kind_b", "kind_a").alias("kind"), _status(True).alias("status"), "size_a", "size_b", "n_desc_a", "n_desc_b", F.coalesce(descend, F.lit(False)).alias("descend"))
    if not include_unchanged:  # what is neither changed nor a directory to enter is in no step below
        rows = rows.where("status <> 'unchanged' or descend")
    rows = materialise(rows, "diff-rows")  # one pairing, read by every step below; deltas, depth and parent follow from it

    dirs = _measured(rows.where("descend")).select("path", P.depth_of("path").alias("depth"), P.parent_of("path").alias("parent"), F.abs("size_delta").alias("gain"))
    up = dirs.select("path", F.explode(F.filter(P.ancestors("path"), lambda p: p != "")).alias("up"))
    cut = up.join(dirs.select(F.col("path").alias("up")), "up", "left_anti").select("path").distinct()
    reached = dirs.join(cut, "path", "left_anti")
    if max_depth is not None:
        reached = reached.where(F.col("depth") < max_depth)
    done = None if budget is None else _first_expansions(reached, budget)
    if done is None:
        opened = reached.select(F.col("path").alias("parent"))
    else:
        opened = F.broadcast(a.sparkSession.createDataFrame([(p,) for p in sorted(done - {""})], "parent string"))  # at most the budget
    placed = rows.withColumn("parent", P.parent_of("path"))
    shown = placed.where("parent <> ''").join(opened, "parent", "left_semi")
    if done is None or "" in done:
        shown = shown.unionByName(placed.where("parent = ''"))
    # a directory to enter whose parent is opened can be reached: all above it are directories to enter
    shown = _measured(shown).withColumn("depth", P.depth_of("path"))
    expanded = F.col("descend") if max_depth is None else F.col("descend") & (F.col("depth") < max_depth)
    if done is not None:
        shown = shown.join(opened.select(F.col("parent").alias("path"), F.lit(True).alias("done")), "path", "left")
        expanded = expanded & F.coalesce("done", F.lit(False))
    shown = shown.withColumn("expanded", expanded).withColumn("pruned", F.col("descend") & ~F.col("expanded"))
    if not include_unchanged:
        shown = shown.where("status <> 'unchanged' or pruned")
    return shown.select("path", "depth", "kind", "status", "size_a", "size_b", "n_desc_a", "n_desc_b", "size_delta", "n_desc_delta", "expanded", "pruned")


def extent(rows: DataFrame, budget: int | None = None) -> DataFrame:
    """expansions and truncated of a :func:`recursive_diff` with ``include_unchanged``: a budget or a depth cut it short."""
    opened = budget is None or budget > 0  # the root is an expansion too
    return rows.agg((F.count_if("expanded") + F.lit(int(opened))).cast("long").alias("expansions"), (F.coalesce(F.bool_or("pruned"), F.lit(False)) | F.lit(not opened)).alias("truncated"))


def by_change(df: DataFrame) -> DataFrame:
    return df.orderBy(F.abs("size_delta").desc(), "path")


def summarize(rows: DataFrame) -> DataFrame:
    """status, n_rows and size_delta of each status."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size_delta").cast("long").alias("size_delta"))


def total_change(a: DataFrame, b: DataFrame, path: str = P.ROOT) -> DataFrame:
    """Size and count of one subtree on both sides, whatever rows a diff shows."""
    rows = paired(a.where(F.col("path") == path), b.where(F.col("path") == path))
    return _measured(rows).select("path", "size_a", "size_b", "n_desc_a", "n_desc_b", "size_delta", "n_desc_delta")


def sets_equal(a: DataFrame, b: DataFrame) -> bool:
    """Both hold the same rows the same number of times."""
    b = b.select(*a.columns)
    return not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1)


def content_digest(df: DataFrame) -> DataFrame:
    """n_rows and an order-free checksum of all columns, taken in name order."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(df.columns))), F.lit(0)).alias("digest"))


def diff_weights(rows: DataFrame, mode: str = "max", gap_bytes: int = 1_000_000, gap_share: float = 0.002) -> DataFrame:
    """path, depth, status, size_delta, weight of a diff's rows, their missing parents and fillers.

    A leaf weighs max(a, b) (or abs(delta) in mode ``delta``), a parent the larger of its own weight and
    its children's sum. This goes level by level from the deepest; levels are few and each is one
    aggregation. Only rows that have children are joined and written, the others weigh what they weigh by themselves.
    Where rows tell that they are not ``expanded``, nothing is below them and they meet no join at all.
    Where children leave a gap a row ``<path>/(unchanged)`` fills it.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = F.greatest("size_a", "size_b") if mode == "max" else F.abs("size_delta")
    may = F.col("expanded") if "expanded" in rows.columns else F.lit(True)
    have = rows.select("path", "status", zero("size_a").alias("size_a"), zero("size_b").alias("size_b"), "size_delta", may.alias("may"))
    have = materialise(have.select("path", "status", "size_delta", own.cast("long").alias("own"), "may"), "diff-shown")
    placed = lambda df: df.select("path", P.depth_of("path").alias("depth"), P.parent_of("path").alias("parent"), "status", "size_delta", "own")
    # the distinct parents first: they are fewer than the rows, and what is above them is above the rows
    near = have.select(P.parent_of("path").alias("parent")).where("parent <> ''").distinct()
    inner = near.select(F.explode(P.ancestors("parent", own=True)).alias("path")).where("path <> ''").distinct().withColumn("above", F.lit(True))
    met = have.where("may").drop("may").join(inner, "path", "full_outer")  # both: has children; left only: a leaf; right only: a parent that is no row
    met = materialise(met.select("path", F.coalesce("status", F.lit("unchanged")).alias("status"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("size_delta", "own")], F.coalesce("above", F.lit(False)).alias("above")), "diff-inner")
    leaves = placed(have.where("not may")).unionByName(placed(met.where("not above"))).withColumn("kids", F.lit(None).cast("long")).withColumn("weight", F.greatest("own", F.lit(0)))
    from_leaves = leaves.groupBy(F.col("parent").alias("path")).agg(F.sum("weight").alias("from_leaves"))
    nodes = materialise(placed(met.where("above")).join(from_leaves, "path", "left"), "diff-nodes")
    out, sums = leaves, None
    for d in range(nodes.agg(F.max("depth")).first()[0] or 0, 0, -1):
        level = nodes.where(F.col("depth") == d)
        level = level.join(sums, "path", "left") if sums is not None else level.withColumn("from_nodes", F.lit(None).cast("long"))
        kids = F.coalesce(F.col("from_leaves") + F.col("from_nodes"), "from_leaves", "from_nodes")
        level = level.withColumn("kids", kids).withColumn("weight", F.greatest("own", F.coalesce("kids", F.lit(0)))).select(*leaves.columns)
        level = materialise(level, "diff-level")
        sums = level.groupBy(F.col("parent").alias("path")).agg(F.sum("weight").alias("from_nodes"))
        out = out.unionByName(level)
    cells = out.select("path", "depth", "status", "size_delta", "weight")
    if mode == "max":
        gap = F.col("weight") - F.col("kids")
        fill = out.where(F.col("kids").isNotNull() & (gap > F.greatest(F.lit(float(gap_bytes)), F.col("weight") * gap_share)))
        cells = cells.unionByName(fill.select(F.concat("path", F.lit("/(unchanged)")).alias("path"), (F.col("depth") + 1).alias("depth"), F.lit("filler").alias("status"), F.lit(0).cast("long").alias("size_delta"), gap.alias("weight")))
    return cells


def diverging(rows: DataFrame, column: str = "size_delta") -> DataFrame:
    """The rows with ``t``, the value over the largest absolute one, in [-1, 1]."""
    peak = rows.agg(F.max(F.abs(column)).alias("__peak"))
    top = peak.first()["__peak"] or 0
    return rows.withColumn("t", F.lit(0.0) if not top else F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(column) / F.lit(top))))
