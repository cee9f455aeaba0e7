"""Slices of a snapshot shaped for display: browse, remainders, folding, row limits, nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..steps import materialise


def browse(snapshot: DataFrame, under: str = "", depth: int = 2) -> DataFrame:
    """The root, its children and what is ``depth`` levels deep or less, relative to ``under``."""
    level = 0 if under in ("", P.ROOT) else under.count("/") + 1
    rows = snapshot.where(P.in_depth("depth", level, level + depth) & P.under("path", under))
    return P.rebase(rows, under).where(F.col("depth") <= depth)


def limit_rows(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` largest rows and every directory above one of them."""
    top = rows.where(F.col("path") != P.ROOT).orderBy(F.col("size").desc(), "path", "kind").limit(most)
    up = top.select(F.explode(P.ancestors("path")).alias("path")).where("path <> ''").distinct()
    above = rows.where("kind = 'dir'").join(up, "path", "left_semi").join(top.where("kind = 'dir'").select("path"), "path", "left_anti")
    return top.unionByName(above)


def by_size(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("size").desc(), "path")


def sort_rows(rows: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Order by several columns, each ascending or not; directories and files of one key by path."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys], "path")


def with_remainders(rows: DataFrame, gap: int = 1_000_000) -> DataFrame:
    """path, parent, label, size, placeholder: nodes, and ``…`` where children fall short of their parent by more than ``gap``."""
    parent = P.named(F.coalesce("parent", F.lit("")))
    nodes = rows.where(F.col("path") != P.ROOT).select("path", parent.alias("parent"), P.basename("path").alias("label"), F.coalesce("size", F.lit(0)).alias("size"), F.lit(False).alias("placeholder"))
    shown = nodes.groupBy("parent").agg(F.sum("size").alias("shown"))
    own = rows.where("kind = 'dir'").select(F.col("path").alias("parent"), F.col("size").alias("whole"))
    rest = shown.join(own, "parent").where(F.col("whole") - F.col("shown") > gap)
    rest = rest.select(F.concat("parent", F.lit("/__other__")).alias("path"), "parent", F.lit("…").alias("label"), (F.col("whole") - F.col("shown")).alias("size"), F.lit(True).alias("placeholder"))
    return nodes.unionByName(rest)


def fold_small(items: DataFrame, width: float, height: float, least_area: float = 16.0, by: list[str] | None = None) -> DataFrame:
    """Items (path, size) of each group; two or more whose share of the area is too small become one ``(+n)``."""
    keys = by or []
    seen = items.where("size > 0")
    total = seen.groupBy(*keys).agg(F.sum("size").alias("__total")) if keys else None
    if keys:
        rows = seen.join(total, keys)
    else:
        whole = seen.agg(F.sum("size")).first()[0] or 0
        rows = seen.withColumn("__total", F.lit(int(whole)))
    rows = rows.withColumn("__tiny", F.col("size") * F.lit(width * height) / F.col("__total") < least_area)
    counts = rows.where("__tiny").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__size"))
    if keys:
        rows = rows.join(counts.select(*keys, "__n"), keys, "left")
    else:
        rows = rows.withColumn("__n", F.lit(rows.where("__tiny").count()))
    fold = F.col("__tiny") & (F.coalesce("__n", F.lit(0)) >= 2)
    kept = rows.where(~fold).select(*keys, "path", "size", F.lit(1).cast("long").alias("n_items"))
    folded = counts.where("__n >= 2").select(*keys, F.concat(F.lit("(+"), F.col("__n").cast("string"), F.lit(")")).alias("path"), F.col("__size").alias("size"), F.col("__n").alias("n_items"))
    return kept.unionByName(folded)


def nested_json(snapshot: DataFrame, depth: int = 2) -> DataFrame:
    """path and ``tree``: {name, size, n_desc, children} as JSON for each top-level row, ``depth`` levels deep.

    Levels are put together from the deepest up; a level is one aggregation by parent.
    """
    rows = snapshot.where((F.col("path") != P.ROOT) & (P.depth_of("path") <= depth))
    rows = rows.select("path", "kind", P.depth_of("path").alias("depth"), P.parent_of("path").alias("parent"), P.basename("path").alias("name"), "size", "n_desc")
    rows = materialise(rows, "nested")  # read once a level
    kids = None
    for d in range(depth, 0, -1):
        level = rows.where(F.col("depth") == d)
        fields = [F.col("name"), F.col("size"), F.col("n_desc")]
        if kids is not None:
            dirs = level.where("kind = 'dir'").join(kids, "path", "left")
            level = dirs.unionByName(level.where("kind <> 'dir'").withColumn("children", F.lit(None).cast(kids.schema["children"].dataType)))
            fields.append(F.col("children"))
        node = F.struct(*fields)
        if d == 1:
            return level.select("path", F.to_json(node).alias("tree"))
        kids = level.groupBy(F.col("parent").alias("path")).agg(F.sort_array(F.collect_list(node)).alias("children"))
    return rows.select("path", F.lit("").alias("tree")).limit(0)


def stalest(snapshot: DataFrame, now: float, n: int, least_depth: int = 1) -> DataFrame:
    """path, size, mtime_mean, tb_years: what is large and old, first."""
    rows = snapshot.where(P.depth_of("path") >= least_depth).select("path", "kind", "size", "mtime_mean", S.staleness("size", "mtime_mean", F.lit(now)).alias("tb_years"))
    return rows.where("tb_years is not null").orderBy(F.col("tb_years").desc(), "path", "kind").limit(n)


def unplottable(snapshot: DataFrame, now: float) -> DataFrame:
    """n_rows, n_plottable and n_left_out: rows whose size or age has no place on a log axis."""
    fine = F.coalesce((F.col("size") > 0) & (F.lit(now) - F.col("mtime_mean") > 0), F.lit(False))
    return snapshot.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(fine).alias("n_plottable"), F.count_if(~fine).alias("n_left_out"))


def decade_counts(rows: DataFrame, column: str) -> DataFrame:
    """decade and n_rows of the positive values."""
    return rows.where(F.col(column) > 0).groupBy(F.floor(F.log10(column)).cast("long").alias("decade")).agg(F.count(F.lit(1)).alias("n_rows"))


def log_axis(rows: DataFrame, column: str) -> DataFrame:
    """lo and hi, snapped to decades, of the positive values; none gives no row."""
    ends = rows.where(F.col(column) > 0).agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a is not null")
    return ends.select(S.log_domain("a", "b").alias("d")).select(F.col("d")[0].alias("lo"), F.col("d")[1].alias("hi"))


def score_decades(rows: DataFrame, column: str, most: int = 5) -> DataFrame:
    """decade: powers of ten strictly inside the positive values' range, at most ``most``."""
    ends = rows.where(F.col(column) > 0).agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return ends.select(F.explode(S.decades_between("a", "b", most)).alias("decade"))


