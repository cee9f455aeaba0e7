"""Path algebra: columns over hierarchical keys.

Inside, the root's path is ``''``; in snapshots it is ``'.'`` with parent ``''`` and depth 0. Top-level
directories have parent ``'.'``, top-level files ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import materialise

ROOT = "."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_key(name) -> Column:
    """Runs of slashes become one, a trailing slash goes, a leading one stays."""
    n = _col(name)
    return F.when(is_sparse(n), F.regexp_replace(F.regexp_replace(n, "/+", "/"), "/$", "")).otherwise(n)


def is_sparse(name) -> Column:
    """The key is not in canonical form."""
    return F.contains(_col(name), F.lit("//")) | F.endswith(_col(name), F.lit("/"))


def parent_of(path) -> Column:
    """What stands before the last slash, else ``''``."""
    p = _col(path)
    return F.when(F.contains(p, F.lit("/")), F.substr(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1)).otherwise("")


def depth_of(path) -> Column:
    p = _col(path)
    return F.when((p == ROOT) | (p == ""), F.lit(0)).otherwise(F.length(p) - F.length(F.replace(p, F.lit("/"))) + 1).cast("int")


def basename(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def first_segment(path) -> Column:
    return F.split_part(_col(path), F.lit("/"), F.lit(1))


def ancestors(path, own: bool = False) -> Column:
    """All proper ancestors from the root ``''`` down; with ``own`` the path too. A leading slash is no level."""
    p = _col(path)
    # the k-th is what stands before the k-th slash; with a leading slash the first two are the same
    first = F.when(F.startswith(p, F.lit("/")), 1).otherwise(0)
    some = F.transform(F.sequence(first, F.length(p) - F.length(F.replace(p, F.lit("/")))), lambda k: F.call_function("substring_index", p, F.lit("/"), k))
    up = F.when(p == "", F.array().cast("array<string>")).otherwise(some)
    return F.concat(up, F.array(_col(path))) if own else up


def named(path) -> Column:
    """The outside name of an inside path."""
    p = _col(path)
    return F.when(p == "", ROOT).otherwise(p)


def bare(path) -> Column:
    """The inside path of an outside name."""
    p = _col(path)
    return F.when(p == ROOT, "").otherwise(p)


def dir_parent(path) -> Column:
    """The stored parent of a directory given by its inside path."""
    p = _col(path)
    return F.when(p == "", "").otherwise(named(parent_of(p)))


def uri_of(root: str, path) -> Column:
    p = _col(path)
    return F.when((p == ROOT) | (p == ""), F.lit(root)).otherwise(F.concat(F.lit(root + "/"), p))


def under(path, prefix: str) -> Column:
    """The path is ``prefix`` or below it: a range that Parquet statistics can prune."""
    p = _col(path)
    if prefix in ("", ROOT):
        return F.lit(True)
    return (p == prefix) | ((p >= prefix + "/") & (p < prefix + "0"))


def covers(prefix, path) -> Column:
    """Column form of :func:`under`: ``prefix`` covers ``path``."""
    a, p = _col(prefix), _col(path)
    return (p == a) | F.startswith(p, F.concat(a, F.lit("/")))


def in_depth(depth, least: int | None = None, most: int | None = None) -> Column:
    d, out = _col(depth), F.lit(True)
    if least is not None:
        out = out & (d >= least)
    return out & (d <= most) if most is not None else out


def subtree(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(under("path", prefix))


def outside(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows under none of a few prefixes."""
    for p in prefixes:
        df = df.where(~under("path", p))
    return df


def outside_of(df: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows under none of the ``path`` values of a table of any size."""
    keyed = df.withColumn("__up", F.explode(ancestors("path", own=True)))
    hit = keyed.join(prefixes.select(F.col("path").alias("__up")).distinct(), "__up", "left_semi").select("path").distinct()
    return df.join(hit, "path", "left_anti")


def children(df: DataFrame, prefix: str) -> DataFrame:
    """Direct children of a path, one row per name; of a file and a directory of one name the directory."""
    level = 1 if prefix in ("", ROOT) else prefix.count("/") + 2
    rows = df.where(under("path", prefix) & (depth_of("path") == level))
    return one_per_path(rows)


def one_per_path(df: DataFrame) -> DataFrame:
    """One row per path, directories first."""
    cols = [c for c in df.columns if c != "path"]
    best = df.groupBy("path").agg(F.min_by(F.struct(*cols), F.struct("kind", *[c for c in ("size", "uri") if c in cols])).alias("__r"))
    return best.select("path", *[F.col(f"__r.{c}").alias(c) for c in cols]).select(*df.columns)


def rebase(df: DataFrame, prefix: str, keep_root: bool = True) -> DataFrame:
    """A subtree with paths, parents and depths relative to ``prefix``; its own row becomes the root or goes."""
    rows = subtree(df, prefix)
    if prefix in ("", ROOT):
        return rows if keep_root else rows.where(F.col("path") != ROOT)
    cut = F.substr("path", F.lit(len(prefix) + 2))
    rows = rows.withColumn("path", F.when(F.col("path") == prefix, ROOT).otherwise(cut))
    up = parent_of("path")
    parent = F.when(F.col("path") == ROOT, "").when(up == "", F.when(F.col("kind") == "dir", ROOT).otherwise("")).otherwise(up)
    rows = rows.withColumn("parent", parent).withColumn("depth", depth_of("path"))
    return rows if keep_root else rows.where(F.col("path") != ROOT)


def graft(df: DataFrame, parent: str) -> DataFrame:
    """The inverse of :func:`rebase`: hang a tree under ``parent``."""
    p = F.when(F.col("path") == ROOT, F.lit(parent)).otherwise(F.concat(F.lit(parent + "/"), F.col("path")))
    up = F.col("parent")
    above = parent.rpartition("/")[0] or ROOT
    new = F.when(F.col("path") == ROOT, F.lit(above)).when(up.isin("", ROOT), F.lit(parent)).otherwise(F.concat(F.lit(parent + "/"), up))
    return df.withColumn("parent", new).withColumn("path", p).withColumn("depth", depth_of("path"))


def outermost(prefixes: DataFrame) -> DataFrame:
    """Prefixes that no other prefix covers."""
    return prefixes.join(nested(prefixes).select("path"), "path", "left_anti").select("path").distinct()


def nested(prefixes: DataFrame) -> DataFrame:
    """path, kept_by: dropped prefixes and the shallowest prefix that covers them."""
    own = prefixes.select("path").distinct()
    up = own.select("path", F.explode(ancestors("path")).alias("kept_by")).where("kept_by <> ''")
    hit = up.join(own.select(F.col("path").alias("kept_by")), "kept_by")
    return hit.groupBy("path").agg(F.min_by("kept_by", F.length("kept_by")).alias("kept_by"))


def chains(df: DataFrame) -> DataFrame:
    """path, chain_end, label for every directory: where its chain of only-child directories ends.

    Each round doubles the length of the jumps and is written to the shared folder; the last is the one in
    which nothing moves, whatever the length of the longest chain.
    """
    dirs = df.where("kind = 'dir'").select(bare("path").alias("path"), "n_children")
    only = dirs.join(df.where("kind = 'dir' and path <> '.'").select(bare("path").alias("next"), parent_of("path").alias("path")), "path").where("n_children = 1").select("path", "next")
    jump = dirs.select("path").join(only, "path", "left").select("path", F.coalesce("next", "path").alias("chain_end"))
    while True:
        far = jump.select(F.col("path").alias("chain_end"), F.col("chain_end").alias("far"))
        moved = materialise(jump.join(far, "chain_end").select("path", F.col("far").alias("chain_end"), (F.col("far") != F.col("chain_end")).alias("moved")), "chains")
        jump = moved.select("path", "chain_end")
        if not moved.where("moved").head(1):
            break
    start = F.when(F.col("path") == "", 1).otherwise(F.length(parent_of("path")) + F.when(parent_of("path") == "", 1).otherwise(2))
    return jump.select(named("path").alias("path"), named("chain_end").alias("chain_end"), F.when(F.col("chain_end") == "", ROOT).otherwise(F.substr("chain_end", start)).alias("label"))


#: Schemes whose host part is a bucket.
STORES = ["s3", "r2", "gcs", "az"]


def url_parts(url) -> Column:
    """struct<scheme, user, host, port, path> of a local path, URL or ``user@host:path``."""
    u = _col(url)
    remote = F.contains(u, F.lit("://"))
    scp = "^(?:([^@/:]+)@)?([^/:@]+):(.*)$"
    rest = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1)
    net, path = F.regexp_extract(rest, "^([^/]*)", 1), F.regexp_extract(rest, "^[^/]*([^?#]*)", 1)
    scheme = F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    store = scheme.isin(STORES)
    none = F.lit(None).cast("string")
    blank = lambda c: F.when(c == "", none).otherwise(c)
    short = ~remote & u.rlike(scp)
    user = F.when(short, blank(F.regexp_extract(u, scp, 1))).when(remote & ~store, blank(F.regexp_extract(net, "^([^@]*)@", 1)))
    host = F.when(short, F.regexp_extract(u, scp, 2)).when(store, net).when(remote, blank(F.lower(F.regexp_extract(net, "^(?:[^@]*@)?([^:]*)", 1))))
    port = F.when(remote & ~store, blank(F.regexp_extract(net, ":([0-9]+)$", 1))).cast("int")
    where = F.when(short, F.regexp_extract(u, scp, 3)).when(remote, path).otherwise(u)
    return F.struct(F.when(short, "ssh").when(remote, scheme).otherwise("file").alias("scheme"), user.alias("user"), host.alias("host"), port.alias("port"), where.alias("path"))


def _host(p: Column) -> Column:
    user = F.when(p["user"].isNotNull(), F.concat(p["user"], F.lit("@"))).otherwise("")
    port = F.when(p["port"].isNotNull(), F.concat(F.lit(":"), p["port"].cast("string"))).otherwise("")
    return F.concat(user, F.coalesce(p["host"], F.lit("")), port)


def canonical_url(url) -> Column:
    p = url_parts(url)
    cut = F.regexp_replace(p["path"], "/+$", "")
    local = F.when(cut == "", "/").otherwise(cut)
    return F.when(p["scheme"] == "file", local).when(p["scheme"].isin(["ssh", *STORES]), F.concat(p["scheme"], F.lit("://"), _host(p), cut)).otherwise(_col(url))


def url_parent(url) -> Column:
    """The URL one segment up, null at a root; a bucket root has no trailing slash."""
    p = url_parts(url)
    up = F.regexp_extract(p["path"], "(?s)^(.*)/[^/]*$", 1)
    at_root = p["path"].isin("", "/")
    return F.when(at_root, F.lit(None).cast("string")).when(p["scheme"] == "file", F.when(up == "", "/").otherwise(up)).otherwise(F.concat(p["scheme"], F.lit("://"), _host(p), up))
