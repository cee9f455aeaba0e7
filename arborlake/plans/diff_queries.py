"""Queries over two snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, digest, rollup
from . import fixtures as X
from ._register import registrar

QUERIES: dict = {}
query = registrar(QUERIES)

_PAIR = f"""{X.TWO}, j AS MATERIALIZED (SELECT coalesce(a.path, b.path) AS path, coalesce(b.kind, a.kind) AS kind, a.size AS size_a, b.size AS size_b, a.n_desc AS n_desc_a, b.n_desc AS n_desc_b,
  coalesce(b.size, 0) - coalesce(a.size, 0) AS size_delta, coalesce(b.n_desc, 0) - coalesce(a.n_desc, 0) AS n_desc_delta, CAST(coalesce(a.depth, b.depth) AS INT) AS depth,
  CASE WHEN contains(coalesce(a.path, b.path), '/') THEN regexp_replace(coalesce(a.path, b.path), '/[^/]*$', '') ELSE '' END AS up,
  CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.size <> b.size OR a.n_desc <> b.n_desc THEN 'changed' ELSE 'unchanged' END AS status,
  coalesce(a.kind = 'dir' AND b.kind = 'dir' AND (a.size <> b.size OR a.n_desc <> b.n_desc OR a.n_children <> b.n_children OR a.mtime <> b.mtime), false) AS descend
  FROM sa a FULL OUTER JOIN sb b ON a.path = b.path AND a.kind = b.kind)"""
_COLUMNS = "path, kind, status, size_a, size_b, n_desc_a, n_desc_b, size_delta, n_desc_delta"
# reachable by levels: a top directory that is descendable, then descendable children of reachable ones
_REACH = f"""{_PAIR}, r1 AS (SELECT path FROM j WHERE depth = 1 AND descend), r2 AS (SELECT j.path FROM j JOIN r1 ON j.up = r1.path WHERE descend), r3 AS (SELECT j.path FROM j JOIN r2 ON j.up = r2.path WHERE descend),
r4 AS (SELECT j.path FROM j JOIN r3 ON j.up = r3.path WHERE descend), reach AS MATERIALIZED (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)"""
# every row with whether it and its parent are reachable; a path stands twice in j if it changed its kind
_FLAGS = f"""{_REACH}, one AS MATERIALIZED (SELECT DISTINCT path FROM reach), fl AS MATERIALIZED (SELECT j.*, r.path IS NOT NULL AS reached, j.up = '' OR u.path IS NOT NULL AS shown FROM j LEFT JOIN one r ON j.path = r.path LEFT JOIN one u ON j.up = u.path WHERE j.path <> '.')"""
_SHOWN = f"SELECT {_COLUMNS}, depth, reached AS expanded, false AS pruned FROM fl WHERE shown"
# the same with a part of the reachable directories opened
_CUT = f"oj AS MATERIALIZED (SELECT fl.*, o.path IS NOT NULL AS opened, fl.up = '' OR p.path IS NOT NULL AS under FROM fl LEFT JOIN o ON fl.path = o.path LEFT JOIN o p ON fl.up = p.path) SELECT {_COLUMNS}, depth, opened AS expanded, reached AND NOT opened AS pruned FROM oj WHERE under AND (status <> 'unchanged' OR (reached AND NOT opened))"


@query(f"WITH {_PAIR} SELECT {_COLUMNS} FROM j WHERE up = 'ASIA'")
def diff_children(spark, sf_dir):
    return diff.compare_children(*X.two_snapshots(spark, sf_dir), "ASIA")


@query(f"WITH {_FLAGS} {_SHOWN} AND status <> 'unchanged'")
def diff_recursive(spark, sf_dir):
    return diff.recursive_diff(*X.two_snapshots(spark, sf_dir))


@query(f"WITH {_FLAGS} {_SHOWN}")
def diff_with_unchanged(spark, sf_dir):
    return diff.recursive_diff(*X.two_snapshots(spark, sf_dir), include_unchanged=True)


@query(f"WITH {_FLAGS}, o AS MATERIALIZED (SELECT DISTINCT path FROM r1), {_CUT}")
def diff_max_depth(spark, sf_dir):
    return diff.recursive_diff(*X.two_snapshots(spark, sf_dir), max_depth=2)


@query(f"""WITH {_FLAGS}, g AS MATERIALIZED (SELECT path, up, depth, abs(size_delta) AS gain FROM fl WHERE reached AND depth < 3),
b AS (SELECT path, gain AS bottleneck FROM g WHERE depth = 1 UNION ALL SELECT g.path, least(g.gain, u.gain) FROM g JOIN g u ON g.up = u.path WHERE g.depth = 2),
o AS MATERIALIZED (SELECT path FROM b ORDER BY bottleneck DESC, path LIMIT 9), {_CUT}""")
def diff_budget(spark, sf_dir):
    """Ten expansions, the root and nine more; deltas fall with depth here, so all are of depth 1 and 2."""
    return diff.recursive_diff(*X.two_snapshots(spark, sf_dir), budget=10)


@query(f"WITH {_REACH}, n AS (SELECT count(*) AS n FROM reach) SELECT CAST(least(10, n + 1) AS BIGINT) AS expansions, n > 9 AS truncated FROM n")
def diff_extent(spark, sf_dir):
    """How far a budget of ten expansions comes, and that it cut the diff."""
    return diff.extent(diff.recursive_diff(*X.two_snapshots(spark, sf_dir), budget=10, include_unchanged=True), 10)


@query(f"WITH {_FLAGS} SELECT status, count(*) AS n_rows, CAST(sum(size_delta) AS BIGINT) AS size_delta FROM ({_SHOWN}) GROUP BY 1")
def diff_summary(spark, sf_dir):
    return diff.summarize(diff.recursive_diff(*X.two_snapshots(spark, sf_dir), include_unchanged=True))


@query(f"WITH {_PAIR} SELECT path, size_a, size_b, n_desc_a, n_desc_b, size_delta, n_desc_delta FROM j WHERE path = '.'")
def diff_total(spark, sf_dir):
    return diff.total_change(*X.two_snapshots(spark, sf_dir))


@query(f"WITH {_PAIR} SELECT {_COLUMNS} FROM j WHERE up = 'ASIA/NATION_12' ORDER BY abs(size_delta) DESC, path LIMIT 3")
def diff_by_change(spark, sf_dir):
    return diff.by_change(diff.compare_children(*X.two_snapshots(spark, sf_dir), "ASIA/NATION_12")).limit(3)


@query(f"WITH {_PAIR}, d AS (SELECT path, size_delta FROM j WHERE depth = 3) SELECT path, size_delta, round(size_delta::DOUBLE / (SELECT max(abs(size_delta)) FROM d), 9) AS t FROM d")
def diverging_scale(spark, sf_dir):
    a, b = (s.where("depth = 3") for s in X.two_snapshots(spark, sf_dir))
    rows = diff.recursive_rows(a, b)
    return diff.diverging(rows).select("path", "size_delta", F.round("t", 9).alias("t"))


@query(f"""WITH {_FLAGS}, s0 AS MATERIALIZED (SELECT path, up, status, size_delta, greatest(coalesce(size_a, 0), coalesce(size_b, 0)) AS own, depth FROM ({_SHOWN.replace("SELECT path,", "SELECT path, up,", 1)} AND status <> 'unchanged')),
anc AS (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path FROM s0),
s AS MATERIALIZED (SELECT * FROM s0 UNION ALL SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END, 'unchanged', 0, 0, CAST(length(path) - length(replace(path, '/', '')) + 1 AS INT) FROM anc WHERE path NOT IN (SELECT path FROM s0)),
w5 AS MATERIALIZED (SELECT *, own AS weight, NULL::BIGINT AS kids FROM s WHERE depth = 5), k5 AS (SELECT up AS path, CAST(sum(weight) AS BIGINT) AS kids FROM w5 GROUP BY 1),
w4 AS MATERIALIZED (SELECT s.*, greatest(own, coalesce(k.kids, 0)) AS weight, k.kids FROM s LEFT JOIN k5 k ON s.path = k.path WHERE depth = 4), k4 AS (SELECT up AS path, CAST(sum(weight) AS BIGINT) AS kids FROM w4 GROUP BY 1),
w3 AS MATERIALIZED (SELECT s.*, greatest(own, coalesce(k.kids, 0)) AS weight, k.kids FROM s LEFT JOIN k4 k ON s.path = k.path WHERE depth = 3), k3 AS (SELECT up AS path, CAST(sum(weight) AS BIGINT) AS kids FROM w3 GROUP BY 1),
w2 AS MATERIALIZED (SELECT s.*, greatest(own, coalesce(k.kids, 0)) AS weight, k.kids FROM s LEFT JOIN k3 k ON s.path = k.path WHERE depth = 2), k2 AS (SELECT up AS path, CAST(sum(weight) AS BIGINT) AS kids FROM w2 GROUP BY 1),
w1 AS MATERIALIZED (SELECT s.*, greatest(own, coalesce(k.kids, 0)) AS weight, k.kids FROM s LEFT JOIN k2 k ON s.path = k.path WHERE depth = 1), w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4 UNION ALL SELECT * FROM w5)
SELECT path, depth, status, size_delta, weight FROM w UNION ALL SELECT path || '/(unchanged)', CAST(depth + 1 AS INT), 'filler', 0, weight - kids FROM w WHERE kids IS NOT NULL AND weight - kids > greatest(20.0, weight * 0.002)""")
def diff_tree_weights(spark, sf_dir):
    rows = diff.recursive_diff(*X.two_snapshots(spark, sf_dir))
    return diff.diff_weights(rows, gap_bytes=20)


@query(f"WITH {X.TWO} SELECT (SELECT count(*) FROM fa) = (SELECT count(*) FROM (SELECT DISTINCT path FROM fa)) AS same_as_itself, false AS same_as_other, (SELECT count(*) FROM sa) AS n_rows FROM (SELECT 1)")
def snapshot_equality(spark, sf_dir):
    a, b = X.two_snapshots(spark, sf_dir)
    again = rollup.rollup_listing(X.two_listings(spark, sf_dir)[0].repartition(7), X.SCHEME)
    digests = [diff.content_digest(x).first() for x in (a, again, b)]
    return a.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(digests[0] == digests[1]).alias("same_as_itself"), F.lit(digests[0] == digests[2]).alias("same_as_other"), "n_rows")


@query(f"WITH {X.TWO}, d AS (SELECT a.path FROM sa a EXCEPT SELECT b.path FROM sb b) SELECT (SELECT count(*) FROM d) AS only_a, (SELECT count(*) FROM (SELECT path FROM sa INTERSECT SELECT path FROM sb)) AS both FROM (SELECT 1)")
def path_sets(spark, sf_dir):
    a, b = (s.select("path") for s in X.two_snapshots(spark, sf_dir))
    only, both = a.exceptAll(b).select(F.lit(1).alias("a"), F.lit(0).alias("b")), a.intersect(b).select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    return only.unionByName(both).agg(F.sum("a").alias("only_a"), F.sum("b").alias("both"))


_MOVED = f"""{X.OBJECTS}, m AS (SELECT name, size, string_split(name, '/') AS p FROM objects),
r AS MATERIALIZED (SELECT DISTINCT CASE p[1] WHEN 'AFRICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'MIDDLE EAST' THEN 3 ELSE 4 END AS d, array_to_string(p[1:CASE p[1] WHEN 'AFRICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'MIDDLE EAST' THEN 3 ELSE 4 END], '/') AS path_from,
  CASE p[1] WHEN 'AFRICA' THEN 'OLD/AFRICA' WHEN 'ASIA' THEN 'EUROPE/' || p[2] WHEN 'MIDDLE EAST' THEN p[1] || '/' || p[2] || '/was-' || p[3] ELSE p[1] || '/' || p[2] || '/' || p[3] || '/done-' || p[4] END AS path_to
  FROM m WHERE p[1] IN ('AFRICA', 'ASIA', 'MIDDLE EAST') OR (p[1] = 'AMERICA' AND CAST(p[4] AS BIGINT) % 5 = 0))"""


def _moved_listing(rows):
    """A region, the nations of another, the segments of a third and a fifth of the orders of a fourth get other paths."""
    p = F.split("name", "/")
    done = (p[0] == "AMERICA") & (F.pmod(F.try_element_at(p, F.lit(4)).cast("long"), F.lit(5)) == 0)
    name = F.when(p[0] == "AFRICA", F.concat(F.lit("OLD/"), F.col("name"))).when(p[0] == "ASIA", F.concat(F.lit("EUROPE/"), F.substr("name", F.lit(6))))
    name = name.when(p[0] == "MIDDLE EAST", F.concat_ws("/", p[0], p[1], F.concat(F.lit("was-"), p[2]), p[3], p[4])).when(done, F.concat_ws("/", p[0], p[1], p[2], F.concat(F.lit("done-"), p[3]), p[4]))
    return rows.withColumn("name", name.otherwise(F.col("name")))


@query(f"WITH {_MOVED} SELECT path_from, path_to, CAST(sum(m.size) AS BIGINT) AS size, count(*) AS n_files FROM r JOIN m ON array_to_string(p[1:d], '/') = path_from GROUP BY 1, 2")
def renamed_subtrees(spark, sf_dir):
    """Directories of four levels move; equal digests find the pairs, and only the highest are told."""
    rows = X.objects(spark, sf_dir)
    return digest.moved(*[digest.directory_digests(rollup.listing_rows(x)) for x in (rows, _moved_listing(rows))])


@query(f"""WITH {X.OBJECTS}, up AS (SELECT name, size, unnest(list_transform(range(len(string_split(name, '/'))), lambda i: array_to_string(string_split(name, '/')[1:i], '/'))) AS dir FROM objects),
c AS MATERIALIZED (SELECT dir, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files, sha256(string_agg(substr(name, CASE WHEN dir = '' THEN 1 ELSE length(dir) + 2 END) || ':' || size, chr(10) ORDER BY substr(name, CASE WHEN dir = '' THEN 1 ELSE length(dir) + 2 END), size)) AS content FROM up GROUP BY dir),
g AS (SELECT content, count(*) AS n_equal, min(CASE WHEN dir = '' THEN '.' ELSE dir END) AS first_equal FROM c GROUP BY 1)
SELECT CASE WHEN dir = '' THEN '.' ELSE dir END AS path, size, n_files, n_equal, first_equal FROM c JOIN g USING (content)""")
def subtree_digests(spark, sf_dir):
    """Which directories hold the same, by Merkle digests here and by whole contents in SQL."""
    found = digest.directory_digests(rollup.listing_rows(X.objects(spark, sf_dir)))
    return digest.equal_groups(found).select("path", "size", "n_files", "n_equal", "first_equal")
