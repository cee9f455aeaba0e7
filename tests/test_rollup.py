"""Rollups against hand-computed rows and a plain-Python walk."""

from collections import defaultdict
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from arborlake.operators import rollup as R

LISTING = "bucket string, name string, size_bytes long, created timestamp, storage_class_id int"


def listing(spark, rows):
    return spark.createDataFrame([("b1", n, s, datetime(2026, 7, d, tzinfo=UTC) if d else None, c) for n, s, d, c in rows], LISTING)


def simple(spark, names):
    return listing(spark, [(n, s, None, 0) for n, s in names])


def by_path(df, *cols):
    return {(r["path"], r["kind"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_small_tree(spark):
    out = R.rollup_listing(simple(spark, [("a.txt", 100), ("sub/b.txt", 200), ("sub/c.txt", 300), ("sub/deep/d.txt", 400)]), "gcs://b1")
    got = by_path(out, "size", "parent", "uri", "n_desc", "n_files", "n_children", "depth")
    assert got == {
        (".", "dir"): (1000, "", "gcs://b1", 7, 4, 2, 0),
        ("a.txt", "file"): (100, "", "gcs://b1/a.txt", 1, 1, 0, 1),
        ("sub", "dir"): (900, ".", "gcs://b1/sub", 5, 3, 3, 1),
        ("sub/b.txt", "file"): (200, "sub", "gcs://b1/sub/b.txt", 1, 1, 0, 2),
        ("sub/c.txt", "file"): (300, "sub", "gcs://b1/sub/c.txt", 1, 1, 0, 2),
        ("sub/deep", "dir"): (400, "sub", "gcs://b1/sub/deep", 2, 1, 1, 2),
        ("sub/deep/d.txt", "file"): (400, "sub/deep", "gcs://b1/sub/deep/d.txt", 1, 1, 0, 3),
    }


EDGES = [("x/1", 1), ("x/2", 2), ("top", 5), ("p/q/r/s/t/u", 7), ("a//b", 11), ("café/résumé.pdf", 13), ("日本語/データ.csv", 17), (".hidden/.x", 0), *[(f"wide/f{i}", i) for i in range(20)], ("one/file", 3), ("/lead/x", 2), ("x", 9), ("dup/k", 1), ("dup//k", 4)]


def test_edge_names_against_a_plain_walk(spark):
    out = by_path(R.rollup_listing(simple(spark, EDGES), "s"), "size", "n_desc", "n_files", "n_children")
    size, files, dirs, kids = defaultdict(int), defaultdict(int), {""}, defaultdict(int)
    clean = []
    for n, s in EDGES:
        while "//" in n:
            n = n.replace("//", "/")
        clean.append((n, s))
        parts = n.split("/")
        kids["/".join(parts[:-1])] += 1
        for d in {"/".join(parts[:k]) for k in range(len(parts))}:
            size[d] += s
            files[d] += 1
            dirs.add(d)
    for d in dirs - {""}:
        kids[d.rpartition("/")[0]] += 1
    for d in dirs:
        below = sum(1 for e in dirs if e != d and (d == "" or e.startswith(d + "/")))
        assert out[(d or ".", "dir")] == (size[d], 1 + files[d] + below, files[d], kids[d]), d
    assert len([k for k in out if k[1] == "dir"]) == len(dirs)
    assert out[(".", "dir")][0] == sum(s for _, s in clean)


AGES = [("data/hot.bin", 1000, 10, 1), ("data/warm.bin", 2000, 20, 2), ("data/cold/old.bin", 4000, 5, 4), ("archive/a.bin", 8000, 1, 4), ("archive/b.bin", 8000, 3, 4), ("empty/marker", 0, 15, 1), ("top.txt", 500, 25, 1)]


def test_pivot_and_mean(spark):
    out = R.rollup_listing(listing(spark, AGES), "s", pivots=["storage_class_id"], mean_mtime=True)
    got = by_path(out, *[f"sum_storage_class_id_{v}" for v in (1, 2, 4)])
    assert got[("data", "dir")] == (1000, 2000, 4000)
    assert got[("archive", "dir")] == (0, 0, 16000)
    assert got[(".", "dir")] == (1500, 2000, 20000)
    mean = by_path(out, "mtime_mean", "mtime")
    assert mean[("empty", "dir")][0] is None
    assert mean[("empty/marker", "file")][0] == mean[("empty/marker", "file")][1]
    t = lambda d: int(datetime(2026, 7, d, tzinfo=UTC).timestamp())
    assert mean[("archive", "dir")] == ((8000 * t(1) + 8000 * t(3)) / 16000, t(3))


def test_mean_is_exact_past_64_bits(spark):
    rows = spark.createDataFrame([("a/x", 10**15, 1_900_000_001, "file"), ("a/y", 10**15 + 1, 1_900_000_003, "file")], "path string, size long, mtime long, kind string")
    out = by_path(R.rollup(rows, "s", mean_mtime=True), "mtime_mean")
    assert out[("a", "dir")][0] == (10**15 * 1_900_000_001 + (10**15 + 1) * 1_900_000_003) / (2 * 10**15 + 1)


def test_more_than_32_pivot_values_are_refused(spark):
    with pytest.raises(ValueError, match="32"):
        R.rollup_listing(listing(spark, [(f"f{i}", 1, None, i) for i in range(33)]), "s", pivots=["storage_class_id"])


def test_walk_rows_with_links(spark):
    rows = spark.createDataFrame([("", 10, 9, "dir"), ("d", 20, 50, "dir"), ("d/f", 1, 5, "file"), ("d/l", 3, 2, "l"), ("void", 40, 1, "dir")], "path string, size long, mtime long, kind string")
    got = by_path(R.rollup(rows, "file://x"), "size", "mtime", "n_desc", "n_files", "n_children")
    assert got == {(".", "dir"): (74, 50, 5, 1, 2), ("d", "dir"): (24, 50, 3, 1, 2), ("void", "dir"): (40, 1, 1, 0, 0), ("d/f", "file"): (1, 5, 1, 1, 0)}


def test_empty_and_null_input(spark):
    out = R.rollup_listing(listing(spark, []), "s").collect()
    assert [(r["path"], r["size"], r["n_desc"], r["n_files"], r["n_children"]) for r in out] == [(".", 0, 1, 0, 0)]
    nulls = spark.createDataFrame([("b", "a/x", None, None, None)], LISTING)
    assert by_path(R.rollup_listing(nulls, "s"), "size", "mtime")[("a/x", "file")] == (0, 0)


def test_same_result_for_any_partitioning(spark):
    df = simple(spark, EDGES)
    a = R.rollup_listing(df, "s")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = R.rollup_listing(df.repartition(5), "s")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_merged_shards_equal_one_rollup(spark):
    df = simple(spark, [e for e in EDGES if e[0] != "x"])
    parts = [R.rollup_listing(df.where(F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(3)) == k), "s") for k in range(3)]
    merged = R.merge_rollups(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    whole = R.rollup_listing(df, "s").select(*merged.columns)
    assert whole.exceptAll(merged).count() == 0 and merged.exceptAll(whole).count() == 0
