"""Search against plain Python, and the index against a full scan."""

import re

import pytest

from arborlake.operators import histogram as H
from arborlake.operators import rollup as R
from arborlake.operators import search as Q

PATHS = ["a/demo/demo.txt", "a/demo/x/demo2", "a/other.txt", "b/x/y/z/deep-demo.dat", "b/Demo", "c/readme.md", "c/demo/", "d+e/f.txt"]


@pytest.fixture(scope="module")
def tree(spark):
    rows = spark.createDataFrame([(p.rstrip("/"), 10 * (i + 1), i, "file") for i, p in enumerate(PATHS)], "path string, size long, mtime long, kind string")
    return R.rollup(rows, "s").cache()


def plain(rows, query, case):
    q = query.strip()
    m = re.fullmatch(r"/(.*)/([gimsuy]*)", q)
    test = None
    if m:
        try:
            r = re.compile(m[1], (re.I if "i" in m[2] or not case else 0) | (re.S if "s" in m[2] else 0) | (re.M if "m" in m[2] else 0))
            test, body = (lambda s: bool(r.search(s))), m[1]
        except re.error:
            pass
    if test is None:
        body = q
        test = (lambda s: q in s) if case else (lambda s: q.lower() in s.lower())
    whole = "/" in body and bool(q)
    hits = {(p, k, s) for p, k, s in rows if p != "." and test(p if whole else p.rpartition("/")[2])}
    return {h for h in hits if not any(k == "dir" and h[0].startswith(p + "/") for p, k, _ in hits)}


QUERIES = ["demo", "Demo", "/demo$/", "/^demo/", "/x\\/y/", "a/demo", "/[/", "", "d+e", "/DEMO/g", "nothing", "/./"]


@pytest.mark.parametrize("case", [False, True])
@pytest.mark.parametrize("query", QUERIES)
def test_outermost_matches(spark, tree, query, case):
    rows = {(r["path"], r["kind"], r["size"]) for r in tree.collect()}
    got = {(r["path"], r["kind"], r["size"]) for r in Q.search(tree, query, case).collect()}
    assert got == plain(rows, query, case)


def test_rollup_progress_and_totals(tree):
    found = Q.search(tree, "demo").collect()
    totals = Q.filter_totals(tree, "demo").first()
    assert (totals["total_size"], totals["n_matches"]) == (sum(r["size"] for r in found), len(found))
    nodes = {(r["path"], r["matched"]): (r["size"], r["n_matches"]) for r in Q.filter_rollup(tree, "demo", 4).collect()}
    for (p, matched), (size, n) in nodes.items():
        if not matched:
            below = [r for r in found if r["path"].startswith(p + "/")]
            assert (size, n) == (sum(r["size"] for r in below), len(below))
    steps = Q.filter_progress(tree, "demo").orderBy("depth").collect()
    assert steps[-1]["n_matches"] == len(found) and [s["n_matches"] for s in steps] == sorted(s["n_matches"] for s in steps)


def test_histogram_bins(spark):
    rows = spark.createDataFrame([("a/1", 100, 0, "file"), ("a/2", 100, 10, "file"), ("a/3", 10, 100, "file"), ("b/1", 60, 50, "file"), ("loose.txt", 30, 99, "file")], "path string, size long, mtime long, kind string")
    t = R.rollup(rows, "s")
    got = {r["path"]: (r["kind"], r["bytes"], r["edges"]) for r in H.age_histograms(t, bins=4).collect()}
    edges = [0, 25, 50, 75, 100]
    assert got == {"a": ("dir", [200, 0, 0, 10], edges), "b": ("dir", [0, 0, 60, 0], edges), "loose.txt": ("file", [0, 0, 0, 30], edges)}
    cut = H.age_histograms(t, bins=4, limit=1).collect()
    assert [(r["path"], r["omitted"], r["omitted_bytes"]) for r in cut] == [("a", 2, 90)]
    given = {r["path"]: r["bytes"] for r in H.age_histograms(t, edges=[20.0, 40.0, 60.0]).collect()}
    assert given == {"a": [200, 10], "b": [0, 60], "loose.txt": [0, 30]}
    assert {r["path"] for r in H.age_histograms(t, "a", bins=2).collect()} == {"1", "2", "3"}
    assert H.age_histograms(t, "none").count() == 0
    with pytest.raises(ValueError):
        H.age_bins(t, edges=[1.0])


def test_outermost_keeps_no_table_of_distinct_paths(spark):
    """Nested matches give the outermost once each, without an aggregation."""
    found = spark.createDataFrame([("a", "dir"), ("a/a", "dir"), ("a/a/a", "file"), ("b/a", "file")], "path string, kind string")
    out = Q.outermost(found)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["path"] for r in out.collect()) == ["a", "b/a"]


def test_only_matches_below_a_matching_path_are_joined(spark, monkeypatch):
    """The others pass without a join; a match below a matching path that is no row of the snapshot stays."""
    steps, keep = [], Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df, name: steps.append(keep(df, name)) or steps[-1])
    rows = [("demo", "dir", 3), ("demo/demo.a", "file", 1), ("demo/b", "dir", 1), ("demo/b/demo.c", "file", 1), ("e/demo.f", "file", 1), ("demo9/demo.g", "file", 1)]
    out = Q.search(spark.createDataFrame(rows, "path string, kind string, size long"), "demo")
    assert sorted(r["path"] for r in out.collect()) == ["demo", "demo9/demo.g", "e/demo.f"]
    above = {r["path"]: r["__above"] for r in steps[0].collect()}
    assert above == {"demo": [], "demo/demo.a": ["demo"], "demo/b/demo.c": ["demo"], "e/demo.f": [], "demo9/demo.g": ["demo9"]}
