"""Diffs against a best-first walk written in plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from arborlake.functions import paths as P
from arborlake.operators import diff as D
from arborlake.operators import rollup as R


def snap(spark, files):
    rows = spark.createDataFrame([(p, s, m, "file") for p, s, m in files], "path string, size long, mtime long, kind string")
    return R.rollup(rows, "s")


def test_one_level(spark):
    a = snap(spark, [("a.txt", 100, 1), ("sub/b.txt", 200, 1), ("sub/c.txt", 300, 1)])
    b = snap(spark, [("a.txt", 500, 1), ("sub/b.txt", 200, 1), ("sub/d.txt", 700, 1)])
    top = {r["path"]: (r["status"], r["size_delta"]) for r in D.compare_children(a, b).collect()}
    assert top == {"a.txt": ("changed", 400), "sub": ("changed", 400)}
    low = {r["path"]: (r["status"], r["size_delta"]) for r in D.compare_children(a, b, "sub").collect()}
    assert low == {"sub/b.txt": ("unchanged", 0), "sub/c.txt": ("removed", -300), "sub/d.txt": ("added", 700)}


def walk(a, b, budget, max_depth, all_rows):
    """The frontier that a heap of directories visits; a and b map path to (kind, size, n_desc, n_children, mtime)."""
    kids = {}
    for p in {*a, *b} - {"."}:
        kids.setdefault(p.rpartition("/")[0], []).append(p)
    heap, seq, out, done = [(0, 0, 0, "")], 0, {}, 0
    while heap and (budget is None or done < budget):
        _, depth, _, at = heapq.heappop(heap)
        done += 1
        if at:
            out[at][2] = True
        for p in sorted(kids.get(at, [])):
            x, y = a.get(p), b.get(p)
            status = "added" if x is None else "removed" if y is None else "changed" if x[0] != y[0] or x[1:3] != y[1:3] else "unchanged"
            delta = (y[1] if y else 0) - (x[1] if x else 0)
            out[p] = [status, delta, False, False]
            if x and y and x[0] == y[0] == "dir" and x[1:] != y[1:]:
                if max_depth is not None and depth + 1 >= max_depth:
                    out[p][3] = True
                else:
                    seq += 1
                    heapq.heappush(heap, (-abs(delta), depth + 1, seq, p))
    for *_, p in heap:
        if p:
            out[p][3] = True
    return {p: tuple(v) for p, v in out.items() if v[0] != "unchanged" or v[3] or all_rows}


def random_files(rng):
    out = {}
    for _ in range(rng.randint(1, 25)):
        p = "/".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) + rng.choice(["/f", "/g"])
        out[p] = (rng.randint(0, 3) * 10, rng.randint(0, 2))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_recursive_against_walk(spark, seed):
    rng = random.Random(seed)
    fa = random_files(rng)
    fb = {p: v for p, v in fa.items() if rng.random() < 0.8} | {p: v for p, v in random_files(rng).items() if rng.random() < 0.5}
    a, b = (snap(spark, [(p, *v) for p, v in f.items()]).cache() for f in (fa, fb))
    as_map = lambda df: {r["path"]: (r["kind"], r["size"], r["n_desc"], r["n_children"], r["mtime"]) for r in df.collect()}
    for budget, deep, every in [(None, None, False), (rng.randint(1, 6), None, False), (rng.randint(1, 9), rng.randint(1, 3), True)]:
        got = {r["path"]: (r["status"], r["size_delta"], r["expanded"], r["pruned"]) for r in D.recursive_diff(a, b, budget, deep, every).collect()}
        assert got == walk(as_map(a), as_map(b), budget, deep, every), (budget, deep, every)


def plain_order(rows):
    """Every expansion of a heap of (path, parent, gain), in order."""
    kids = {}
    for p, up, gain in sorted(rows):
        kids.setdefault(up, []).append((p, gain))
    heap, seq, out = [(0, 0, 0, "")], 0, []
    while heap:
        _, depth, _, at = heapq.heappop(heap)
        out.append(at)
        for p, gain in kids.get(at, []):
            seq += 1
            heapq.heappush(heap, (-gain, depth + 1, seq, p))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_budgets_with_ties_at_every_level(spark, seed):
    """Gains of two or three values, so that ties nest; each budget gives the beginning of one order."""
    rng = random.Random(seed)
    rows, open_ = [], [("", 0)]
    for _ in range(60):
        up, depth = rng.choice(open_)
        p = f"{up}/{rng.choice('abcdefgh')}{len(rows)}".lstrip("/")
        rows.append((p, up, depth + 1, rng.choice([0, 5, 5, 9] if seed % 2 else [5, 9])))
        if depth < 4:
            open_.append((p, depth + 1))
    df = spark.createDataFrame(rows, "path string, parent string, depth int, gain long").repartition(3)
    order = plain_order([(p, up, g) for p, up, _, g in rows])
    for budget in [1, *rng.sample(range(2, 60), 2), 61]:
        assert D._first_expansions(df, budget) == set(order[:budget]), budget


def test_more_ties_than_any_driver_list(spark):
    """150,000 directories change by one byte each; a budget of seven opens the first six by name."""
    n = 150_000
    path = F.format_string("d%06d", F.col("id"))
    rows = spark.range(n).select(path.alias("path"), F.lit("").alias("parent"), F.lit(1).alias("depth"), F.lit(1).cast("long").alias("gain"))
    assert D._first_expansions(rows, 7) == {""} | {f"d{k:06d}" for k in range(6)}


def test_kind_swap_is_reported_and_not_entered(spark):
    a, b = snap(spark, [("x/f", 5, 1)]), snap(spark, [("x", 5, 1)])
    got = {r["path"]: (r["status"], r["expanded"]) for r in D.recursive_diff(a, b).collect()}
    assert got == {"x": ("changed", False)}


def test_weights_grow_with_churn(spark):
    a, b = snap(spark, [("d/old", 100, 1), ("d/same", 5, 1)]), snap(spark, [("d/new", 80, 1), ("d/same", 5, 1)])
    got = {r["path"]: r["weight"] for r in D.diff_weights(D.recursive_diff(a, b), gap_bytes=1).collect()}
    assert got == {"d": 180, "d/old": 100, "d/new": 80}
    same = {r["path"]: r["weight"] for r in D.diff_weights(D.recursive_diff(a, b), mode="delta").collect()}
    assert same["d"] == 180


def test_sets_and_renames(spark):
    a = snap(spark, [("p/1", 1, 1), ("q/2", 2, 1)])
    assert D.sets_equal(a, a.repartition(3)) and not D.sets_equal(a, a.where(P.depth_of("path") < 2))
    assert D.content_digest(a).first() == D.content_digest(a.repartition(3)).first()


def test_extent_tells_that_a_budget_cut_the_diff(spark):
    a, b = snap(spark, [("d/e/f", 1, 1)]), snap(spark, [("d/e/f", 2, 1)])
    for budget, deep, want in [(None, None, (3, False)), (2, None, (2, True)), (None, 1, (1, True)), (0, None, (0, True))]:
        assert tuple(D.extent(D.recursive_diff(a, b, budget, deep, True), budget).first()) == want


def test_no_size_is_a_size_of_nothing(spark):
    schema = "path string, kind string, size long, n_desc long, n_children long, mtime long"
    a, b = spark.createDataFrame([("x", "file", None, 1, 0, 1)], schema), spark.createDataFrame([("x", "file", 0, 1, 0, 1)], schema)
    assert D.recursive_diff(a, b, include_unchanged=True).first()["status"] == "unchanged"
    assert D.compare_children(a, b).first()["status"] == "changed"


def test_rows_of_no_step_are_not_written(spark, monkeypatch):
    """Unchanged files are neither stored nor joined by parent; the directories above them still are."""
    steps, keep = {}, D.materialise
    monkeypatch.setattr(D, "materialise", lambda df, name: steps.setdefault(name, keep(df, name)))
    a, b = snap(spark, [("d/old", 100, 1), ("d/same", 5, 1)]), snap(spark, [("d/new", 80, 1), ("d/same", 5, 1)])
    got = {r["path"]: (r["status"], r["expanded"]) for r in D.recursive_diff(a, b).collect()}
    assert got == {"d": ("changed", True), "d/old": ("removed", False), "d/new": ("added", False)}
    assert {r["path"] for r in steps["diff-rows"].collect()} == set(got)


def exchanged(df):
    """The exchanges of a plan, as the optimizer hands it over."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line and "Broadcast" not in line]


def test_sides_are_dealt_by_path_once(spark):
    """A path that a side holds as file and directory counts as directory; both sides meet behind one exchange, without a join."""
    schema = "path string, kind string, size long, n_desc long, n_children long, mtime long"
    a = spark.createDataFrame([("x", "file", 9, 1, 0, 1), ("x", "dir", 5, 2, 1, 1), ("y", "file", 3, 1, 0, 1), ("y", "file", 2, 1, 0, 4)], schema)
    b = spark.createDataFrame([("x", "file", 7, 1, 0, 1), ("z", "file", None, 1, 0, 1)], schema)
    rows = D.paired(a, b)
    assert len(exchanged(rows)) == 1
    got = {r["path"]: (r["kind_a"], r["size_a"], r["mtime_a"], r["kind_b"], r["size_b"]) for r in rows.collect()}
    assert got == {"x": ("dir", 5, 1, "file", 7), "y": ("file", 2, 4, None, None), "z": (None, None, None, "file", None)}


def test_rows_that_are_not_expanded_meet_no_join(spark, monkeypatch):
    """Only expanded rows and parents are written to find who is above whom; the weights are those of rows that tell nothing."""
    steps, keep = {}, D.materialise
    monkeypatch.setattr(D, "materialise", lambda df, name: steps.update({name: keep(df, name)}) or steps[name])
    a, b = snap(spark, [("d/e/old", 100, 1), ("f", 2, 1), ("g/h", 1, 1)]), snap(spark, [("d/e/new", 80, 1), ("f", 7, 1), ("g/h", 1, 2)])
    rows = D.recursive_diff(a, b).persist()
    got = {(r["path"], r["weight"]) for r in D.diff_weights(rows, gap_bytes=1).collect()}
    assert {r["path"] for r in steps["diff-inner"].collect()} == {"d", "d/e"} and "diff-leaves" not in steps
    steps.clear()
    assert {(r["path"], r["weight"]) for r in D.diff_weights(rows.drop("expanded"), gap_bytes=1).collect()} == got == {("d", 180), ("d/e", 180), ("d/e/old", 100), ("d/e/new", 80), ("f", 7)}


def test_weights_join_and_write_no_leaf_by_level(spark, monkeypatch):
    levels, keep = [], D.materialise
    monkeypatch.setattr(D, "materialise", lambda df, name: (levels.append(keep(df, name)) or levels[-1]) if name == "diff-level" else keep(df, name))
    rows = spark.createDataFrame([("a/b/c", "added", 0, 7, 7), ("a/d", "removed", 9, 0, -9), ("e", "changed", 1, 5, 4), ("a/b", "changed", 30, 20, -10)], "path string, status string, size_a long, size_b long, size_delta long")
    got = {(r["path"], r["depth"], r["status"], r["weight"]) for r in D.diff_weights(rows, gap_bytes=1).collect()}
    assert got == {("a/b/c", 3, "added", 7), ("a/d", 2, "removed", 9), ("e", 1, "changed", 5), ("a/b", 2, "changed", 30), ("a", 1, "unchanged", 39), ("a/b/(unchanged)", 3, "filler", 23)}
    assert sorted(r["path"] for level in levels for r in level.collect()) == ["a", "a/b"]
