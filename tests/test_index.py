"""The index of names: same results as a full scan, fewer files opened, bounded posting rows."""

import contextlib
import io
import random
import re
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from arborlake.operators import index as I
from arborlake.operators import rollup as R
from arborlake.operators import search as Q

WORDS = ["alpha", "Beta", "household", "HOUSEboat", "demo", "README", "ſet", "größe", "data-7", "x", "ab", "日本語データ", "Kelvin"]


def listing(spark, n=400, seed=0):
    rng = random.Random(seed)
    names = {"/".join(rng.choice(WORDS) + rng.choice(["", str(rng.randint(0, 9))]) for _ in range(rng.randint(1, 4))) + rng.choice([".bin", ".txt", ""]) for _ in range(n)}
    return spark.createDataFrame([(p, k % 50, k, "file") for k, p in enumerate(sorted(names))], "path string, size long, mtime long, kind string")


@pytest.fixture(scope="module")
def tree(spark):
    return R.rollup(listing(spark), "s").cache()


@pytest.fixture(scope="module")
def folder(tree, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("indexed") / "snapshot")
    I.write_indexed(tree, to, slice_rows=40, posting=8)
    return to


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


QUERIES = ["household", "HouseHold", "/[0-9]*household[0-9]/", "/^(alpha|house(hold|boat))[0-9]?$/", "/d.mo/", "/(demo|x)/", "/(?:demo)+3/", "/(demo)*3/", "/set/", "/kelvin/", "größe", "語デー", "x", "", "a/demo", "/alpha.*[.]bin$/", "/[/", "/(?=demo)demo/", "nothing at all"]


@pytest.mark.parametrize("case", [False, True])
@pytest.mark.parametrize("query", QUERIES)
def test_index_equals_scan(spark, tree, folder, query, case):
    got = sorted(map(tuple, I.indexed_search(spark, folder, query, case).select("path", "kind", "size", "depth").collect()))
    assert got == sorted(map(tuple, Q.search(tree, query, case).select("path", "kind", "size", "depth").collect()))


def test_slices_are_exact_ranks(spark, tree, folder):
    rows = sorted((r["depth"], r["path"].encode(), r["kind"]) for r in tree.collect())
    got = {(r["depth"], r["path"].encode(), r["kind"]): r["slice"] for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert got == {r: k // 40 for k, r in enumerate(rows)}
    names = {r["name"]: (r["n_dirs"], r["n_files"], r["row_groups"]) for r in spark.read.parquet(f"{folder}/names").collect()}
    want = {}
    for (_, p, kind), k in got.items():
        if p != b".":
            d, f, s = want.setdefault(p.decode().rpartition("/")[2], [0, 0, set()])
            want[p.decode().rpartition("/")[2]] = [d + (kind == "dir"), f + (kind == "file"), s | {k}]
    assert names == {n: (d, f, sorted(s)) for n, (d, f, s) in want.items()}


def test_files_of_other_slices_are_not_opened(spark, tree, tmp_path):
    """Every file of a slice that does not hold the name is spoiled; the search still finds all, the full scan fails."""
    to = str(tmp_path / "snapshot")
    I.write_indexed(tree.unionByName(tree.limit(1).withColumns({"path": F.lit("alpha/rare-name.bin"), "depth": F.lit(2), "kind": F.lit("file")})), to, slice_rows=40, posting=8)
    (held,) = [r["row_groups"] for r in I.matching_names(spark, to, "rare-NAME").collect()]
    query = I.candidate_rows(spark, to, "rare-name")
    assert "dynamicpruning" in plan_of(query).lower()
    files = sorted(Path(to, "rows").glob("slice=*/*.parquet"))
    spoiled = [f for f in files if int(f.parent.name.split("=")[1]) not in held]
    assert len(spoiled) > 0.8 * len(files) > 5
    for f in spoiled:
        f.write_bytes(b"no parquet file")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert [r["path"] for r in Q.search(query, "rare-name").collect()] == ["alpha/rare-name.bin"]
    with pytest.raises(Exception, match="not a Parquet file|parquet"):
        spark.read.schema(tree.schema).parquet(f"{to}/rows").where("size > 0").collect()
    assert not I.is_fresh(spark, to)


def test_a_browse_opens_the_slices_of_its_range(spark, tree, folder, tmp_path):
    for under, low, high in [(".", 0, 1), ("alpha", 1, 2), ("Beta", 3, 3), ("absent", 0, 9)]:
        rows = I.browse(spark, folder, under, low, high)
        want = tree.where(F.col("depth").between(low, high)).where(I.P.under("path", under))
        assert sorted(map(tuple, rows.select("depth", "path", "kind").collect())) == sorted(map(tuple, want.select("depth", "path", "kind").collect()))
    ends = {r["slice"]: (tuple(r["first"]), tuple(r["last"])) for r in spark.read.parquet(f"{folder}/slices").collect()}
    near = {k for k, (first, last) in ends.items() if (3, "Beta") <= last and (3, "Beta0") >= first}
    copied = shutil.copytree(folder, tmp_path / "copy")
    one, rows = I.browse(spark, str(copied), "Beta", 3, 3), I.browse(spark, folder, "Beta", 3, 3)
    for f in copied.glob("rows/slice=*/*.parquet"):
        if int(f.parent.name.split("=")[1]) not in near:
            f.write_bytes(b"no parquet file")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert "dynamicpruning" in plan_of(one).lower() and 0 < len(near) < 0.5 * len(ends)
    assert sorted(r["path"] for r in one.collect()) == sorted(r["path"] for r in rows.collect())


def test_posting_rows_are_bounded(spark, folder):
    rows = spark.read.parquet(f"{folder}/postings").collect()
    assert max(len(r["numbers"]) for r in rows) <= 8 and all(0 <= n < 8 for r in rows for n in r["numbers"])
    names = {r["name_id"]: r["name"] for r in spark.read.parquet(f"{folder}/names").collect()}
    for r in rows:
        for n in r["numbers"]:
            assert r["trigram"] in names[r["block"] * 8 + n].translate(str.maketrans("ſKİı", "skii")).lower()


def test_what_patterns_require():
    assert I.required("/[0-9]*household[a-z]/") == ("and", ("hou", "ous", "use", "seh", "eho", "hol", "old"))
    assert I.required("/(abc|xyz)d/") == ("or", ("abc", "xyz"))
    assert I.required("/ab|xyz/") is None and I.required("/(abc)?/") is None and I.required("ab") is None and I.required("") is None
    assert I.required("/(abc)+/") == "abc" and I.required("/a(?!bcd)e/") is None
    assert I.required("größe-abc") == ("and", ("e-a", "-ab", "abc"))


@pytest.mark.parametrize("seed", range(40))
def test_requirements_never_lose_a_match(seed):
    """Random patterns: a name that matches satisfies what the pattern requires."""
    rng = random.Random(seed)

    def pattern(deep=3):
        if deep == 0:
            return rng.choice(["abc", "b", "[ab]", "c.", "ca", "a?", "(?i:AB)"])
        ways = [pattern(deep - 1) for _ in range(rng.randint(1, 3))]
        return rng.choice(["".join(ways), f"({'|'.join(ways)})", f"(?:{ways[0]}){rng.choice(['+', '*', '{2}', '?'])}{''.join(ways[1:])}"])

    def holds(need, name):
        return need is None or (need in name if isinstance(need, str) else (all if need[0] == "and" else any)(holds(p, name) for p in need[1]))

    p = pattern()
    need = I._of_tree(re._parser.parse(p))
    for _ in range(300):
        name = "".join(rng.choice("abcAB") for _ in range(rng.randint(0, 14)))
        if re.search(p, name, re.I):
            assert holds(need, name.lower()), (p, name, need)


def test_chunked_snapshots_are_not_indexed(spark, tree, tmp_path):
    with pytest.raises(ValueError, match="chunked"):
        I.write_indexed(tree.withColumn("child_scan_id", F.lit("x")), str(tmp_path / "s"))


def test_an_empty_snapshot(spark, tmp_path):
    to = str(tmp_path / "s")
    I.write_indexed(R.rollup(spark.createDataFrame([], "path string, size long, mtime long, kind string"), "s"), to)
    assert I.indexed_search(spark, to, "abcd").count() == 0 and I.indexed_search(spark, to, "/x/").count() == 0


def test_small_slices_share_partitions(spark, tree, folder, tmp_path):
    """Folders follow parts and not slices; slices, searches and browses stay as they are."""
    to = str(tmp_path / "s")
    I.write_indexed(tree, to, slice_rows=10, posting=8, part_slices=4)
    held = {(r["part"], r["slice"]) for r in spark.read.parquet(f"{to}/rows").select("part", "slice").collect()}
    assert len(list(Path(to, "rows").glob("part=*"))) == len({p for p, _ in held}) and all(p == k // 4 for p, k in held)
    query = I.indexed_search(spark, to, "household").select("path", "kind")
    assert sorted(map(tuple, query.collect())) == sorted(map(tuple, Q.search(tree, "household").select("path", "kind").collect()))
    want = tree.where(F.col("depth").between(1, 2)).where(I.P.under("path", "alpha")).select("path", "kind")
    assert sorted(map(tuple, I.browse(spark, to, "alpha", 1, 2).select("path", "kind").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("posting", [8, 256, 600, 4096])
def test_postings_hold_every_number_once(spark, posting):
    """Gathered as bits or in parts of them: names that repeat a trigram, names too short for one, several parts a block."""
    names = [f"n{k:04d}-aaaa" if k % 3 else "ab" for k in range(1300)]
    want = {}
    for k, name in enumerate(names):
        for at in range(len(name) - 2):
            want.setdefault((name[at : at + 3], k // posting), set()).add(k % posting)
    rows = I.postings(spark.createDataFrame(list(enumerate(names)), "name_id long, name string"), posting).collect()
    assert {(r["trigram"], r["block"]): r["numbers"] for r in rows} == {key: sorted(held) for key, held in want.items()}
    assert len(rows) == len(want) and all(r["n_names"] == len(r["numbers"]) for r in rows)


def test_lists_are_dealt_once_and_stay_in_order(spark, tree, tmp_path, monkeypatch):
    """Posting rows are neither a step nor dealt a second time; each file is in order, and blocks stay whole in one task each."""
    steps, keep = [], I.materialise
    monkeypatch.setattr(I, "materialise", lambda df, name, *codec: steps.append(name) or keep(df, name, *codec))
    monkeypatch.setattr(I, "TASK_NAMES", 30)
    to = str(tmp_path / "s")
    I.write_indexed(tree, to, slice_rows=40, posting=8)
    assert sorted(steps) == ["names-by-slice", "ranked", "ranked", "to-rank"]
    lists = spark.read.parquet(f"{to}/postings")
    assert lists.count() == lists.select("trigram", "block").distinct().count()
    for file in Path(to, "postings").glob("*.parquet"):
        keys = [(r["trigram"].encode(), r["block"]) for r in spark.read.parquet(str(file)).collect()]
        assert keys == sorted(keys)
    many = spark.createDataFrame([("a" if k % 5 else f"n{k:03d}", k % 3, k % 2, 1) for k in range(90)], "name string, slice int, n_dirs long, n long").groupBy("name", "slice").sum("n_dirs", "n").toDF("name", "slice", "n_dirs", "n")
    want = {r["name"]: (r["n_dirs"], r["n_files"], r["row_groups"]) for r in I._by_name(many).collect()}
    monkeypatch.setattr(I, "_by_slice", lambda df: df)
    got = sorted(I.numbered_vocabulary(many).collect(), key=lambda r: r["name"])
    assert {r["name"]: (r["n_dirs"], r["n_files"], r["row_groups"]) for r in got} == want and [r["name_id"] for r in got] == list(range(len(want)))


def test_tables_that_nobody_reads_are_not_written(spark, tree, folder, tmp_path):
    """What is written is what the whole index holds."""
    as_rows = lambda to, table, *cols: sorted(map(str, spark.read.parquet(f"{to}/{table}").select(*cols).collect()))
    for tables in (("slices",), ("names",), ("rows", "names", "postings")):
        to = str(tmp_path / "-".join(tables))
        I.write_indexed(tree.select("path", "kind"), to, slice_rows=40, posting=8, tables=tables)
        assert sorted(p.name for p in Path(to).iterdir()) == sorted([*tables, "stamp"])
        for t in set(tables) - {"rows"}:
            cols = spark.read.parquet(f"{folder}/{t}").columns
            assert as_rows(to, t, *cols) == as_rows(folder, t, *cols)
    I.write_names(tree.select("path", "kind"), str(tmp_path / "alone"), posting=8)
    assert as_rows(tmp_path / "alone", "names", "name", "name_id") == as_rows(folder, "names", "name", "name_id")
    assert as_rows(tmp_path / "alone", "postings", "trigram", "block", "numbers") == as_rows(folder, "postings", "trigram", "block", "numbers")


def test_paths_are_the_rows_of_a_rollup(spark):
    rows = listing(spark).unionByName(spark.createDataFrame([("empty/dir", 0, 0, "dir"), ("alpha/link", 1, 0, "link"), ("/lead/x", 1, 0, "file")], "path string, size long, mtime long, kind string"))
    as_rows = lambda df: sorted(map(tuple, df.select("path", "kind").collect()))
    assert as_rows(R.paths(rows)) == as_rows(R.rollup(rows, "s"))
    assert as_rows(R.paths(rows.limit(0))) == [(".", "dir")]
