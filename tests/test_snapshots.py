"""Snapshots that grow by batches, and deletes of many paths, against one rollup of what there is."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from arborlake.functions import paths as P
from arborlake.operators import rollup as R
from arborlake.operators import update as U
from arborlake.streaming import snapshots as S

LISTING = "bucket string, name string, size_bytes long, created timestamp, storage_class_id int"
COLUMNS = ["path", "kind", "parent", "depth", "size", "mtime", "n_desc", "n_files", "n_children"]


def listing(spark, names):
    rows = spark.createDataFrame([(p, s) for p, s in names], "name string, size_bytes long")
    return rows.select(F.lit("b").alias("bucket"), "name", "size_bytes", F.timestamp_seconds(F.col("size_bytes") * 7).alias("created"), F.lit(0).alias("storage_class_id"))


def names(rng, n):
    return [("/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + f"/f{rng.randint(0, 5)}", rng.randint(0, 9)) for _ in range(n)] + [("top.txt", 1)] * (rng.random() < 0.5)


def rows(df, columns=COLUMNS):
    return sorted(map(str, (tuple(r[c] for c in columns) for r in df.select(*columns).collect())))


@pytest.mark.parametrize("compact_every", [2, 3, 100])
def test_batches_equal_one_rollup(spark, tmp_path, compact_every):
    """After every batch, also one that runs twice; files that come again stay rows of their own."""
    rng, folder, so_far = random.Random(compact_every), str(tmp_path / "s"), []
    S.create(spark, folder)
    assert rows(S.read_snapshot(spark, folder)) == rows(R.rollup_listing(listing(spark, []), ""))
    for number in range(5):
        batch = names(rng, 12)
        for _ in range(1 + (number % 2)):
            S.add_batch(listing(spark, batch), number, folder, compact_every)
        so_far += batch
        assert rows(S.read_snapshot(spark, folder)) == rows(R.rollup_listing(listing(spark, so_far), ""))
    part = S.read_snapshot(spark, folder).where(P.under("path", "a"))
    assert rows(part) == rows(R.rollup_listing(listing(spark, so_far), "").where(P.under("path", "a")))


def size_of(folder, what):
    return sum(f.stat().st_size for f in Path(folder).glob(f"{what}/**/*.parquet"))


def test_bytes_follow_the_batch_and_old_ones_go(spark, tmp_path):
    folder, big = str(tmp_path / "s"), [(f"d{k % 400}/e{k % 7}/{k}", k) for k in range(20_000)]
    S.create(spark, folder)
    S.add_batch(listing(spark, big), 0, folder, 100)
    S.add_batch(listing(spark, [("d1/e1/new", 5)]), 1, folder, 100)
    assert spark.read.parquet(f"{folder}/delta/batch=1").count() == 4  # the file, two directories and the root
    assert size_of(folder, "delta/batch=1") < 0.1 * size_of(folder, "delta/batch=0")
    before = rows(S.read_snapshot(spark, folder))
    S.compact(spark, folder, 1)
    assert rows(S.read_snapshot(spark, folder)) == before and S.covered(spark, folder) == 1
    assert size_of(folder, "delta") < 0.1 * size_of(folder, "base/upto=1") and size_of(folder, "base/upto=-1") < 5000
    S.add_batch(listing(spark, big), 1, folder, 100)  # runs again after the base that covers it
    assert rows(S.read_snapshot(spark, folder)) == before


def test_a_restarted_stream_goes_on(spark, tmp_path):
    source, folder, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    S.create(spark, folder)
    first, second = listing(spark, names(random.Random(1), 20)), listing(spark, names(random.Random(2), 20))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        S.run_snapshot_merge(spark, source, first.schema, folder, state, 2).awaitTermination()
    assert rows(S.read_snapshot(spark, folder)) == rows(R.rollup_listing(first.unionByName(second), ""))


def test_a_batch_stores_no_file_before_its_delta(spark, tmp_path, monkeypatch):
    """Steps hold directories only; a delta's files and a base's are dealt from where they stand."""
    folder, steps, keep = str(tmp_path / "s"), {}, S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, name: steps.update({name: keep(df, name)}) or steps[name])
    S.create(spark, folder)
    for number in range(2):
        S.add_batch(listing(spark, [(f"d/e{number}/{k}", k) for k in range(500)]), number, folder, 2)
    assert {name: step.count() for name, step in steps.items()} == {"batch-directories": 3, "batch-parents": 2, "merged-directories": 4}
    assert S.covered(spark, folder) == 1 and S.read_snapshot(spark, folder).count() == 1004


def test_all_files_that_stand_there_are_one_batch(spark, tmp_path):
    source, folder, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    S.create(spark, folder)
    every = listing(spark, names(random.Random(3), 60)).repartition(4)
    every.write.parquet(source)
    S.run_snapshot_merge(spark, source, every.schema, folder, state, files=None).awaitTermination()
    assert [r[0] for r in spark.read.parquet(f"{folder}/delta").select("batch").distinct().collect()] == [0]
    assert rows(S.read_snapshot(spark, folder)) == rows(R.rollup_listing(every, ""))


def test_a_base_that_was_not_committed_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "s")
    S.create(spark, folder)
    S.add_batch(listing(spark, [("a/b", 1)]), 0, folder)
    before = rows(S.read_snapshot(spark, folder))
    listing(spark, [("x", 9)]).write.parquet(f"{folder}/base/upto=7")
    assert rows(S.read_snapshot(spark, folder)) == before


@pytest.mark.parametrize("seed", range(3))
def test_deletes_equal_a_rollup_of_the_rest(spark, seed):
    """Hundreds of paths, nested, disjoint, repeated and absent, files and directories; no directory is left empty."""
    rng = random.Random(seed)
    files = sorted({p for p, _ in names(rng, 400)} | {f"{d}/keep" for d in ("a", "b", "c", "a/a", "a/b", "b/a", "c/c")})
    tree = R.rollup_listing(listing(spark, [(p, 3) for p in files]), "")
    dirs = [r["path"] for r in tree.where("kind = 'dir' and depth >= 3").collect()]
    gone = rng.sample(dirs, len(dirs) // 2) + rng.sample([f for f in files if f.count("/") == 4], 20) + ["absent", "a/none/x"]
    gone += [f"{g}/below" for g in gone[:5]] + gone[:3]
    left = [f for f in files if not any(f == g or f.startswith(g + "/") for g in gone)]
    full = {p.rpartition("/")[0] for p in left}
    got = U.delete_prefixes(tree, spark.createDataFrame([(g,) for g in gone], "path string"))
    keep = ["path", "kind", "size", "n_files"]
    want = R.rollup_listing(listing(spark, [(p, 3) for p in left]), "")
    assert rows(got.where("kind = 'file' or n_files > 0"), keep) == rows(want, keep) and full
    one, _ = U.delete_subtree(tree, "a/a")
    assert rows(one, [*keep, "n_desc", "n_children"]) == rows(U.delete_prefixes(tree, spark.createDataFrame([("a/a",)], "path string")), [*keep, "n_desc", "n_children"])
    assert rows(U.delete_prefixes(tree, spark.createDataFrame([], "path string")), keep) == rows(tree, keep)
