from datetime import UTC, datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from arborlake.operators import access as A
from arborlake.operators import audit, registry, rollup, slices, update
from arborlake.sources import access_logs, listings, sinks
from arborlake.streaming import access as stream

T = datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)


def test_three_listing_schemas(spark):
    raw = spark.createDataFrame([("b1", "a", 1)], "bucket string, name string, size_bytes int")
    gcs = spark.createDataFrame([("b2", "x", 5, T, "NEARLINE", None), ("b2", "gone", 5, T, "STANDARD", T)], "bucket string, name string, size long, timeCreated timestamp, storageClass string, timeDeleted timestamp")
    s3 = spark.createDataFrame([("b3", "k", 7, T, "GLACIER", None, None), ("b3", "m", 7, T, "STANDARD", True, True), ("b3", "o", 7, T, "STANDARD", False, False)], "Bucket string, Key string, Size long, LastModifiedDate timestamp, StorageClass string, IsDeleteMarker boolean, IsLatest boolean")
    rows = lambda df: [tuple(r) for r in listings.normalize_listing(df).select("bucket", "name", "size_bytes", "storage_class_id").collect()]
    assert rows(raw) == [("b1", "a", 1, 0)] and rows(gcs) == [("b2", "x", 5, 2)] and rows(s3) == [("b3", "k", 7, 4)]
    assert rows(s3.select("Bucket", "Key", "Size"))[0] == ("b3", "k", 7, 0)
    with pytest.raises(ValueError, match="odd"):
        listings.normalize_listing(raw.withColumnRenamed("name", "odd"))


def test_first_listing_of_a_bucket_wins(spark):
    a = spark.createDataFrame([("b1", "a", 1), (None, "n", 1)], "bucket string, name string, size_bytes long")
    b = spark.createDataFrame([("b1", "other", 2), ("c2", "c", 3)], "bucket string, name string, size_bytes long")
    assert {(r["bucket"], r["name"]) for r in listings.merge_listings([a, b]).collect()} == {("b1", "a"), ("c2", "c")}
    assert [r["bucket"] for r in listings.list_buckets(b).collect()] == ["b1", "c2"]
    with pytest.raises(ValueError):
        listings.of_bucket(b, "zz")


def test_walk_dump(spark, tmp_path):
    (tmp_path / "dump").write_bytes(b"\0".join(["d 8 100.9 /r".encode(), "f 3 5.5 /r/a b".encode(), "l 1 7 /r/l".encode(), b"f 1 1 /other/x", b"f x 1 /r/bad", b"junk"]))
    lines = spark.read.option("lineSep", "\0").text(str(tmp_path / "dump"))
    got = {(r["path"], r["kind"], r["size"], r["mtime"], r["parent"], r["uri"]) for r in listings.parse_walk(lines, "/r", "file:///r").collect()}
    assert got == {("", "dir", 4096, 100, None, "file:///r"), ("a b", "file", 1536, 5, "", "file:///r/a b"), ("l", "l", 512, 7, "", "file:///r/l")}


def test_recursive_listing(spark):
    lines = spark.createDataFrame([("2024-01-02 03:04:05        12 p/a/x y.bin",), ("2024-01-02 03:04:05         3 p/b",)], "value string")
    got = {(r["path"], r["kind"], r["size"], r["uri"]) for r in listings.parse_recursive_listing(lines, "s3://k", "p").collect()}
    assert got == {("", "dir", 0, "s3://k/p"), ("a", "dir", 0, "s3://k/p/a"), ("a/x y.bin", "file", 12, "s3://k/p/a/x y.bin"), ("b", "file", 3, "s3://k/p/b")}
    with pytest.raises(ValueError):
        listings.parse_recursive_listing(lines, "s3://k", "q")


HEADER = "time_micros,c_ip,cs_method,sc_status,cs_bytes,sc_bytes,cs_user_agent,s_request_id,cs_operation,cs_bucket,cs_object"


def test_gcs_log_and_tree(spark, tmp_path):
    day1, day2 = 1_700_000_000_000_000, 1_700_000_000_000_000 + 86_400_000_000
    rows = [f"{day1},1.1.1.1,GET,200,0,4000,ua,r1,GET_Object,b,tok/fine/a", f"{day1},2.2.2.2,GET,200,0,3000,ua,r2,GET_Object,b,tok/fine/a", f"{day1},2.2.2.2,GET,200,0,2000,ua,r3,GET_Object,b,tok/fine/b", f"{day1},2.2.2.2,GET,200,0,2000,ua,r3,GET_Object,b,tok/fine/b", f"{day1},1.1.1.1,GET,200,,,ua,r4,LIST_Bucket,b,", f"{day2},1.1.1.1,PUT,200,10000,,ua,r5,PUT_Object,b,up/x", f"{day2},1.1.1.1,GET,200,1,1,ua,r6,GET_Object,,x"]
    (tmp_path / "log.csv").write_text("\n".join([HEADER, *rows]))
    log = access_logs.parser_for("gcs")(spark, str(tmp_path / "log.csv")).cache()
    assert log.columns == access_logs.COLUMNS and log.count() == 5
    tree = {(r["path"], str(r["day"]), r["op"]): (r["n_ops"], r["bytes_out"], r["bytes_in"], r["n_requesters"], r["kind"]) for r in A.access_tree(log).collect()}
    assert tree[("tok/fine", "2023-11-14", "GET")] == tree[("tok", "2023-11-14", "GET")] == (3, 9000, 0, 3, "dir")
    assert tree[("tok/fine/a", "2023-11-14", "GET")] == (2, 7000, 0, 2, "file")
    assert tree[(".", "2023-11-15", "PUT")] == (1, 0, 10000, 1, "dir") and tree[(".", "2023-11-14", "LIST")][0] == 1
    hll = {(r["path"], r["op"]): r["n_requesters_hll"] for r in A.access_tree_distinct(log).collect()}
    assert hll[("tok", "GET")] == 2
    top = A.hot_prefixes(A.access_tree(log), 1, 1, by="bytes").collect()
    assert [(r["path"], r["bytes_out"]) for r in top] == [("tok", 9000)]


def test_plug_ins_and_daily_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text("bucket,storage_byte_hours\nb,24\n")
    assert access_logs.parse_storage_daily(spark, str(tmp_path / "d.csv")).collect()[0]["storage_byte_hours"] == "24"
    access_logs.register_parser("mine", lambda spark, path, store: spark.range(1))
    assert access_logs.parser_for("mine")(spark, "", "mine").count() == 1
    access_logs.PARSERS.pop("mine")


def test_rows_without_an_id(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "request_id string")
    assert access_logs.dedupe(rows).count() == 3 and access_logs.dedupe(rows, strict_parity=True).count() == 2


def test_s3_and_r2_logs(spark):
    line = 'own b [06/Feb/2026:00:00:38 +0000] 192.0.2.3 - RID1 REST.GET.OBJECT k/x "GET /k/x HTTP/1.1" 200 - 113 200 7 6 "-" "agent 1.0" -'
    listing = line.replace("REST.GET.OBJECT k/x", "REST.GET.BUCKET -").replace("RID1", "RID2")
    got = {r["request_id"]: r for r in access_logs.from_s3_lines(spark.createDataFrame([(line,), (listing,), ("junk",)], "value string")).collect()}
    assert got["RID1"]["op"] == "GET" and got["RID1"]["bytes_out"] == 113 and got["RID1"]["requester"] == "192.0.2.3" and got["RID1"]["user_agent"] == "agent 1.0"
    assert got["RID2"]["op"] == "LIST" and got["RID2"]["path"] == ""
    with pytest.raises(ValueError, match="nope"):
        access_logs.parser_for("nope")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/e{i % 5}/f{i}", i, i, "file") for i in range(60)], "path string, size long, mtime long, kind string")
    snap = rollup.rollup(rows, "s").cache()
    sinks.write_snapshot(snap, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.exceptAll(snap).count() == 0 and back.count() == snap.count()
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_snapshot(snap, str(tmp_path / "s"))
    sinks.write_snapshot(snap.limit(1), str(tmp_path / "s"), exists="reuse")
    assert spark.read.parquet(str(tmp_path / "s")).count() == snap.count()
    sinks.write_chunked(snap, str(tmp_path / "c"), threshold=5)
    whole = sinks.read_chunked(spark, str(tmp_path / "c")).select(*snap.columns)
    assert whole.exceptAll(snap).count() == 0 and snap.exceptAll(whole).count() == 0
    assert sinks.read_chunked(spark, str(tmp_path / "c"), "d1/e1").where("path like 'd2/%'").count() == 0
    for n in (1, 2):
        sinks.write_dated(snap.limit(n), str(tmp_path / "dated"), "b", "2026-01-01")
    sinks.write_dated(snap.limit(3), str(tmp_path / "dated"), "b", "2026-01-02")
    assert spark.read.parquet(str(tmp_path / "dated")).count() == 5
    kept = spark.createDataFrame([(1, "s", T, str(tmp_path / "s"), None, None, 1, 1, 1, 1)], "id long, path string, time timestamp, blob string, error_count int, error_paths string, size long, n_children long, n_desc long, mtime long")
    assert registry.reusable(spark, kept, "s") is not None and registry.reusable(spark, kept, "s", ["mtime_mean"]) is None and registry.reusable(spark, kept, "t") is None


def test_delete_and_refresh(spark):
    snap = rollup.rollup(spark.createDataFrame([("a/b/1", 5, 1, "file"), ("a/2", 7, 1, "file"), ("ab/3", 1, 1, "file")], "path string, size long, mtime long, kind string"), "s")
    out, gone = update.delete_subtree(snap, "a/b")
    got = {r["path"]: (r["size"], r["n_desc"], r["n_files"], r["n_children"]) for r in out.collect()}
    assert gone["size"] == 5 and gone["n_desc"] == 2
    assert got == {".": (8, 5, 2, 2), "a": (7, 2, 1, 1), "a/2": (7, 1, 1, 0), "ab": (1, 2, 1, 1), "ab/3": (1, 1, 1, 0)}
    assert update.delete_subtree(snap, "zz")[1] is None


def test_registry(spark):
    assert registry.uri_ancestors("s3://b/x/y") == ["s3://b/x/y", "s3://b/x", "s3://b"]
    assert registry.uri_ancestors("/a/b") == ["/a/b", "/a", "/"]
    cols = "id long, path string, time timestamp, blob string, error_count int, error_paths string, size long, n_children long, n_desc long, mtime long"
    day = lambda d: datetime(2026, 1, d, tzinfo=UTC)
    reg = spark.createDataFrame([(1, "/a", day(1), "", 1, '["/a/x"]', 10, 1, 1, 1), (2, "/a", day(3), "", None, None, 30, 1, 1, 1), (3, "/", day(2), "", None, None, 99, 1, 1, 1), (4, "/ab", day(9), "", None, None, 1, 1, 1, 1)], cols)
    assert registry.freshest_covering(reg, "/a/k").first()["id"] == 2
    with pytest.raises(ValueError):
        registry.freshest_covering(reg, "/a/k", 4)
    assert [r["id"] for r in registry.latest_per_path(reg).collect()] == [4, 2, 3]
    assert [(r["id"], r["size_delta"]) for r in registry.series(reg, "/a").collect()] == [(2, 20), (1, None)]
    assert [tuple(r) for r in registry.latest_two(reg).collect()] == [("/a", 1, 2)]
    assert [r["error_path"] for r in registry.error_list(reg).collect()] == ["/a/x"]
    assert registry.expired(reg, "/a", "2026-01-02").first()["id"] == 1
    rows = spark.createDataFrame([(3, "a", 8, 1, 1, 1), (3, ".", 99, 1, 1, 1)], "scan_id long, path string, size long, n_children long, n_desc long, mtime long")
    assert {(r["id"], r["size"]) for r in registry.history(reg, rows, "/a").collect()} == {(1, 10), (2, 30), (3, 8)}
    assert registry.freshest_holding(reg.where("id = 3"), rows, "/zz").count() == 0


def test_slices(spark):
    items = spark.createDataFrame([("a", 900), ("b", 60), ("c", 1), ("d", 1), ("e", 0)], "path string, size long")
    got = {(r["path"], r["size"], r["n_items"]) for r in slices.fold_small(items, 100, 10, 16).collect()}
    assert got == {("a", 900, 1), ("b", 60, 1), ("(+2)", 2, 2)}
    one_small = slices.fold_small(items.where("path <> 'd'"), 100, 10, 16).collect()
    assert {r["path"] for r in one_small} == {"a", "b", "c"}
    snap = rollup.rollup(spark.createDataFrame([("a/b/1", 5, 1, "file"), ("c", 7, 1, "file")], "path string, size long, mtime long, kind string"), "s")
    assert {r["path"]: r["tree"] for r in slices.nested_json(snap, 2).collect()} == {"a": '{"name":"a","size":5,"n_desc":3,"children":[{"name":"b","size":5,"n_desc":2}]}', "c": '{"name":"c","size":7,"n_desc":1}'}
    assert {r["path"] for r in slices.limit_rows(snap, 2).collect()} == {"a", "c"}


def test_audits(spark):
    rows = spark.createDataFrame([("b", n) for n in ["foo/bar/1", "foo/bar/2", "foo/bar/3", "foo/baz/1", "x/y/1", "top", "foo.txt"]], "bucket string, name string")
    assert {(r["prefix"], r["n_objects"]) for r in audit.prefix_weights(rows).collect()} == {("foo/", 4), ("foo/bar/", 3), ("foo/baz/", 1), ("x/", 1), ("x/y/", 1)}
    clips = spark.createDataFrame([(f"d/VID_20240101_000000_0{k}_001.{x}", 5) for k, x in [(0, "mp4"), (0, "insv"), (1, "insv")]] + [("VID_20240101_000001_00_001.mp4", 9)], "path string, size long")
    assert [(r["path"], r["size"]) for r in audit.media_pairs(clips).collect()] == [("d/VID_20240101_000000_00_001.mp4", 5)]


def test_stream_of_days(spark, tmp_path):
    at = lambda d, h=1: datetime(2026, 1, d, h, tzinfo=UTC)
    rows = [(at(1), "b", "p/x", "GET", 5, 0, "1"), (at(1), "b", "p/x", "GET", 5, 0, "1"), (at(1, 2), "b", "p/y", "GET", 7, 0, "2"), (at(3, 9), "b", "p/y", "PUT", 1, 0, "3")]
    df = spark.createDataFrame(rows, "ts timestamp, bucket string, path string, op string, bytes_out long, bytes_in long, request_id string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.run_daily_tree(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = {(r["path"], str(r["day"]), r["n_ops"], r["bytes_out"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(".", "2026-01-01", 2, 12), ("p", "2026-01-01", 2, 12), ("p/x", "2026-01-01", 1, 5), ("p/y", "2026-01-01", 1, 7)}


def test_recency_and_costs(spark):
    rows = spark.createDataFrame([("b", "p/x", "GET", T), ("b", "p/y", "PUT", T)], "bucket string, path string, op string, ts timestamp")
    assert {r["path"] for r in A.read_recency(rows).collect()} == {".", "p", "p/x"}
    costs = spark.createDataFrame([(T, "s", "k", 1, 2.5), (T, "s", "k", 2, 0.5)], "day timestamp, service string, sku string, n int, usd double")
    out = A.cost_summary(A.normalize_costs(costs, {"period": "day", "service": "service", "sku": "sku", "usage": "n", "cost": "usd"})).first()
    assert (str(out["period"]), out["usage"], out["cost"], out["n_rows"]) == ("2026-01-01", 3.0, 3.0, 2)


def test_an_unfinished_target_is_not_reused(spark, tmp_path):
    df, to = rollup.rollup(spark.createDataFrame([("a/b", 1, 1, "file")], "path string, size long, mtime long, kind string"), "s"), str(tmp_path / "s")
    sinks.write_snapshot(df, to)
    assert sinks.complete(spark, to)
    (tmp_path / "s" / "_SUCCESS").unlink()
    sinks.write_snapshot(df.where("depth = 0"), to, exists="reuse")
    assert sinks.complete(spark, to) and spark.read.parquet(to).count() == 1


def test_stream_keeps_rows_without_an_id(spark, tmp_path):
    at = datetime(2026, 1, 1, 1, tzinfo=UTC)
    rows = [(at, "b", "x", "GET", 5, 0, k) for k in ("1", "1", None, None)] + [(datetime(2026, 1, 3, 9, tzinfo=UTC), "b", "x", "GET", 1, 0, None)]
    df = spark.createDataFrame(rows, "ts timestamp, bucket string, path string, op string, bytes_out long, bytes_in long, request_id string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream.run_daily_tree(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {(r["path"], r["n_ops"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(".", 3), ("x", 3)}


def test_a_snapshot_is_computed_once_and_no_file_grows_with_it(spark, tmp_path):
    """Dealing by range must not compute the rows twice, a refused write not at all; the number of files follows the rows."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(600).select(F.lit(1).alias("depth"), F.col("id").cast("string").alias("path"), F.lit("file").alias("kind")).mapInPandas(count, "depth int, path string, kind string")
    to = str(tmp_path / "s")
    sinks.write_snapshot(rows, to, 2, file_rows=100)
    assert seen.value == 600
    with pytest.raises(AnalysisException):
        sinks.write_snapshot(rows, to)
    sinks.write_snapshot(rows, to, exists="reuse")
    assert seen.value == 600
    held = [r["n"] for r in spark.read.parquet(to).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(held) >= 5 and sum(held) == 600 and max(held) < 200


def test_columns_that_follow_from_the_path_are_not_dealt(spark, tmp_path, monkeypatch):
    from arborlake.operators import rollup as R

    rows = [("a/b/c.bin", 3, 7, "file"), ("a/b", 1, 2, "dir"), ("top.bin", 5, 1, "file"), ("a/ü x/d", 2, 2, "link"), ("empty/dir", 0, 9, "dir")]
    snap = R.rollup(spark.createDataFrame(rows, "path string, size long, mtime long, kind string"), "gcs://b1")
    stored = []
    keep = sinks.materialise
    monkeypatch.setattr(sinks, "materialise", lambda df, *a: stored.append(df.columns) or keep(df, *a))
    sinks.write_snapshot(snap, str(tmp_path / "s"), 2, derived=R.derived("gcs://b1"))
    got = spark.read.parquet(str(tmp_path / "s"))
    assert not {"parent", "uri"} & {*stored[0]} and got.columns == snap.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, snap.collect()))
