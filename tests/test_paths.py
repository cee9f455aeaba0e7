import pytest

from arborlake.functions import paths as P
from arborlake.functions import scalars as S
from pyspark.sql import functions as F


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "key"), [("a//b", "a/b"), ("a/b/", "a/b"), ("/a", "/a"), ("a///", "a"), ("a\n//b", "a\n/b")])
def test_canonical_key(spark, name, key):
    assert one(spark, P.canonical_key("p"), p=name) == key


@pytest.mark.parametrize(("path", "parent", "depth", "base"), [("a", "", 1, "a"), ("a/b", "a", 2, "b"), ("/a", "", 2, "a"), (".", "", 0, "."), ("é/日本", "é", 2, "日本")])
def test_parts(spark, path, parent, depth, base):
    assert one(spark, F.struct(P.parent_of("p"), P.depth_of("p"), P.basename("p")), p=path) == (parent, depth, base)


def test_ancestors(spark):
    assert one(spark, P.ancestors("p"), p="a/b/c") == ["", "a", "a/b"]
    assert one(spark, P.ancestors("p", own=True), p="a") == ["", "a"]
    assert one(spark, P.ancestors("p", own=True), p="") == [""]


def test_prefix_is_exact_and_pushed_down(spark, tmp_path):
    rows = [(p, 0) for p in ["foo", "foo/a.txt", "foo/b.txt", "foo!x", "foo.bak", "foo0", "foobar"]]
    spark.createDataFrame(rows, "path string, n int").write.parquet(str(tmp_path / "t"))
    df = P.subtree(spark.read.parquet(str(tmp_path / "t")), "foo")
    assert sorted(r["path"] for r in df.collect()) == ["foo", "foo/a.txt", "foo/b.txt"]
    assert "PushedFilters: [Or(" in df._jdf.queryExecution().toString().replace("PushedFilters: [IsNotNull(path),", "PushedFilters: [")


def tree(spark, paths):
    from arborlake.operators import rollup

    rows = spark.createDataFrame([(p, i + 1, 0, "file") for i, p in enumerate(paths)], "path string, size long, mtime long, kind string")
    return rollup.rollup(rows, "s")


def test_rebase_and_graft_are_inverse(spark):
    t = tree(spark, ["a/b/c/1", "a/b/2", "a/3", "z"])
    sub = P.rebase(t, "a/b")
    assert {(r["path"], r["parent"], r["depth"]) for r in sub.collect()} == {(".", "", 0), ("c", ".", 1), ("c/1", "c", 2), ("2", "", 1)}
    back = P.graft(sub, "a/b").select("path", "depth")
    want = P.subtree(t, "a/b").select("path", "depth")
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    assert P.rebase(t, "a/b", keep_root=False).where("path = '.'").count() == 0


def test_nested_prefixes(spark):
    df = spark.createDataFrame([(p,) for p in ["a", "a/b", "a/b/c", "ab", "x/y", "a"]], "path string")
    assert sorted(r["path"] for r in P.outermost(df).collect()) == ["a", "ab", "x/y"]
    assert {(r["path"], r["kept_by"]) for r in P.nested(df).collect()} == {("a/b", "a"), ("a/b/c", "a")}


def test_chains(spark):
    got = {r["path"]: (r["chain_end"], r["label"]) for r in P.chains(tree(spark, ["a/b/c/d/1", "a/b/c/d/2", "k/1", "k/m/2"])).collect()}
    assert got["a"] == ("a/b/c/d", "a/b/c/d") and got["a/b"] == ("a/b/c/d", "b/c/d") and got["k"] == ("k", "k") and got["."] == (".", ".")


def test_exclusion(spark):
    t = tree(spark, ["a/1", "ab/2", "c/d/3"])
    assert sorted(r["path"] for r in P.outside(t, ["a", "c/d"]).collect()) == [".", "ab", "ab/2", "c"]
    by_table = P.outside_of(t, spark.createDataFrame([("a",), ("c/d",)], "path string"))
    assert sorted(r["path"] for r in by_table.collect()) == [".", "ab", "ab/2", "c"]


@pytest.mark.parametrize(("url", "canon", "parent"), [
    ("/a/b/", "/a/b", "/a/b"), ("/", "/", None), ("s3://bkt/k/", "s3://bkt/k", "s3://bkt/k"), ("s3://bkt/k", "s3://bkt/k", "s3://bkt"), ("gcs://bkt", "gcs://bkt", None),
    ("me@host:/x/y", "ssh://me@host/x/y", "ssh://me@host/x"), ("ssh://me@host:22/x", "ssh://me@host:22/x", "ssh://me@host:22"),
])
def test_urls(spark, url, canon, parent):
    assert one(spark, F.struct(P.canonical_url("p"), P.url_parent("p")), p=url) == (canon, parent)


@pytest.mark.parametrize(("method", "operation", "want"), [("GET", "LIST_Bucket", "LIST"), ("GET", "GET_Object", "GET"), ("GET", "WEIRD_OP", "OTHER"), ("put", "", "PUT"), ("POST", "POST_Object", "PUT"), ("x", "List_Buckets", "LIST"), ("DELETE", "", "DELETE"), ("HEAD", "", "HEAD"), ("OTHER", "", "OTHER"), ("GET", "GET_Bucket", "GET")])
def test_verbs(spark, method, operation, want):
    assert one(spark, S.verb(F.lit(method), F.lit(operation))) == want


def test_scores(spark):
    assert one(spark, S.staleness(F.lit(2e12), F.lit(0.0), F.lit(365.25 * 86400))) == pytest.approx(2.0)
    assert one(spark, S.staleness(F.lit(2e12), F.lit(None).cast("double"), F.lit(1))) is None
    edges, bins = F.array(*[F.lit(x) for x in (0, 10, 20)]), F.array(F.lit(100), F.lit(50))
    assert [one(spark, S.bytes_older_than(edges, bins, F.lit(t))) for t in (0, 5, 10, 15, 99)] == [0, 50, 100, 125, 150]
    assert one(spark, S.log_domain(F.lit(3.0), F.lit(250.0))) == [1.0, 1000.0]
    assert one(spark, S.log_domain(F.lit(10.0), F.lit(10.0))) == [1.0, 100.0]
    assert one(spark, S.decades_between(F.lit(0.5), F.lit(20.0))) == [1.0, 10.0]
    assert len(one(spark, S.decades_between(F.lit(1e-9), F.lit(1e9)))) <= 5


def test_long_chains_and_ages(spark):
    deep = "/".join("abcdefghijk"[k % 11] for k in range(70))
    got = {r["path"]: r["chain_end"] for r in P.chains(tree(spark, [f"{deep}/1", f"{deep}/2"])).collect()}
    assert set(got.values()) == {deep} and len(got) == 71
    rows = spark.createDataFrame([("g", 5), ("g", 9), ("g", None), (None, 3), (None, 3)], "k string, t long")
    assert sorted((r["k"] or "", r["t"] or 0, r["age01"]) for r in S.with_age01(rows, "t", ["k"]).where("t is not null").collect()) == [("", 3, 0.0), ("", 3, 0.0), ("g", 5, 1.0), ("g", 9, 0.0)]
    assert sorted(r["age01"] for r in S.with_age01(rows, "t").where("t is not null").collect()) == [0.0, pytest.approx(4 / 6), 1.0, 1.0]
