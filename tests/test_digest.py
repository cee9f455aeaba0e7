"""Merkle digests against plain trees, and moves against a walk from the highest subtrees down."""

import random
from collections import defaultdict

import pytest

from arborlake.operators import digest as D

SCHEMA = "path string, size long"


def plain(files):
    """path -> (content, size, n_files, height); the content is the sorted multiset of children, in full."""
    kids, dirs = defaultdict(list), {""}
    for p, s in files:
        up = p.rpartition("/")[0]
        kids[up].append((p.rpartition("/")[2], s or 0))
        while up not in dirs:
            dirs.add(up)
            up = up.rpartition("/")[0]
    subs = defaultdict(set)
    for d in dirs - {""}:
        subs[d.rpartition("/")[0]].add(d)
    out = {}

    def of(d):
        below = [(s.rpartition("/")[2], of(s)) for s in subs[d]]
        content = (tuple(sorted(kids[d])), tuple(sorted((n, b[0]) for n, b in below)))
        out[d or "."] = (content, sum(s for _, s in kids[d]) + sum(b[1] for _, b in below), len(kids[d]) + sum(b[2] for _, b in below), max((b[3] + 1 for _, b in below), default=0))
        return out[d or "."]

    of("")
    return out


def plain_moves(a, b):
    gone, new = {p for p in a if p not in b}, {p for p in b if p not in a}
    found = {}
    for h in sorted({a[p][3] for p in gone}, reverse=True):
        left, right = defaultdict(list), defaultdict(list)
        for side, rows, into, tops in ((gone, a, left, set(found)), (new, b, right, set(found.values()))):
            for p in sorted(side):
                if rows[p][3] == h and not any(p.startswith(t + "/") for t in tops):
                    into[rows[p][0]].append(p)
        for content, ps in left.items():
            found |= dict(zip(ps, right.get(content, []), strict=False))
    return {(p, q, a[p][1], a[p][2]) for p, q in found.items()}


def forest(rng, n=40):
    return [("/".join(rng.choice("abc") for _ in range(rng.randint(0, 4))).strip("/") + rng.choice(["/f", "/g", "/f"]), rng.randint(0, 2)) for _ in range(n)]


def tidy(files):
    return [(p.lstrip("/"), s) for p, s in files]


@pytest.mark.parametrize("seed", range(4))
def test_digests_group_equal_subtrees(spark, seed):
    """Also of files that stand twice, which an exclusive-or would lose."""
    files = tidy(forest(random.Random(seed), 60))
    want = plain(files)
    got = {r["path"]: r for r in D.directory_digests(spark.createDataFrame(files, SCHEMA).repartition(3)).collect()}
    assert {p: (r["size"], r["n_files"], r["height"]) for p, r in got.items()} == {p: v[1:] for p, v in want.items()}
    by_digest, by_content = defaultdict(set), defaultdict(set)
    for p in want:
        by_digest[got[p]["digest"]].add(p)
        by_content[want[p][0]].add(p)
    assert sorted(map(sorted, by_digest.values())) == sorted(map(sorted, by_content.values()))
    assert all(len(d) == 32 for d in by_digest)


@pytest.mark.parametrize("seed", range(4))
def test_moves_against_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    before = tidy(forest(rng, 50))
    swap = {x: rng.choice([x, x, x, f"new{x}"]) for x in ("a/a", "a/b", "b", "b/c", "c/a", "c/b/a")}
    after = []
    for p, s in before:
        for old in sorted(swap, key=len, reverse=True):
            if p.startswith(old + "/"):
                p = swap[old] + p[len(old) :]
                break
        if rng.random() < 0.97:
            after.append((p, s))
    digests = [D.directory_digests(spark.createDataFrame(f, SCHEMA)) for f in (before, after)]
    assert {tuple(r) for r in D.moved(*digests).collect()} == plain_moves(plain(before), plain(after))


def test_repeated_content_is_paired_in_order(spark):
    before = [(f"old/{k}/f", 1) for k in range(5)]
    after = [(f"z{k}/f", 1) for k in range(3)] + [("y/keep", 2)]
    got = D.moved(*[D.directory_digests(spark.createDataFrame(f, SCHEMA)) for f in (before, after)]).collect()
    assert {(r["path_from"], r["path_to"]) for r in got} == {(f"old/{k}", f"z{k}") for k in range(3)}


def test_nothing_moved_and_nothing_there(spark):
    a, none = spark.createDataFrame([("/lead/x", 1), ("p/q", None)], SCHEMA), spark.createDataFrame([], SCHEMA)
    d, e = D.directory_digests(a), D.directory_digests(none)
    assert D.moved(d, d).count() == 0 and D.moved(d, e).count() == 0
    assert [(r["path"], r["n_files"], r["height"]) for r in e.collect()] == [(".", 0, 0)]
    assert {r["path"]: r["height"] for r in d.collect()} == {".": 1, "/lead": 0, "p": 0}
