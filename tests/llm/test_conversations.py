"""Conversation repair, the prefix trie and top-k search against plain versions, with nulls, ties, repeats and long keys."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import conversation_repair, prefix_trie, vector_search
from arborlake.llm.conversation_repair import END, _before, _walk

from .helpers import rng

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHES = ["piece", "at", "n", "c", "k", "here", "late", "said", "first", "base", "h", "p", "q", "depth", "weight", "row", "same", "entry", "query"]
BLANKS = " \t\n\x0b\x0c\r"


def clash(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


def talks(seed=0, convs=220):
    """Conversations with nulls, empty and blank texts, odd roles, gaps, ties of turn and whole repeats."""
    g, rows = rng(seed), []
    for c in range(convs):
        c = None if c == 7 else c - 3
        for t in range(int(g.integers(1, 9))):
            role = g.choice(["user", "assistant", "system", "tool", "", None], p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05])
            text = g.choice(["Yes.", "No!", "so", "a longer. text", "", " \n", "..", None, "what?\t", "同じ。", "x"])
            turn = None if g.random() < 0.05 else int(t + (g.random() < 0.1) * 3)
            rows += [(c, turn, role, text)] * (1 + (g.random() < 0.1))
    return rows + [(1000, t, "user" if t % 2 == 0 else "assistant", f"line {t % 7}." if t % 5 else f"line {t}") for t in range(300)] + [(1001, None, "user", "same.")] * 120


def crc(text):
    return zlib.crc32(text.encode())


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        f = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f == 0:
            continue
        text = "" if f == 1 else "".join(x for x in text if x not in ".!?") if f == 2 else text
        out += [(c, t, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def plain_repair(rows, known):
    """Every way is tried; (cost, audit) is compared as a whole."""
    by = defaultdict(list)
    for c in known:
        by[c] = []
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for c, rs in by.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, coded, count = set(), [], Counter()
        for _, _, role, text in rs:
            bare = text.rstrip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[1] for r in rs} - {None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))

        def nexts(s):
            return {"": "su", "s": "u", "u": "a", "a": "u"}[s]

        @lru_cache(None)
        def best(i, s, inserted=0):
            ways = [(0, "")] if i == len(coded) and s in ("", "a") else []
            if inserted < 2:
                ways += [(3 + k, "I" + a) for x in nexts(s) if x != "s" for k, a in [best(i, x, inserted + 1)]]
            if i < len(coded):
                initial, must_go, late = coded[i]
                k, a = best(i + 1, s)
                ways.append((4 + k, "D" + a))
                if not must_go:
                    for x in nexts(s):
                        k, a = best(i + 1, x)
                        if x == initial:
                            ways.append((3 * late + k, "K" + a))
                        if x != "s":
                            ways.append((3 + 3 * late + k, "R" + a))
            return min(ways, default=(math.inf, ""))

        import sys

        sys.setrecursionlimit(20_000)
        cost, audit = best(0, "")
        s, i, lines = "", 0, []
        for e in audit:
            if e == "D":
                i += 1
                continue
            role = {"u": "user", "a": "assistant"}[nexts(s)[-1]] if e in "IR" else rs[i][2]
            lines.append(f"{role}:{'' if e == 'I' else rs[i][3]}")
            s, i = role[:1], i + (e != "I")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def told(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("piece", [4096, 16])
def test_repair_against_all_ways(spark, piece):
    """With pieces of 16 rows the two long conversations, one of a single repeated row, are settled in pieces."""
    rows = talks()
    df = clash(spark.createDataFrame(rows, SCHEMA))
    got = conversation_repair.repair(conversation_repair.damage(df), df, piece)
    assert got.count() == len({r[0] for r in rows})
    assert told(got) == plain_repair(plain_damage(rows), {r[0] for r in rows})


def test_repaired_turns_are_legal(spark):
    import re

    df = spark.createDataFrame(talks(3, 60), SCHEMA)
    rows = conversation_repair.repaired_turns(conversation_repair.damage(df), 16).orderBy("conv_id", "piece", "at").collect()
    roles = defaultdict(str)
    for r in rows:
        roles[r["conv_id"]] += r["role"][:1]
    assert roles and all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def test_a_long_conversation_is_walked_in_blocks():
    """The checkpointed walk costs what the cost vector says, on 20,000 rows."""
    g = rng(1)
    rows = [(str(g.choice(list("suatx"))), bool(g.random() < 0.1), bool(g.random() < 0.2)) for _ in range(20_000)]
    v = END
    for r in reversed(rows):
        v = _before(r, v)
    audit, left, _ = _walk(rows, 0, END, True)
    assert v[0] == 4 * audit.count("D") + 3 * audit.count("I") + 3 * audit.count("R") + 3 * sum(i is not None and rows[i][2] for i, _ in left)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(conversation_repair.damage(none), none).count() == 0
    gone = next(c for c in range(1000) if crc(f"{c}:0") % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert told(conversation_repair.repair(conversation_repair.damage(df), df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def plain_trie(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    by = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, own in by.items():
        h = crc(str(c)) % 6
        whole[c] = by.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = Counter()
    for k, cs in members.items():
        below, stack = [], [k]
        while stack:
            below.append(stack.pop())
            stack += kids[below[-1]]
        saved = sum((len(members[b]) - 1) * (len(b[-1][1].decode()) if b else 0) for b in below)
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(k))
        out[(min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(kids[k]), sum(not kids[b] for b in below), saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("most,chunk", [(4096, 1 << 20), (16, 40)])
def test_trie_against_a_plain_one(spark, most, chunk):
    """A third of the conversations are one; with 16 rows a block, long conversations are ranked and totalled in blocks."""
    rows = [r for r in talks(5, 150) if r[0] is None or r[0] != 1001] + [(5000 + c, t, "user", f"hot {t}") for c in range(120) for t in range(3)]
    rows += [(-150, 0, "user", "below zero"), (3000, 0, "user", "a base"), (3000, 1, "assistant", "of two")] + [(c, 0, "user", "alone") for c in range(3001, 3020)]
    got = prefix_trie.prefix_trie(clash(spark.createDataFrame(rows, SCHEMA)), most, chunk)
    assert got.columns == TRIE
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def plain_top(rows, k=5):
    fine = [(v, [math.floor(256 * float(x)) for x in e]) for v, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for a, (v, q) in enumerate(fine):
        if v is None or math.fmod(v, 50):
            continue
        scored = [(-sum(x * y for x, y in zip(q, e, strict=False)), w is None, w or 0, b) for b, (w, e) in enumerate(fine) if b != a]
        for n, (s, none, w, _) in enumerate(sorted(scored)[:k], 1):
            out[(v, n, None if none else w, -s)] += 1
    return out


def vectors():
    g = rng(2)
    near = [(i, [float(np.float32(x)) for x in g.normal(0, 0.3, 8)]) for i in range(400)]
    hot = [(1000 + i, [0.5, -0.25, 0.125, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(250)]
    odd = [(50, None), (100, [1.0] * 7 + [float("nan")]), (150, [1.0] * 7 + [None]), (200, [float("inf")] * 8), (None, [0.1] * 8), (None, [0.2] * 8), (2000, []), (2050, [0.0] * 8), (2100, [0.3, 0.1]), (0, near[0][1]), (0, near[0][1]), (-50, near[3][1]), (2150, [900.0] * 8)]
    return near + hot + odd


@pytest.mark.parametrize("tile,block,cells", [(2048, 2048, 256), (16, 7, 256), (64, 4, 2)])
def test_top_k_against_all_pairs(spark, tile, block, cells):
    df = clash(spark.createDataFrame(vectors(), "vec_id long, embedding array<float>"))
    got = vector_search.top_k(df, tile=tile, block=block, cells=cells)
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top(rows)


def test_few_exact_vectors_are_read():
    """On spread-out vectors the cells leave few of a tile to be read."""
    g = rng(4)
    exact = g.integers(-150, 150, (2000, 64)).tolist()
    (tile,) = [b.to_pylist()[0] for b in vector_search._write_tiles(2048, 256)(iter([_batch(exact)]))]
    best = [vector_search._Best(6) for _ in range(40)]
    read = vector_search.search_tile(np.array(exact[:40], np.int64), best, tile, read=8)
    assert read < 0.05 * 40 * 2000
    assert all(held.rows[0][2] == k for k, held in enumerate(best))


def _batch(exact):
    import pyarrow as pa

    n = list(range(len(exact)))
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(n, pa.int64()), pa.array(exact, pa.list_(pa.int32()))], names=["row", "first", "ints"])


def test_top_k_of_nothing(spark):
    kind = "vec_id long, embedding array<float>"
    assert vector_search.top_k(spark.createDataFrame([], kind)).count() == 0
    assert vector_search.top_k(spark.createDataFrame([(0, [1.0])], kind)).count() == 0
    assert vector_search.top_k(spark.createDataFrame([(1, [1.0]), (2, [2.0])], kind)).count() == 0
    assert [tuple(r) for r in vector_search.top_k(spark.createDataFrame([(0, [1.0]), (3, [2.0])], kind)).collect()] == [(0, 1, 3, 256 * 512)]
