"""Packing: exact round trip through the tokenizer. Sharding: the ring's rules, row by row."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import packing, sharding

from .helpers import awkward, frame


def true_ids(text):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_tokens_are_the_public_tokenizers():
    encode = packing.encoder(*packing.vocabulary()).encode_ordinary
    for text in ["", " ", "\n\n a  b\t", "naïve café 日本語 😀", "it's they'll 'tis", "a_b-c d.e <|endoftext|> x", "1234 5,6 ٣", "x" * 5000, "  y"]:
        assert [*encode(text), 0] == true_ids(text)


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (25, [(0, 5), (5, 10), (15, 10)]), (20, [(0, 10), (10, 10)])])
def test_cut(n, want):
    assert packing.cut(n, 10) == want


@pytest.mark.parametrize("length", [2048, 64])
def test_round_trip(spark, length):
    rows = [(i, t, lang, s, n) for i, (_, t, lang, s, n) in enumerate(awkward())]
    ids = {r[0]: true_ids(r[1]) for r in rows}
    got = packing.pack(frame(spark, rows), length=length, block=16).collect()
    whole, bins = defaultdict(dict), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        whole[r["doc_id"]][r["piece"]] = (r["start"], r["length"])
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: [p[k] for k in range(len(p))] for d, p in whole.items()} == {d: packing.cut(len(x), length) for d, x in ids.items()}
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    assert len(bins) <= -(-sum(map(len, ids.values())) // length) + 2


def test_repeated_rows_and_empty_table(spark):
    assert packing.pack(frame(spark)).count() >= len(awkward())
    assert packing.pack(frame(spark, [])).count() == 0


def test_operators_keep_every_piece():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 2048, 400))
    population = packing.first_population(sizes, 3, rng)
    for _ in range(5):
        child = packing.crossover(sizes, population[0], population[2], rng)
        fill = np.bincount(child, weights=sizes)
        assert len(child) == len(sizes) and child.min() >= 0 and fill.max() <= 2048 and fill.min() > 0
    best = packing.evolve(sizes, population, rng, 5)[0]
    assert packing.fitness(sizes, best) <= min(packing.fitness(sizes, p) for p in population)


def test_well_filled_bins_are_inherited():
    sizes = np.array([2048 // 2] * 8)
    mine, other = np.array([0, 1, 2, 3, 4, 5, 6, 7]), np.array([0, 0, 1, 1, 2, 2, 3, 3])
    child = packing.crossover(sizes, mine, other, np.random.default_rng(0))
    assert len(set(child.tolist())) < 8


def hard_sizes(seed=3, n=400):
    """Two or three pieces fill a sequence, so best fit by falling size leaves many of them half empty."""
    return np.sort(np.random.default_rng(seed).integers(500, 900, n))


def test_islands_better_best_fit():
    for seed in (3, 4, 5):
        sizes = hard_sizes(seed)
        rng = np.random.default_rng(seed)
        population = packing.first_population(sizes, packing.POPULATION, rng)
        best = packing.evolve(sizes, population, rng, packing.EPOCHS * packing.GENERATIONS)[0]
        assert packing.fitness(sizes, population[0])[0] - packing.fitness(sizes, best)[0] >= 3


def test_packing_betters_best_fit(spark):
    """The whole operator on lengths where best fit by falling size stays above the bound."""
    sizes = hard_sizes()
    rows = [(i, "a" + " a" * (int(n) - 2), "en", "s", 1) for i, n in enumerate(sizes)]
    got = packing.pack(frame(spark, rows)).collect()
    assert sorted(r["length"] for r in got) == sizes.tolist()
    falling = packing.best_fit(sizes, np.full(len(sizes), -1, np.int64), np.argsort(-sizes, kind="stable"))
    assert len({r["sequence_id"] for r in got}) <= int(falling.max()) + 1 - 3


def test_repeated_rows_spread_over_blocks(spark):
    got = packing.pack(frame(spark, [(7, "the same text", "en", "s", 1)] * 300), length=64, block=16).collect()
    assert len(got) == 300 and len({r["sequence_id"] // 2**32 for r in got}) > 8


def test_ring_rules(spark):
    rows = [(i, f"text {i % 7}", "en", "s", 1) for i in range(997)] + [(None, None, None, None, None)] * 3
    got = sharding.assign_shards(frame(spark, rows), virtual=16, cells=256).collect()
    assert len(got) == 1000
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(len(v) for v in by.values()) == [125] * 8 and all(sorted(v) == list(range(125)) for v in by.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None} == {(1, 0)}
    assert all(r["size"] == len(f"text {r['doc_id'] % 7}") + 1 and r["text_crc32"] == zlib.crc32(f"text {r['doc_id'] % 7}".encode()) for r in got if r["doc_id"] is not None)
    assert sum(r["shard"] != r["ring_shard"] for r in got) < 250


def test_a_third_of_the_rows_equal_and_without_id(spark):
    """Their cell is cut into parts of a bounded size; slots stay gapless and counts even."""
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(2000)] + [(None, "the same text", "en", "s", 1)] * 1000
    docs = frame(spark, rows)
    got = sharding.assign_shards(docs, virtual=16, cells=256).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == [375] * 8 and all(sorted(v) == list(range(375)) for v in by.values())
    assert sum(r["doc_id"] is None for r in got) == 1000 and len({r["doc_id"] for r in got}) == 2001
    cells = spark.range(3000).select(F.when(F.col("id") < 1000, 5).otherwise(F.col("id") % 256).cast("int").alias("cell"), F.col("id").alias("row"))
    cut, counts = sharding.cut(cells, 256)
    assert sum(counts.values()) == 3000 and max(counts.values()) < 1.7 * 4 * 12 and len(counts) <= 256 + 2 * 256 // sharding.CROWD
    assert {(r["cell"], r["part"]): r["count"] for r in cut.groupBy("cell", "part").count().collect()} == counts


def test_filling_is_the_ring_walk():
    """A row is only ever on a shard if all shards before it on its way are full."""
    rng = np.random.default_rng(3)
    order = sharding.ring(5, 8, 64)
    counts = {c: int(rng.integers(0, 9)) for c in range(64)}
    n = sum(counts.values())
    room = sharding.bounds(n, 5)
    runs = sharding.fill(counts, order, room)
    load = [sum(r[2] for r in runs if r[3] == s) for s in range(5)]
    assert load == room and max(room) - min(room) <= 1
    for cell, _, _, shard, _ in runs:
        for before in order[cell][: order[cell].index(shard)]:
            assert load[before] == room[before]
    for cell in counts:
        ranks = sorted(k for c, first, m, _, _ in runs if c == cell for k in range(first, first + m))
        assert ranks == list(range(counts[cell]))


def test_one_more_shard_moves_few():
    a, b = sharding.ring(8), sharding.ring(9)
    moved = sum(x[0] != y[0] for x, y in zip(a, b, strict=True)) / len(a)
    assert moved < 0.16 and all(y[0] == 8 for x, y in zip(a, b, strict=True) if x[0] != y[0])
    with pytest.raises(ValueError):
        sharding.fill({0: 5}, sharding.ring(2, 2, 4), [1, 1])


def test_sharding_of_nothing(spark):
    assert sharding.assign_shards(frame(spark, [])).count() == 0
    assert sharding.assign_shards(frame(spark)).count() == len(awkward())


def test_added_tokens_are_one_id(spark):
    """The ids of the tokenizer file at its default settings."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["x<|endoftext|>", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext |>", " <|ENDOFTEXT|>", "no such token", ""]
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(frame(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)])).collect()}
    for i, x in enumerate(texts):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
