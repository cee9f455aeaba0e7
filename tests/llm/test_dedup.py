"""Exact and near deduplication, and line deduplication, against plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import exact_dedup, line_dedup, simhash

from .helpers import CLASHES, awkward, components, fingerprint, frame

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


def plain_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(BLANK)].append(r)
    out = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in members:
            out[(r[0], best[0], len(members), (r[0], len(r[1] or "")) == (best[0], len(best[1] or "")), hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    """With a digest of two values nearly all texts collide, and contents still decide."""
    digest = (lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(2)).cast("string")) if weak else None
    got = exact_dedup.exact_groups(frame(spark), salts=3, digest=digest).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain_groups(awkward())


def test_exact_keep_one(spark):
    docs = frame(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({(r[1] or "").translate(BLANK) for r in awkward()})
    assert len({(r["text"] or "").translate(BLANK) for r in rows}) == len(rows) and rows[0][CLASHES[0]] == "clash"


@pytest.mark.parametrize("heavy", [1024, 8])
def test_a_third_of_the_rows_equal_and_without_id(spark, monkeypatch, heavy):
    """Groups past the bound are looked up by broadcast, the others by a shuffle, with one result."""
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    rows = [(i, f"text {i // 2}", "en", "s", 1) for i in range(400)] + [(None, "a b", "en", "s", 1)] * 250 + [(7, "ab", "en", "s", 1)] * 90 + [(8, "x y", "en", "s", 1)] * 3
    docs = frame(spark, rows).repartition(12)
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain_groups(rows)
    kept = exact_dedup.keep_one(docs)
    found = kept.collect()
    assert kept.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in found) == Counter([(i, f"text {i // 2}") for i in range(0, 400, 2)] + [(None, "a b"), (8, "x y")])


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.keep_one(none).count() == 0
    assert simhash.simhash_components(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert line_dedup.drop_common_lines(none).count() == 0


def test_fingerprints(spark):
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1)) for r in simhash.fingerprints(frame(spark)).collect())
    assert got == Counter((r[0], fingerprint(r[1])) for r in awkward())


def test_spark_hashes_shingles_alike(spark):
    words = ["ä b c", "x", "one two three and some more to pass thirty-two bytes"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    for r in rows:
        assert simhash.shingle_hashes(r["w"], len(r["w"].split()))[0] == r["h"] & (2**64 - 1)


def test_components_of_documents(spark):
    rows = awkward()
    comp = components([fingerprint(r[1]) for r in rows])
    first = defaultdict(list)
    for c, r in zip(comp, rows, strict=True):
        first[c].append(r[0])
    least = {c: min([i for i in ids if i is not None], default=None) for c, ids in first.items()}
    got = Counter((r["doc_id"], r["component_id"], r["component_size"]) for r in simhash.simhash_components(frame(spark)).collect())
    assert got == Counter((r[0], least[c], len(first[c])) for c, r in zip(comp, rows, strict=True))


@pytest.mark.parametrize(("radius", "tile_rows"), [(3, 8192), (3, 40), (5, 60)])
@pytest.mark.parametrize("piece", [0, simhash.PIECE])
def test_links_keep_all_components(spark, radius, tile_rows, piece):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**63, 40)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for c in np.repeat(centres, 12)}
    fps |= {int(x) & ~0xFFFF for x in rng.integers(0, 2**40, 150)}  # a crowded block value
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    roots = {r["node"] & (2**64 - 1): r["root"] for r in simhash.components(simhash.near_pairs(df, radius, tile_rows), piece=piece).collect()}
    want = components(fps, radius)
    mine = defaultdict(set)
    for f, c in zip(fps, want, strict=True):
        mine[c].add(roots.get(f, f))
    assert all(len(v) == 1 for v in mine.values()) and len({next(iter(v)) for v in mine.values()}) == len(mine)


@pytest.mark.parametrize("piece", [0, 60, simhash.PIECE])
def test_long_chain_of_links(spark, piece):
    links = spark.createDataFrame([(i, i + 1) for i in range(120)], "u long, v long")
    got = simhash.components(links, piece=piece).collect()
    assert len(got) == 121 and {r["node"]: r["root"] for r in got} == dict.fromkeys(range(121), 0)
    assert simhash.components(links.limit(0), piece=piece).count() == 0


def test_near_keep_one(spark):
    docs = frame(spark)
    ids = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect() if r["doc_id"] is not None)
    comp = {}
    for r in simhash.simhash_components(docs).collect():
        comp.setdefault(r["component_id"], r["component_id"])
    assert set(ids) == {c for c in comp if c is not None} and simhash.keep_one(docs).columns == docs.columns


def plain_lines(rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    df = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")})
    out = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (key(x) and df[key(x)] >= least)]
        out[(r[0], "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    return out


@pytest.mark.parametrize("sizes", [(line_dedup.SHARD_KEYS, line_dedup.LINES_PER_TASK), (7, 3)])
@pytest.mark.parametrize("least", [10, 2])
def test_lines(spark, sizes, least):
    """In one shard, and in many of which most are copied."""
    got = line_dedup.drop_common_lines(frame(spark), min_docs=least, shard_keys=sizes[0], lines_per_task=sizes[1]).collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == plain_lines(awkward(), least)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 5000):
        place, finger = np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), rng.integers(0, 2**63, n).astype(np.uint64)
        finger = finger[: len(place)]
        shard = line_dedup.build_shard(place, finger, np.arange(len(place)) + 1)
        assert len(shard[1]) == len(place)
        assert (line_dedup.probe(shard, place, finger) == np.arange(len(place)) + 1).all()
        assert not line_dedup.probe(shard, rng.integers(0, 2**63, 100).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)).any()




def test_near_copies_at_five_words(spark):
    """Every pair at 0.8 by brute force; one changed word at the end of a short text is enough to part the fingerprints."""
    from arborlake.llm import near_copies

    rng = np.random.default_rng(5)
    rows = []
    for _ in range(25):
        words = [f"w{k}" for k in rng.integers(0, 500, rng.integers(40, 90))]
        for _ in range(4):
            copy = list(words)
            for at in rng.integers(0, len(words), rng.integers(0, 3)):
                copy[at] = "changed"
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    grams = [set(zip(*[r[1].split()[k:] for k in range(5)], strict=False)) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for i, c in enumerate(label):
        least.setdefault(c, i)
    import corpus_pipeline

    assert 25 < len(least) < 90
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, frame(spark, rows), "").collect()} == set(least.values())
    assert near_copies.keep_one(frame(spark, [])).count() == 0


def test_near_copies_are_dealt_by_fingerprints(spark):
    """Sets at a similarity of 0.8 stay together by SimHash alone, also in deals that are cut into pairs of tiles; fingerprints are plain majority votes."""
    from arborlake.llm import near_copies

    rng, sets = np.random.default_rng(3), []
    for k in range(120):
        common, one, two = [(4, 1, 0), (8, 1, 1), (40, 5, 5), (400, 50, 50)][k % 4]
        own = rng.integers(0, 2**63, common + one + two).astype(np.uint64)
        sets += [own[: common + one], np.concatenate((own[:common], own[common + one :]))]
    prints = near_copies.fingerprints(sets)
    for s, p in zip(sets[:40], prints, strict=False):
        for k in (0, near_copies.PRINTS - 1):
            hashes = near_copies._mixed(s, k).tolist()
            assert int(p[k]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    held = near_copies._printed(sets)
    rows = [(k, held["size"][k], held["prints"][k].tolist(), held["more"][k].tolist()) for k in range(len(sets))]
    df = spark.createDataFrame(rows, "row long, size long, prints array<long>, more array<int>")
    for tile_rows, deal_rows in ((2048, 8192), (4, 2), (1, 8192)):
        deals = {}
        for r in near_copies._by_blocks(df, tile_rows, deal_rows).collect():
            deals.setdefault(r["deal"], set()).add(r["row"])
        assert all(any({k, k + 1} <= d for d in deals.values()) for k in range(0, len(sets), 2))
        assert tile_rows < 2048 or all(len({k // 2 for k in d}) == 1 for d in deals.values())


def test_a_template_shared_by_thousands(spark, monkeypatch):
    """3,000 texts of one long template and own words, each with a near copy: deals that the template crowds are dealt by rare shingles."""
    from arborlake.llm import near_copies

    rng = np.random.default_rng(9)
    template, texts = [f"t{k}" for k in range(60)], []
    for k in range(1500):
        own = [f"o{k}x{j}" for j in range(30)]
        copy = [*own[:-1], f"c{k}"]
        texts += [(2 * k, [*template, *own]), (2 * k + 1, [*template, *copy])]
    texts = [texts[k] for k in rng.permutation(len(texts))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "row long, text string").repartition(4)
    crowds, dealt = [], []
    by_rarest = near_copies._by_rarest
    monkeypatch.setattr(near_copies, "_by_rarest", lambda placed, *a: crowds.append(placed.count()) or by_rarest(placed, *a))
    tiles = near_copies._tiles
    monkeypatch.setattr(near_copies, "_tiles", lambda *a: dealt.append(out := tiles(*a)) or out)
    found = simhash.components(near_copies.links(docs, tile_rows=64)).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert roots == {k: k - k % 2 for k in range(3000)}
    assert crowds and dealt[0].count() < 100_000  # pairs of tiles over all rows would be 3000 * 24 * 47 rows


def test_every_distinct_line_is_indexed(spark):
    keys = {k for r in awkward() for k in line_dedup.line_keys(r[1]) if k}
    counts = line_dedup.key_counts(frame(spark))
    index = line_dedup.build_index(counts, 3).collect()
    assert sum(r["n"] for r in index) == len(keys) == counts.count()
    assert sum(r["load"] for r in index) == sum(len({k for k in line_dedup.line_keys(r[1]) if k}) for r in awkward())


def test_a_hot_shard_is_shared_out(spark):
    """One line in every text and copies of one text: the hot shard's hashes go to its copies, the others' to one each."""
    long = "\n".join(["everywhere", *[f"line {k}" for k in range(40)] * 3])
    docs = frame(spark, [(k, long, "en", "s", 1) for k in range(400)] + [(k, f"everywhere\nown {k}", "en", "s", 1) for k in range(1000, 1800)] + [(1, None, "en", "s", 1)])
    index = line_dedup.build_index(line_dedup.key_counts(docs), 200)
    keyed = docs.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(7), "text"))
    sent, copies = line_dedup._shared_out(line_dedup._sent(keyed, 200), index, 500)
    sizes = [r["count"] for r in sent.groupBy("shard", "salt").count().collect()]
    assert sum(sizes) < 2000 and max(sizes) < 450  # 401 texts of 41 lines are sent once a task; 801 hashes of one line are shared out
    assert 200 > copies.count() - index.count() > 0
    got = line_dedup.drop_common_lines(docs, shard_keys=20, lines_per_task=500)
    assert Counter(tuple(r) for r in got.collect()) == plain_lines([tuple(r) for r in docs.select("doc_id", "text").collect()], 10)


def test_rows_not_ids_are_removed(spark):
    """Null and repeated ids on copies, clean texts and contaminated ones."""
    import corpus_pipeline
    from arborlake.llm import decontamination

    from .helpers import BASE, ITEM

    other = " ".join(f"n{k}" for k in range(40))
    texts = [(1, BASE), (None, BASE), (None, "clean one"), (None, "a second clean text"), (2, other), (2, other), (2, "under the id of two more")]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in texts])
    want = Counter([(1, BASE), (None, "clean one"), (None, "a second clean text"), (2, other), (2, "under the id of two more")])
    for kept in (simhash.keep_one(docs), corpus_pipeline.near(spark, docs, "")):
        assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    mixed = frame(spark, [(i, t, "en", "s", 1) for i, t in [(None, ITEM), (None, "clean"), (3, ITEM), (3, "clean")]])
    assert Counter((r["doc_id"], r["text"]) for r in decontamination.drop_contaminated(mixed, bench).collect()) == Counter([(None, "clean"), (3, "clean")])


def test_texts_are_dealt_by_row_once(spark):
    """Joins on row move the other side only; the catalog forgets the table that knows the buckets."""
    from arborlake.llm import near_copies

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = frame(spark)
        rows = simhash.numbered(docs, dealt=True)
        close = rows.where("row % 3 = 0").groupBy("row").count()
        for how in ("left_semi", "left_anti"):
            met = rows.join(close, "row", how)
            plan = met._jdf.queryExecution().executedPlan().toString()
            assert "doc" not in "".join(x for x in plan.splitlines() if "Exchange" in x) and plan.count("Exchange hashpartitioning") <= 1
            assert met.count() == rows.where(f"row % 3 {'=' if how == 'left_semi' else '<>'} 0").count()
        assert sorted(map(str, rows.select("doc.doc_id", "doc.text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("arborlake_")]
        kept = near_copies.keep_one(docs)
        assert kept.columns == docs.columns and kept.count() == len({str(r["doc_id"]) + str(r["text"]) for r in kept.collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
