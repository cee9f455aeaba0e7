"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a document's word
shingles. Fingerprints that differ in at most ``radius`` bits are linked, and linked documents form
components.

All links are found. Two fingerprints within the radius agree, in at least one of four 16-bit
blocks, up to ``radius // 4`` bits, so fingerprints are dealt by (block, value) and, for a radius of
4 or more, also to the values within that many bits. Inside a deal they are sorted by population
count and cut into tiles; tile pairs whose population counts differ by more than the radius are
skipped, the others are compared with numpy's exclusive-or and bit counts. A deal with more than
``TILE_ROWS`` fingerprints is split into tile pairs of their own, each a separate row group for
Spark, so a crowded block value is shared out among tasks. Each task reduces its links to a forest,
which keeps components and bounds what it emits by its number of fingerprints.

Components come from alternating large-star and small-star rounds, each written to the shared
folder. Once no more than ``PIECE`` links are left, one task settles them. Only distinct fingerprints
take part, so copies cost nothing here.

Defined results: null or blank text has fingerprint zero, which links like any other; a null
``doc_id`` takes part in its component but never names it unless all its ids are null; repeated rows
are repeated in the result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_step, lower_ascii, materialise, partitions, ship, text_chunks

SHINGLE, RADIUS, SEED = 3, 3, 42
TILE = 1024
TILE_ROWS = 8192
#: Links of 16 bytes that one task may settle alone.
PIECE = 250_000


def shingle_hashes(text: str | None, width: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter."""
    words = lower_ascii(text or "").split()  # at runs of 20 and 09-0D
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of hashes, as unsigned 64-bit."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, int(sizes.sum()))
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # runs of at most 255 rows can be summed in bytes; their sums are then added per document
    n = sizes[full]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    runs = -(-n // 255)
    run_doc = np.repeat(np.arange(len(full)), runs)
    run_no = np.arange(len(run_doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    partial = np.add.reduceat(bits, first[run_doc] + 255 * run_no, axis=0, dtype=np.uint8)
    counts = np.add.reduceat(partial.astype(np.int32), np.cumsum(runs) - runs, axis=0)
    packed = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little")
    out[full] = packed.view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in text_chunks(texts):
                fp = majority([shingle_hashes(t, width) for t in texts[a:b]])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].to_numpy(), "fp": fp.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id string, fp long").select(F.col("doc_id").cast("long").alias("doc_id"), "fp")


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link per node, to the component's smallest member."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def close_pairs(fps: np.ndarray, radius: int, tile: int = TILE):
    """Pairs of positions within the radius, a tile pair at a time."""
    pop = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    f, p = fps[order], pop[order]
    for i in range(0, len(f), tile):
        a = f[i : i + tile]
        for j in range(i, len(f), tile):
            if p[j] - p[min(i + tile, len(f)) - 1] > radius:
                break
            near = np.bitwise_count(a[:, None] ^ f[None, j : j + tile]) <= radius
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                yield order[i + x], order[j + y]


def _links(deal: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each deal, as a forest. Small deals are one tile each and are compared all at once, by distance."""
    pop = np.bitwise_count(fps).astype(np.int64)
    order = np.lexsort((pop, deal))
    deal, fps, pop = deal[order], fps[order], pop[order]
    starts = np.flatnonzero(np.concatenate(([True], deal[1:] != deal[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(deal)])))
    us, vs, held, most = [], [], 0, 2_000_000

    def take(u, v):
        nonlocal us, vs, held, most
        us.append(u)
        vs.append(v)
        held += len(u)
        if held > most:
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held, most = [u], [v], len(u), max(most, 2 * len(u))

    small = np.repeat(sizes <= 48, sizes)
    d, f, p = deal[small], fps[small], pop[small]
    for step in range(1, int(sizes[sizes <= 48].max(initial=1))):
        pair = np.flatnonzero((d[:-step] == d[step:]) & (p[step:] - p[:-step] <= radius))
        hit = pair[np.bitwise_count(f[pair] ^ f[pair + step]) <= radius]
        take(f[hit], f[hit + step])
    for at in np.flatnonzero(sizes > 48):
        own = fps[starts[at] : starts[at] + sizes[at]]
        for x, y in close_pairs(own, radius):
            take(own[x], own[y])
    return _forest(np.concatenate(us), np.concatenate(vs)) if held else (np.zeros(0, np.uint64),) * 2


def near_pairs(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links u, v between distinct fingerprints that keep the components of all pairs within the radius."""
    ship(fps.sparkSession)
    slack = radius // 4
    masks = [m for k in range(slack + 1) for m in (sum(1 << b for b in c) for c in combinations(range(16), k))]
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fp", 16 * b).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("value")) for b in range(4)])
    dealt = fps.select("fp", F.explode(blocks).alias("b"))
    values = F.array(*[F.lit(m) for m in masks]) if slack else None
    value = F.col("b.value") if values is None else F.col("b.value").bitwiseXOR(F.col("mask"))
    if values is not None:
        dealt = dealt.select("fp", "b", F.explode(values).alias("mask"))
    dealt = dealt.select("fp", (F.col("b.block") * 65536 + value).alias("deal"))
    # a crowded deal becomes k * (k + 1) / 2 tile pairs; its fingerprints are dealt to tiles by hash
    crowded = dealt.groupBy("deal").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile_rows)
    crowded = crowded.select("deal", F.ceil(F.col("n") / tile_rows).cast("int").alias("k"))
    if not crowded.isEmpty():
        dealt = dealt.join(crowded, "deal", "left")
    else:
        dealt = dealt.withColumn("k", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    other = F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1)
    dealt = dealt.withColumn("own", F.coalesce(own, F.lit(0))).select("fp", "deal", "own", F.explode(other).alias("other"))
    dealt = dealt.select("fp", F.xxhash64("deal", F.least("own", "other"), F.greatest("own", "other")).alias("deal"))

    def run(batches):
        held = [(pdf["deal"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)) for pdf in batches if len(pdf)]
        if held:
            u, v = _links(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), radius)
            yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return dealt.repartition(partitions(fps.sparkSession), "deal").mapInPandas(run, "u long, v long").distinct()


def _settle(edges: DataFrame) -> DataFrame:
    """node and root of links that one task can hold."""
    ship(edges.sparkSession)

    def run(batches):
        held = [pdf.to_numpy() for pdf in batches if len(pdf)]
        if held:
            ends = np.concatenate(held)
            u, v = _forest(ends[:, 0], ends[:, 1])
            roots = np.unique(v)
            yield pd.DataFrame({"node": np.concatenate((u, roots)), "root": np.concatenate((v, roots))})

    return edges.select("a", "b").coalesce(1).mapInPandas(run, "node long, root long")


def components(links: DataFrame, rounds: int = 60, piece: int = PIECE) -> DataFrame:
    """node and root, the smallest node that it reaches, for every node of a link."""

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialise(links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct(), "links")
    before = state(edges)
    for _ in range(rounds):
        if before[0] <= piece:
            return _settle(edges)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def simhash_components(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id, component_size (rows)."""
    prints = materialise(fingerprints(docs, width), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(near_pairs(distinct.select("fp"), radius))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("component_size"))
    by_print = materialise(placed.join(named, "root").select("fp", "component_id", "component_size"), "components")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id", "component_size")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def numbered(docs: DataFrame, dealt: bool = False) -> DataFrame:
    """row, a number of its own for each row, and doc, the row with all columns; written, so that numbers stay. ``dealt`` by row, for several joins on it."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"))
    return dealt_step(rows, "row", "numbered") if dealt else materialise(rows, "numbered")


def keep_first(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The documents without those rows of each component (row, root) that are not its first by doc_id, null ids last."""
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").cast("long").alias("id"), F.col("row"))
    placed = materialise(rows.select("row", order.alias("order")).join(roots, "row").select("row", "root", "order"), "placed")
    first = placed.groupBy("root").agg(F.min("order")["row"].alias("row"))
    gone = placed.select("row").join(first.select("row"), "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents, all columns, of which one row of each component stays: the one with its smallest doc_id."""
    rows = numbered(docs)
    found = simhash_components(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), width, radius)
    return keep_first(docs, rows, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("root")))
