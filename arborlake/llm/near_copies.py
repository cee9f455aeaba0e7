"""Near copies of whole texts by SimHash, for the pipeline; links are checked on the word shingles.

Two rows are linked if their sets of ``WIDTH``-word shingles have a Jaccard similarity of at least
``SIMILARITY``; of each component of links one row stays.

At this similarity a bit of the sets' SimHash fingerprints differs with a probability of 0.15: 10 of 64 bits on average, too many to deal one fingerprint by
16-bit blocks. So a text has ``PRINTS`` fingerprints, majority votes over its set by as many mixings of the XXH64 hashes:

1. Rows are dealt by (block, value) of every ``BLOCK``-bit block of their fingerprints. A pair at the least similarity shares one of the 65 blocks
   with a probability of 0.9999. Sets of at most ``FEW`` shingles, of which a bit may differ with 0.19, are dealt by 64 blocks more, one bit of
   each fingerprint. A deal with more than ``DEAL_ROWS`` rows is cut into tile pairs, so that no link is lost.
2. Inside a deal fingerprints are sorted by bit count and compared by exclusive-or and bit counts, tile by tile, skipping by bit count: first
   two fingerprints, then, among the rows that are still together, all of them. What is close enough, directly or through other rows of the deal, stays
   together, and rows that several deals leave together are one deal from then on.
3. Each of these deals links its rows to its first row, checked on the whole sets. A large group of near copies
   costs little more than its rows.
4. Deals that a shared template crowds, with more than a tile of rows outside their largest component, are dealt again, by the rarest shingles:
   two sets of the similarity share one of the ``n - ceil(SIMILARITY * n) + 1`` rarest of their n shingles, whichever
   order of rarity all rows use, so no link is lost, and what a template repeats is in nobody's rarest unless the rows are near copies. These deals
   link their rows to their first row as well.
5. Deals that still hold several components are cut into tiles of a bounded size. The rows outside the
   deal's largest component meet each other and the largest component's rows, tile by tile; rows of one
   component need not meet. A task compares a pair of tiles by exclusive-or and bit counts as above
   and checks what is left on the whole sets until the two rows are in one component. It returns the
   links that join components, not the pairs.

Every link is checked on the whole sets of 64-bit shingle hashes, so none is wrong.

Defined results: texts of fewer than ``WIDTH`` words are one shingle; null and blank texts are copies of
each other; of a component the row with the smallest doc_id stays, null ids last, and of equal ids
one row; rows are told apart by a row number, so repeated and null ids harm no other row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, partitions, ship, text_chunks
from .simhash import _forest, close_pairs, components, keep_first, numbered, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Rows and shingles of a tile.
TILE_ROWS, TILE_SHINGLES = 2048, 2_000_000
PRINTS, BLOCK, FEW, DEAL_ROWS = 13, 12, 8, 8192
_BLOCKS = 64 // BLOCK
#: Bits that close rows may differ by in one, two and all fingerprints: some 5 deviations above the mean at the least similarity; for sets of at most FEW shingles, whose mean is higher, more.
RADIUS, RADIUS_2, RADIUS_2_FEW, RADIUS_ALL, RADIUS_FEW = 24, 40, 48, 180, 216
_MIX = np.random.default_rng(42).integers(0, 2**63, (PRINTS, 3)).astype(np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes for fingerprint ``k``; for the first as they are."""
    if not k:
        return h
    flip, one, two = _MIX[k]
    with np.errstate(over="ignore"):
        h = (h ^ flip) * one
        h = (h ^ (h >> np.uint64(32))) * two
        return h ^ (h >> np.uint64(29))


def _votes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each column of hashes the bits that are 1 in over half of its ``sizes``; what stands below these is 0. Counts are kept as planes of bits."""
    planes, left = [], hashes
    while True:
        carried = []
        while (n := len(left)) > 1:
            t = max(n // 3, 1)
            a, b, c = left[:t], left[t : 2 * t], left[2 * t : 3 * t]
            both, one = a & b, a ^ b
            if len(c):
                both, one = both | (one & c), one ^ c
            carried.append(both)
            left = np.concatenate((one, left[3 * t :])) if n > 3 * t else one
        planes.append(left[0])
        if not carried:
            break
        left = np.concatenate(carried)
    over, same = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for j in reversed(range(len(planes))):
        half = np.where((sizes // 2) >> j & 1, ~np.uint64(0), np.uint64(0))
        over |= same & planes[j] & ~half
        same &= ~(planes[j] ^ half)
    return over


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``PRINTS`` fingerprints for each set of hashes, none of which is empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    # sets of about one size are counted together: as many rows of hashes as the next power of 1.25 says
    room = np.ceil(1.25 ** np.ceil(np.log(sizes) / np.log(1.25) - 1e-9)).astype(np.int64)
    out = np.zeros((len(sets), PRINTS), np.uint64)
    for n in np.unique(room).tolist():
        own = np.flatnonzero(room == n)
        held, here = np.zeros((len(own), n), np.uint64), np.arange(n) < sizes[own][:, None]
        held[here] = np.concatenate([sets[i] for i in own.tolist()])
        held, here = held.T.copy(), here.T.copy()
        for k in range(PRINTS):
            out[own, k] = _votes(np.where(here, _mixed(held, k), np.uint64(0)), sizes[own])
    return out


def more_keys(prints: np.ndarray) -> list[np.ndarray]:
    """64 deals more: the values of the blocks that hold one bit of each of ``BLOCK`` fingerprints."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), PRINTS, 8), axis=2, bitorder="little")[:, :BLOCK].astype(np.int32)
    values = (bits << np.arange(BLOCK, dtype=np.int32)[None, :, None]).sum(1, dtype=np.int32)
    return list((PRINTS * _BLOCKS + np.arange(64, dtype=np.int32)) * np.int32(1 << BLOCK) + values)


def _shingled(rows: DataFrame, width: int, schema: str, of_chunk) -> DataFrame:
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in text_chunks(texts):
                sets = [np.unique(np.array(shingle_hashes(t, width) or [0], np.uint64)) for t in texts[a:b]]
                yield pd.DataFrame({"row": pdf["row"].iloc[a:b].to_numpy(), **of_chunk(sets)})

    return rows.mapInPandas(run, schema)


def _printed(sets: list[np.ndarray]) -> dict:
    prints, none = fingerprints(sets), np.zeros(0, np.int32)
    more = iter(more_keys(prints[[len(s) <= FEW for s in sets]]))
    return {"size": [len(s) for s in sets], "prints": list(prints.view(np.int64)), "more": [next(more) if len(s) <= FEW else none for s in sets]}


def _whole_deals(batches, least: int = 200_000):
    """Frames of some ``least`` rows, sorted by deal, that end where a deal ends."""
    held, n, most = [], 0, least
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n < most:
            continue
        rows = pd.concat(held)
        deal = rows["deal"].to_numpy()
        cut = int(np.searchsorted(deal, deal[-1]))
        if cut:
            yield rows.iloc[:cut]
        held, n = [rows.iloc[cut:]], len(rows) - cut
        most = max(least, 2 * n)
    if n:
        yield pd.concat(held)


def _apart(prints: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(p[x] ^ p[y]).astype(np.int64) for p in prints.T)


def _together(deal: np.ndarray, prints: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and the first place that each is together with, inside sorted deals; ``radius``: of each place, of a pair the larger one."""
    first = np.ascontiguousarray(prints[:, 0])
    pop = np.bitwise_count(first).astype(np.int64)
    order = np.lexsort((pop, deal))
    starts = np.flatnonzero(np.concatenate(([True], deal[1:] != deal[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(deal)])))
    us, vs, held, most = [], [], 0, 2_000_000

    def take(x, y):
        nonlocal us, vs, held, most
        near = _apart(prints, x, y) <= np.maximum(radius[x], radius[y])
        us.append(x[near])
        vs.append(y[near])
        held += int(near.sum())
        if held > most:
            x, y = _forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held, most = [x], [y], len(x), max(most, 2 * len(x))

    small = order[np.repeat(sizes <= 48, sizes)]
    d, f, p = deal[small], first[small], pop[small]
    for step in range(1, int(sizes[sizes <= 48].max(initial=1))):
        pair = np.flatnonzero((d[:-step] == d[step:]) & (p[step:] - p[:-step] <= RADIUS))
        hit = pair[np.bitwise_count(f[pair] ^ f[pair + step]) <= RADIUS]
        take(small[hit], small[hit + step])
    for at in np.flatnonzero(sizes > 48).tolist():
        for x, y in close_pairs(first[starts[at] : starts[at] + sizes[at]], RADIUS):
            take(starts[at] + x, starts[at] + y)
    return _forest(np.concatenate(us), np.concatenate(vs)) if held else (np.zeros(0, np.int64),) * 2


def _parted(dealt: DataFrame, radius: int, few: int) -> DataFrame:
    """The rows of ``dealt`` (deal, row, size, prints) that are together with others of their deal: deal, named by the rows it holds, row, and near: close to its first row."""

    def run(batches):
        for pdf in _whole_deals(batches):
            deal, row, prints = pdf["deal"].to_numpy(), pdf["row"].to_numpy(), np.stack(pdf["prints"].tolist()).view(np.uint64)
            limit = np.where(pdf["size"].to_numpy() <= FEW, few, radius)
            node, root = _together(deal, prints, limit)
            if not len(node):
                continue
            roots = np.unique(root)
            node, root = np.concatenate((node, roots)), np.concatenate((root, roots))
            order = np.lexsort((row[node], root))
            node, root = node[order], root[order]
            start = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
            n = np.diff(np.concatenate((start, [len(node)])))
            with np.errstate(over="ignore"):
                name = np.add.reduceat(_mixed(row[node].view(np.uint64), 1), start) * _MIX[2, 0] + n.astype(np.uint64)
            head = np.repeat(node[start], n)
            near = _apart(prints, node, head) <= np.maximum(limit[node], limit[head])
            yield pd.DataFrame({"deal": np.repeat(name, n).view(np.int64), "row": row[node], "near": near})

    sent = dealt.repartition(partitions(dealt.sparkSession), "deal").sortWithinPartitions("deal")
    return sent.mapInPandas(run, "deal long, row long, near boolean").distinct()


def _by_blocks(prints: DataFrame, tile_rows: int, deal_rows: int = DEAL_ROWS) -> DataFrame:
    """The rows (deal, row, near) that fingerprints leave together; deals of over ``tile_rows`` rows are parted by two fingerprints only."""
    block = lambda k, b: F.shiftrightunsigned(F.get("prints", F.lit(k)), b * BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int") + F.lit((k * _BLOCKS + b) << BLOCK)
    keys = F.concat(F.array(*[block(k, b) for k in range(PRINTS) for b in range(_BLOCKS)]), "more")
    dealt = prints.select("row", "size", F.slice("prints", 1, 2).alias("prints"), F.explode(keys).alias("deal")).withColumn("deal", F.col("deal").cast("long"))
    # a crowded deal becomes k * (k + 1) / 2 tile pairs
    crowded = dealt.groupBy("deal").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > deal_rows)
    crowded = materialise(crowded.select("deal", F.ceil(F.col("n") / deal_rows).cast("int").alias("k")), "crowded-blocks")
    if not crowded.isEmpty():
        own = F.pmod(F.xxhash64("row"), F.col("k")).cast("int")
        cut = dealt.join(crowded, "deal").withColumn("own", own).select("row", "size", "prints", "deal", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        cut = cut.select("row", "size", "prints", F.xxhash64("deal", F.least("own", "other"), F.greatest("own", "other")).alias("deal"))
        dealt = dealt.join(crowded, "deal", "left_anti").select(*cut.columns).unionByName(cut)
    close = materialise(_parted(dealt, RADIUS_2, RADIUS_2_FEW), "close-rows")
    large = materialise(close.groupBy("deal").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile_rows).select("deal"), "large-deals")
    some = close.join(large, "deal", "left_anti").select("deal", "row").join(prints.select("row", "size", "prints"), "row")
    return materialise(_parted(some, RADIUS_ALL, RADIUS_FEW).unionByName(close.join(large, "deal", "left_semi")), "close-deals")


def _join_group(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links u, v between rows of a group that are in different components; ``side``: rows of one side are not compared, unless all are on one."""
    rows, sets = pdf["row"].to_numpy(), pdf["held"].tolist()
    comp = np.unique(pdf["root"].to_numpy(), return_inverse=True)[1]
    side = pdf["side"].to_numpy()
    whole, sizes, big = pdf["x"].iloc[0] == pdf["y"].iloc[0], np.fromiter(map(len, sets), np.int64, len(sets)), np.bincount(comp).argmax()
    found = []

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        n = sizes[others]
        others = others[np.minimum(n, sizes[i]) >= similarity * np.maximum(n, sizes[i])]
        if not len(others):
            return others
        held = np.concatenate([sets[j] for j in others.tolist()])
        at = np.minimum(np.searchsorted(sets[i], held), sizes[i] - 1)
        n = sizes[others]
        common = np.add.reduceat((sets[i][at] == held).astype(np.int64), np.cumsum(n) - n)
        return others[common / (n + sizes[i] - common) >= similarity]

    for x, y in close_pairs(pdf["fp"].to_numpy().view(np.uint64), RADIUS, 512):
        apart = np.flatnonzero((comp[x] != comp[y]) & (whole | (side[x] != side[y])))
        for part in np.array_split(apart, len(apart) // 100_000 + 1):
            one, two = x[part], y[part]
            turn = comp[one] == big
            one, two = np.where(turn, two, one), np.where(turn, one, two)
            order = np.argsort(one, kind="stable")
            one, two = one[order], two[order]
            for i, others in zip(np.unique(one).tolist(), np.split(two, np.flatnonzero(np.diff(one)) + 1), strict=True) if len(one) else ():
                others = alike(i, others[comp[others] != comp[i]])
                for j in others[np.unique(comp[others], return_index=True)[1]].tolist():
                    found.append((rows[i], rows[j]))
                    keep, gone = (comp[i], comp[j]) if comp[i] == big else (comp[j], comp[i])
                    comp[comp == gone] = keep
    return pd.DataFrame(found, columns=["u", "v"])


def _tiles(placed: DataFrame, tile_rows: int, tile_shingles: int) -> DataFrame:
    """The rows (deal, row, fp, size, root) of deals with several components, once for each group (deal, x, y) that they are in, with their side."""
    weight = F.sum("size") / F.lit(float(tile_shingles))
    by_root = placed.groupBy("deal", "root").agg(F.count(F.lit(1)).alias("n"), weight.alias("w"))
    tiles = lambda n, w: F.ceil(F.greatest(n / F.lit(float(tile_rows)), w)).cast("int")
    mixed = by_root.groupBy("deal").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root", "w")).alias("big"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("roots > 1")
    mixed = mixed.select("deal", F.col("big.root").alias("big"), (tiles(F.col("n"), F.col("w")) <= 1).alias("one"), tiles(F.col("big.n"), F.col("big.w")).alias("k_big"), tiles(F.col("n") - F.col("big.n"), F.col("w") - F.col("big.w")).alias("k_out"))
    rows = placed.join(mixed, "deal").withColumn("out", F.col("root") != F.col("big"))
    rows = rows.withColumn("k_out", F.greatest("k_out", F.lit(1))).withColumn("k_big", F.greatest("k_big", F.lit(1)))
    own = F.pmod(F.xxhash64("row", "deal"), F.when(F.col("out"), F.col("k_out")).otherwise(F.col("k_big"))).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    mine = F.col("own")
    outer = F.transform(upto(F.col("k_out") + F.col("k_big")), lambda y: F.when(y >= mine, pair(mine, y, F.lit(0))).otherwise(pair(y, mine, F.lit(1))))
    inner = F.transform(upto(F.col("k_out")), lambda x: pair(x, F.col("k_out") + mine, F.lit(1)))
    groups = F.when(F.col("one"), F.array(pair(F.lit(0), F.lit(0), F.lit(0)))).when(F.col("out"), outer).otherwise(inner)
    return rows.select("deal", "row", "fp", "root", F.explode(groups).alias("g")).select("deal", "row", "fp", "root", "g.x", "g.y", "g.side")


def _first_links(deals: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: links of each deal's rows (deal, row) to its first row."""
    first = deals.groupBy("deal").agg(F.min("row").alias("v"))
    pairs = deals.join(first, "deal").where("row <> v").select(F.col("row").alias("u"), "v").distinct()
    both = pairs.join(sets.select(F.col("row").alias("u"), F.col("held").alias("a")), "u").join(sets.select(F.col("row").alias("v"), F.col("held").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    long_enough = F.least(F.size("a"), F.size("b")) / F.greatest(F.size("a"), F.size("b")) >= similarity
    return materialise(both.where(long_enough).where(common / (F.size("a") + F.size("b") - common) >= similarity).select("u", "v"), "first-links")


def _placed(deals: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of deals with the root of their component."""
    roots = components(found).withColumnRenamed("node", "row")
    rows = deals.join(roots, "row", "left").select("deal", "row", "fp", "size", F.coalesce("root", "row").alias("root"))
    return materialise(rows, "placed-rows")


def _crowded(placed: DataFrame, tile_rows: int, tile_shingles: int) -> DataFrame:
    """The deals with more than a tile of rows or shingles outside their largest component."""
    by_root = placed.groupBy("deal", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    deals = by_root.groupBy("deal").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "root", "w")).alias("big"))
    return materialise(deals.where((F.col("n") - F.col("big.n") > tile_rows) | (F.col("w") - F.col("big.w") > tile_shingles)).select("deal"), "crowded-deals")


def _by_rarest(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``placed`` dealt by each of the rarest shingles that a row similar to them must share; rarity is counted over these rows."""
    rows = placed.select("row", "fp", "size").distinct()
    held = materialise(sets.join(rows.select("row"), "row", "left_semi").select("row", F.size("held").alias("n"), F.explode("held").alias("deal")), "crowded-shingles")
    often = held.groupBy("deal").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("row").orderBy("often", "deal")
    rank = held.join(often, "deal").withColumn("nth", F.row_number().over(order))
    rare = rank.where((F.col("nth") <= F.col("n") - F.ceil(F.col("n") * F.lit(similarity)) + 1) & (F.col("often") > 1)).select("row", "deal")
    shared = rare.groupBy("deal").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("deal")
    return materialise(rare.join(shared, "deal").join(rows, "row").select("row", "fp", "size", F.xxhash64(F.lit("rarest"), "deal").alias("deal")), "rarest-deals")


def links(rows: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES, steps: list[DataFrame] | None = None) -> DataFrame:
    """u, v: links between rows that keep the components of all pairs of the similarity. ``rows``: row, text. ``steps`` gets the large steps that it reads."""
    ship(rows.sparkSession)
    prints = materialise(_shingled(rows, width, "row long, size long, prints array<long>, more array<int>", _printed), "fingerprints")
    close = _by_blocks(prints, tile_rows)
    deals = close.join(prints.select("row", F.get("prints", F.lit(0)).alias("fp"), "size"), "row")
    sets = _shingled(rows.join(close.select("row").distinct(), "row", "left_semi"), width, "row long, held array<long>", lambda ss: {"held": [np.sort(s.view(np.int64)) for s in ss]})
    sets = materialise(sets, "shingle-sets")

    found = _first_links(close.where("near").select("deal", "row"), sets, similarity)
    placed = _placed(deals, found)
    crowded = _crowded(placed, tile_rows, tile_shingles)
    if not crowded.isEmpty():
        thin = _by_rarest(placed.join(crowded, "deal", "left_semi"), sets, similarity)
        found = materialise(found.unionByName(_first_links(thin.select("deal", "row"), sets, similarity)), "all-first-links")
        placed = _placed(deals.join(crowded, "deal", "left_anti").select(*thin.columns).unionByName(thin), found)
    dealt = materialise(_tiles(placed, tile_rows, tile_shingles), "tiles")
    met = dealt.join(sets, "row")
    more = met.groupBy("deal", "x", "y").applyInPandas(lambda pdf: _join_group(pdf, similarity), "u long, v long")
    if steps is not None:
        steps += [prints, close, sets, placed, dealt]
    return found.unionByName(more)


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, of which one of each component stays."""
    rows = numbered(docs, dealt=True)
    texts = rows.select("row", F.col("doc.text").cast("string").alias("text"))
    steps: list[DataFrame] = []
    roots = components(links(texts, width, similarity, steps=steps)).withColumnRenamed("node", "row")
    discard(*steps)  # the components are written
    return keep_first(docs, rows, roots)
