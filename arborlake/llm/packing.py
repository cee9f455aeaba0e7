"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

A document is its token ids and one end id. Documents longer than a sequence are cut into full pieces,
the first of which may be shorter. Full pieces are sequences of their own; the others are packed.

Pieces are dealt by a row number to blocks of about ``BLOCK`` pieces, whatever their source and however
often they repeat. Each block is evolved on ``ISLANDS`` islands, each an independent Spark row group with
its own population. A child of two packings takes whole well-filled bins of one parent, drops the other
parent's bins that duplicate their pieces and ``DISSOLVED`` of its worst bins, and best-fits the displaced
pieces into what is left. After each epoch the best packing of an island migrates to the next. The budget
is ``EPOCHS`` times ``GENERATIONS`` children an island; an island stops early only once its packing needs no
more bins than the pieces' total length, which nothing can better. At the end the badly filled bins of all blocks
are dissolved and packed again together; if they fit one block, blocks cost no more than a bin in total.

A packing is an array of bin numbers, so a block's state is a few arrays of bounded length; epochs are
written to the shared folder and a lost executor repeats one epoch of its blocks.

Defined results: a null text is an empty one and packs as its end id alone; repeated rows and null ids
are packed as rows of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, ship, text_chunks

LENGTH = 2048
BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 4096, 2, 6, 3, 30
#: Bins filled to this share may be injected whole; final bins below LOOSE are packed again together.
WELL_FILLED, LOOSE, DISSOLVED = 0.995, 0.97, 0.1
SEED = 17


def vocabulary() -> tuple[str, str]:
    """Path of the byte-level vocabulary's ranks, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def added_tokens() -> dict[str, int]:
    """The tokens that the tokenizer file adds to its vocabulary, each of which is one id wherever it stands."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@functools.cache
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added_tokens())


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the first perhaps shorter."""
    head = n % length
    starts = ([0] if head else []) + list(range(head, n, length))
    return [(a, head if head and not k else length) for k, a in enumerate(starts)]


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    known = vocabulary() if path is None or pattern is None else (path, pattern)

    def run(batches):
        encode = functools.partial(encoder(*known).encode, allowed_special="all")
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for a, b in text_chunks(texts):
                out = []
                for doc, text in zip(ids[a:b], texts[a:b], strict=True):
                    tokens = encode(text or "")
                    tokens.append(0)
                    raw = np.array(tokens, "<u4").tobytes()
                    out += [(doc, k, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(tokens), length))]
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))


def best_fit(sizes: np.ndarray, bins: np.ndarray, todo: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Put the pieces ``todo``, in that order, each into the fullest bin that takes it; -1 in ``bins``: not placed."""
    bins = bins.copy()
    placed = bins >= 0
    n_bins = int(bins.max(initial=-1)) + 1
    fill = np.bincount(bins[placed], weights=sizes[placed], minlength=n_bins).astype(np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0
    for b, f in enumerate(fill.tolist()):
        if 0 < f < length:
            by_room[length - f].append(b)
            rooms |= 1 << (length - f)
    spare = [b for b, f in enumerate(fill.tolist()) if not f]
    for k, s in zip(todo.tolist(), sizes[todo].tolist(), strict=True):
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room = length
            if spare:
                b = spare.pop()
            else:
                b, n_bins = n_bins, n_bins + 1
        bins[k] = b
        if room > s:
            by_room[room - s].append(b)
            rooms |= 1 << (room - s)
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, bins: np.ndarray, length: int = LENGTH) -> tuple[int, float]:
    """Smaller is better: bins, then how evenly the space is spread instead of gathered in few bins."""
    fill = np.bincount(bins, weights=sizes)
    return len(fill), -float(((fill / length) ** 2).mean())


def least_bins(sizes: np.ndarray, length: int = LENGTH) -> int:
    return -(-int(sizes.sum()) // length)


def crossover(sizes: np.ndarray, mine: np.ndarray, other: np.ndarray, rng: np.random.Generator, length: int = LENGTH) -> np.ndarray:
    fill = np.bincount(other, weights=sizes)
    good = np.flatnonzero(fill >= WELL_FILLED * length)
    given = np.zeros(len(fill), bool)
    given[rng.choice(good, -(-len(good) // 2), replace=False)] = True
    injected = given[other]
    own = np.bincount(mine, weights=sizes)
    hit = np.zeros(len(own), bool)
    hit[mine[injected]] = True
    worst = np.argsort(own + 0.05 * length * rng.random(len(own)), kind="stable")
    hit[worst[: int(np.ceil(DISSOLVED * len(own)))]] = True
    child = np.where(hit[mine], -1, mine)
    child[injected] = len(hit) + other[injected]
    child[child >= 0] = np.unique(child[child >= 0], return_inverse=True)[1]
    loose = np.flatnonzero(child < 0)
    blur = 1 + 0.2 * rng.random() * rng.random(len(loose))
    return best_fit(sizes, child, loose[np.argsort(-sizes[loose] * blur, kind="stable")], length)


def evolve(sizes: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, generations: int = GENERATIONS, length: int = LENGTH) -> list[np.ndarray]:
    """The population after some generations, best first; a child replaces the worst if it is no worse."""
    ranked = sorted(((fitness(sizes, p, length), p) for p in population), key=lambda x: x[0])
    least = least_bins(sizes, length)
    for _ in range(generations):
        if ranked[0][0][0] <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossover(sizes, ranked[a][1], ranked[b][1], rng, length)
        worth = fitness(sizes, child, length)
        if worth <= ranked[-1][0]:
            ranked = sorted([*ranked[:-1], (worth, child)], key=lambda x: x[0])
    return [p for _, p in ranked]


def first_population(sizes: np.ndarray, n: int, rng: np.random.Generator, length: int = LENGTH) -> list[np.ndarray]:
    """Best fit by falling size, then by falling sizes that are blurred more and more; the first again where it cannot be bettered."""
    empty = np.full(len(sizes), -1, np.int64)
    falling = best_fit(sizes, empty, np.argsort(-sizes, kind="stable"), length)
    if fitness(sizes, falling, length)[0] <= least_bins(sizes, length):
        return [falling] * n
    blurred = [-sizes * (1 + 0.1 * k * rng.random(len(sizes))) for k in range(1, n)]
    return [falling, *[best_fit(sizes, empty, np.argsort(x, kind="stable"), length) for x in blurred]]


_ORDER = ["length", "doc_id", "piece", "start", "ids_crc32"]
_PACKED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, block long, bin int, offset long, loose boolean"


def _pack(items: DataFrame, blocks: int, length: int, islands: int, epochs: int, loose: float) -> DataFrame:
    """The items with block, bin, offset and whether their bin is badly filled."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = np.sort(pdf["length"].to_numpy())
        sizes = sizes[sizes < length]
        out = []
        for island in range(islands if len(sizes) else 0):
            rng = np.random.default_rng([SEED, int(key[0]), island, 0])
            population = first_population(sizes, POPULATION, rng, length)
            out.append((int(key[0]), island, sizes.tobytes(), np.concatenate(population).astype(np.int32).tobytes(), population[0].astype(np.int32).tobytes()))
        return pd.DataFrame(out, columns=["block", "island", "sizes", "population", "elite"])

    state = materialise(dealt.groupBy("block").applyInPandas(begin, "block long, island int, sizes binary, population binary, elite binary"), "islands")
    for epoch in range(epochs):
        guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))

        def step(batches, epoch=epoch):
            for pdf in batches:
                out = []
                for block, island, raw, population, guest in zip(pdf["block"], pdf["island"], pdf["sizes"], pdf["population"], pdf["guest"], strict=True):
                    sizes = np.frombuffer(raw, np.int64)
                    rng = np.random.default_rng([SEED, int(block), int(island), epoch + 1])
                    own = list(np.frombuffer(population, np.int32).reshape(-1, len(sizes)))
                    own = evolve(sizes, [*own[:-1], np.frombuffer(guest, np.int32)], rng, GENERATIONS, length)
                    out.append((block, island, raw, np.concatenate(own).astype(np.int32).tobytes(), own[0].astype(np.int32).tobytes()))
                yield pd.DataFrame(out, columns=["block", "island", "sizes", "population", "elite"])

        met = state.select("block", "island", "sizes", "population").join(guests, ["block", "island"]).repartition(min(blocks * islands, partitions(items.sparkSession)), "block", "island")
        state = materialise(met.mapInPandas(step, state.schema), "islands")

    def assemble(key: tuple, mine: pd.DataFrame, islands: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(_ORDER, kind="stable").reset_index(drop=True)
        sizes = mine["length"].to_numpy()
        short = sizes < length
        bins = np.zeros(len(sizes), np.int64)
        if len(islands):
            found = [np.frombuffer(e, np.int32) for e in islands.sort_values("island")["elite"]]
            bins[short] = min(found, key=lambda p: fitness(sizes[short], p, length))
        bins[~short] = bins[short].max(initial=-1) + 1 + np.arange((~short).sum())
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        new = np.concatenate(([True], np.diff(bins[order]) != 0)) if len(order) else np.zeros(0, bool)
        offset = np.zeros(len(sizes), np.int64)
        offset[order] = starts - np.maximum.accumulate(np.where(new, starts, 0))
        fill = np.bincount(bins, weights=sizes)
        return mine.assign(block=int(key[0]), bin=bins.astype(np.int32), offset=offset, loose=fill[bins] < loose * length)

    return dealt.groupBy("block").cogroup(state.select("block", "island", "elite").groupBy("block")).applyInPandas(assemble, _PACKED)


def pack(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    found = pieces(docs, length, path, pattern)
    items = materialise(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    n = items.count()
    first = materialise(_pack(items, max(1, -(-n // block)), length, ISLANDS, EPOCHS, LOOSE), "packed")
    left = first.where("loose").select(*items.columns)
    n_left = left.count()
    again = _pack(left, max(1, -(-n_left // block)), length, ISLANDS, EPOCHS, 0.0)

    def numbered(df: DataFrame, level: int) -> DataFrame:
        # 2 levels, 2^31 bins a block
        return df.select(*found.columns, ((F.col("block") * 2 + level) * F.lit(2**31) + F.col("bin")).alias("sequence_id"), "offset")

    return numbered(first.where("not loose"), 0).unionByName(numbered(again, 1))
