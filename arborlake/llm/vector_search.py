"""Exact top-k search by inner product with vector-approximation files.

Vectors are rows of integers, ``floor(256 * x)``. The approximation file holds tiles of ``TILE`` vectors: for each
dimension the tile's smallest value and the width of its 256 cells, and for each vector one byte a dimension, the cell
that it lies in. Beside it each tile has the exact integers.

A query scans a tile's cells: the corners of a cell bound the inner product of whatever lies in it from above. Exact
vectors are then read in the order of their bounds, best first, and reading ends where the next bound is below the kth best exact
score so far, which goes on from tile to tile. So no vector that is passed over can be among the k best, and the results are
exact.

Equal vectors are one entry of the file, with its ``k + 1`` smallest members; a vector that a third of all rows share
is scanned once, and a query that is one of a thousand equal rows is answered once. The file is scanned by blocks of at most
``QUERIES`` distinct queries. Tiles are dealt over several lanes, which each keep the best of every query of
the block; a task streams its lane, one tile in memory at a time, so memory follows the two block sizes. The lanes' best meet in one
aggregation, which keeps k + 1 a query before it shuffles. Nothing is broadcast.

Defined results: vectors that are null or hold a null or non-finite component take no part; a null vec_id is no query and comes
last among ties; rows are told apart as rows, so an equal row under the same vec_id is a candidate of its
own; missing components of a shorter vector count as 0, also all of an empty one; integers beyond 2^26 either way count as 2^26, so that a score fits a
long; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, ship

K, EVERY = 5, 50
TILE, QUERIES, CELLS = 2048, 2048, 256
_LARGEST = 1 << 26
_TILE_SQL = "n int, dims int, base binary, width binary, cells binary, exact binary, ids binary, first binary"


def integers(vectors: DataFrame) -> DataFrame:
    """row, vec_id, ints, same (digest of ints): the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    scaled = lambda v: F.floor(F.least(F.greatest(v * 256.0, F.lit(-float(_LARGEST))), F.lit(float(_LARGEST)))).cast("int")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(fine)
    return rows.select("row", "vec_id", F.transform(x, scaled).alias("ints")).withColumn("same", F.sha2(F.array_join("ints", ",").cast("binary"), 256))


def _matrix(lists: list[list[int]]) -> np.ndarray:
    width = max(map(len, lists), default=0)
    if all(len(x) == width for x in lists):
        return np.array(lists, np.int64).reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _write_tiles(tile: int, cells: int):
    def run(batches):
        held: list[tuple] = []

        def one(rows):
            exact = _matrix([r[2] for r in rows])
            low, high = (exact.min(0), exact.max(0)) if exact.size else (np.zeros(exact.shape[1], np.int64),) * 2
            width = (high - low) // cells + 1
            code = (exact - low) // width
            return pa.RecordBatch.from_pylist([{"n": len(rows), "dims": exact.shape[1], "base": low.tobytes(), "width": width.tobytes(), "cells": code.astype(np.uint8).tobytes(), "exact": exact.astype(np.int32).tobytes(), "ids": np.array([r[0] for r in rows], np.int64).tobytes(), "first": np.array([r[1] for r in rows], np.int64).tobytes()}], schema)

        schema = pa.schema([("n", pa.int32()), ("dims", pa.int32()), *[(c, pa.binary()) for c in ("base", "width", "cells", "exact", "ids", "first")]])
        for b in batches:
            held.extend(zip(*[c.to_pylist() for c in b.columns], strict=True))
            while len(held) >= tile:
                yield one(held[:tile])
                held = held[tile:]
        if held:
            yield one(held)

    return run


class _Best:
    """The best entries of one query so far: (-score, first vec_id, entry), ascending."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], -math.inf

    def add(self, scores: np.ndarray, first: np.ndarray, ids: np.ndarray) -> None:
        self.rows = sorted([*self.rows, *zip((-scores).tolist(), first.tolist(), ids.tolist(), strict=True)])[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def search_tile(queries: np.ndarray, best: list[_Best], tile: dict, read: int = 32) -> int:
    """Bring ``best`` of each query up to date with a tile; the number of exact vectors that were read."""
    n, dims = tile["n"], tile["dims"]
    low, width = np.frombuffer(tile["base"], np.int64), np.frombuffer(tile["width"], np.int64)
    cells = np.frombuffer(tile["cells"], np.uint8).reshape(n, dims)
    exact = np.frombuffer(tile["exact"], np.int32).reshape(n, dims)
    ids, first = np.frombuffer(tile["ids"], np.int64), np.frombuffer(tile["first"], np.int64)
    q = np.zeros((len(queries), dims), np.int64)
    shared = min(dims, queries.shape[1])
    q[:, :shared] = queries[:, :shared]
    # doubles are exact up to 2^53; beyond that the sums are made of integers
    wide = float(np.abs(q).sum(1).max(initial=0)) * float(np.maximum(np.abs(low), np.abs(low + (width * CELLS))).max(initial=0)) >= 2.0**52
    kind = np.int64 if wide else np.float64
    corner = (low + cells * width).astype(kind)
    bound = q.astype(kind) @ corner.T + (np.maximum(q, 0) @ (width - 1)).astype(kind)[:, None]
    seen = 0
    for k, held in enumerate(best):
        near = np.flatnonzero(bound[k] >= held.least)
        near = near[np.argsort(-bound[k][near], kind="stable")]
        for a in range(0, len(near), read):
            some = near[a : a + read]
            if bound[k][some[0]] < held.least:
                break
            some = some[bound[k][some] >= held.least]
            held.add(exact[some].astype(np.int64) @ q[k], first[some], ids[some])
            seen += len(some)
    return seen


def _scan(k: int):
    names = ["query", "ints", "n", "dims", "base", "width", "cells", "exact", "ids", "first"]

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("block", "lane", *names)], strict=True)

        for _, group in groupby(rows(), key=lambda r: r[:2]):
            queries, best, matrix = [], [], None
            for r in group:
                r = dict(zip(names, r[2:], strict=True))
                if r["n"] is None:
                    queries.append((r["query"], r["ints"]))
                    continue
                if matrix is None:
                    matrix, best = _matrix([x for _, x in queries]), [_Best(k) for _ in queries]
                search_tile(matrix, best, r)
            found = [(q, row, -score) for (q, _), held in zip(queries, best, strict=False) for score, _, row in held.rows]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], names=["query", "entry", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, tile: int = TILE, block: int = QUERIES, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = materialise(integers(vectors), "vectors")
    place = Window.partitionBy("same").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    members = materialise(rows.select("row", "vec_id", "same").withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k + 1), "members")
    entry = members.where("nth = 1").select("same", F.col("row").alias("entry"), F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("first"))
    ints = rows.join(entry.select(F.col("entry").alias("row"), "first"), "row")
    tiles = materialise(ints.select("row", "first", "ints").mapInArrow(_write_tiles(tile, cells), _TILE_SQL), "approximations")

    asked = materialise(rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("by"), F.col("vec_id").alias("query_id"), "same"), "asked")
    entries = asked.select("same").distinct().join(entry, "same").select(F.col("entry").alias("query"), "same")
    queries = rows.select("row", "ints").join(entries.select(F.col("query").alias("row")), "row")
    n_queries, n_tiles = entries.count(), tiles.count()
    blocks = max(1, -(-n_queries // block))
    lanes = max(1, min(-(-partitions(spark) // blocks), n_tiles))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ask = queries.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), upto(lanes).alias("lane"), F.col("row").alias("query"), "ints")
    show = tiles.select(upto(blocks).alias("block"), F.pmod(F.monotonically_increasing_id() + F.floor(F.monotonically_increasing_id() / (1 << 33)), F.lit(lanes)).cast("int").alias("lane"), "*")
    both = ask.unionByName(show, allowMissingColumns=True).repartition(blocks * lanes, "block", "lane").sortWithinPartitions("block", "lane", F.col("n").asc_nulls_first())
    found = both.mapInArrow(_scan(k + 1), "query long, entry long, score long")

    # entries better than a class's own come before it, so k + 1 entries hold the k + 1 best rows
    one = entry.select("entry", "first")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "first", "entry")
    best = found.join(one, "entry").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select("query", "entry", "score")
    rows_of = members.select("same", "vec_id", "row").join(entry.select("same", "entry"), "same").select("entry", "vec_id", "row")
    listed = F.struct((-F.col("score")).alias("down"), F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("place"), F.col("row"), F.col("vec_id"))
    lists = best.join(rows_of, "entry").groupBy("query").agg(F.slice(F.array_sort(F.collect_list(listed)), 1, k + 1).alias("near"))
    by_class = materialise(lists.join(entries, "query").select("same", "near"), "answers")
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("by")), 1, k)
    told = asked.join(by_class, "same").select("query_id", F.posexplode(others).alias("at", "x"))
    return told.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.down")).cast("long").alias("score"))
