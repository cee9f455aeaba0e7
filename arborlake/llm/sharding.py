"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of a ring of ``CELLS`` cells; a row's key hashes to a place on the
ring and belongs to the shard of the next point clockwise. A shard takes rows up to its bound; rows
that find it full continue clockwise to the next shard with room. With bounds that add up to the
number of rows (``law`` ``rows``) counts are at most one apart. Rows only ever leave full shards, so
most stay on the shard that the plain ring gives them.

Which rows overflow is decided by counts, not row by row: one pass counts rows by cell (a table of a
fixed size, whatever the input), the ring is filled from those counts, and each cell gets runs of
ranks with a shard and a first slot. A row's rank in its cell is all that is left to find, by one
window per cell. Cells are cut by hash of the key. One id, or no id, that very many rows share crowds
its cell: a cell of more than ``CROWD`` times the mean is cut into parts of about that size by the
rows' numbers. All parts lie at the cell's place on the ring, each has a window of its own, and there
are at most ``2 * cells / CROWD`` of them. More rows need more cells (``cells``), not larger ones.

Ids, sizes and checksums are written once with a row number, so each text is read once and a lost
executor finds the same numbers again.

Defined results: a null text has size 1 and the checksum of an empty text; a null or repeated
``doc_id`` is a key like any other (rows of one key are interchangeable); extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise

SHARDS, VIRTUAL, CELLS = 8, 512, 1 << 14
#: A cell of more than so many times the mean number of rows is cut into parts.
CROWD = 4


def ring(shards: int = SHARDS, virtual: int = VIRTUAL, cells: int = CELLS) -> list[list[int]]:
    """For each cell the shards in clockwise order, the owner first."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}", 0) * cells >> 64, s) for s in range(shards) for v in range(virtual))
    at = [p for p, _ in points]
    out = []
    for cell in range(cells):
        k = bisect.bisect_left(at, cell)
        order: list[int] = []
        for step in range(len(points)):
            s = points[(k + step) % len(points)][1]
            if s not in order:
                order.append(s)
                if len(order) == shards:
                    break
        out.append(order)
    return out


def bounds(n: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may take. Without slack they add up to n and differ by at most one."""
    if slack:
        return [int(-(-n * (1 + slack) // shards))] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def fill(counts: dict[int, int], order: list[list[int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, rows, shard, first slot). Cells claim their owner first, then what overflows moves on."""
    shards = len(room)
    room, slot = list(room), [0] * shards
    waiting = [(cell, 0, n) for cell, n in sorted(counts.items())]
    out = []
    for hop in range(shards):
        over = []
        for cell, first, n in waiting:
            s = order[cell][hop]
            take = min(n, room[s])
            if take:
                out.append((cell, first, take, s, slot[s]))
                room[s] -= take
                slot[s] += take
            if take < n:
                over.append((cell, first + take, n - take))
        waiting = over
    if waiting:
        raise ValueError("the bounds are below the number of rows")
    return out


def cut(rows: DataFrame, cells: int, crowd: int = CROWD) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """The rows with the ``part`` of their cell, and the rows of each (cell, part)."""
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = crowd * -(-sum(counts.values()) // cells)
    crowded = [(cell, -(-n // limit)) for cell, n in counts.items() if n > limit]
    if not crowded:
        return rows.withColumn("part", F.lit(0)), {(cell, 0): n for cell, n in counts.items()}
    # fewer than cells / crowd cells hold more than the limit
    parts = F.broadcast(rows.sparkSession.createDataFrame(crowded, "cell int, parts int"))
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")
    rows = rows.join(parts, "cell", "left").withColumn("part", part).drop("parts")
    found = rows.join(parts, "cell", "left_semi").groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).collect()
    whole = {cell for cell, _ in crowded}
    return rows, {(cell, 0): n for cell, n in counts.items() if cell not in whole} | {(r["cell"], r["part"]): r["n"] for r in found}


def assign_shards(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, cells: int = CELLS, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, ring_shard (the plain ring's shard)."""
    spark = docs.sparkSession
    key = F.col("doc_id").cast("string")
    cell = F.shiftrightunsigned(F.xxhash64(key), 64 - cells.bit_length() + 1).cast("int")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length(text)) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("size"), F.crc32(text).alias("text_crc32"), cell.alias("cell"), F.xxhash64(key, F.lit(1)).alias("place"), F.monotonically_increasing_id().alias("row"))
    rows, counts = cut(materialise(rows, "sharding-rows"), cells)
    clockwise = ring(shards, virtual, cells)
    pieces = sorted(counts)
    runs = fill({k: counts[p] for k, p in enumerate(pieces)}, [clockwise[c] for c, _ in pieces], bounds(sum(counts.values()), shards, slack))
    by_piece: dict[int, list[tuple[int, int, int, int]]] = {}
    for k, first, n, s, slot in runs:
        by_piece.setdefault(k, []).append((first, n, s, slot))
    # at most cells + 2 * cells / CROWD pieces of at most `shards` runs each: a size fixed by the parameters
    plan = spark.createDataFrame([(*pieces[k], clockwise[pieces[k][0]][0], r) for k, r in by_piece.items()], "cell int, part int, ring_shard int, runs array<struct<first:long,n:long,shard:long,slot:long>>")

    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("place", "doc_id", "text_crc32", "size", "row")) - 1
    ranked = rows.withColumn("rank", rank).join(F.broadcast(plan), ["cell", "part"])
    run = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["n"]))[0]
    placed = ranked.withColumn("run", run)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.shard").cast("int").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "ring_shard")
