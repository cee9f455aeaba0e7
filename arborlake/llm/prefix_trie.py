"""The trie of conversations' common beginnings, by whole-sequence collapse.

A prefix of a conversation is known by two 64-bit combinations of its turns' digests (SHA-256 of role and text, mixed
with the turn's place), so the prefix of every turn is a running exclusive-or, not a walk down a trie, and a whole
conversation is known by the combination of all its turns.

1. Identical conversations collapse into one sequence with a weight, its smallest conv_id and the list of those that end there. A
   conversation that a third of all rows repeat is one sequence from here on.
2. Every prefix of a distinct sequence is written once; nodes are the groups of equal prefixes, with weights summed.
3. Sequences that are proper prefixes of others are dropped by an anti-join; those left are the leaves.
4. The leaves' prefixes tell how many leaves are under a node. Sums over subtrees come from them too: each node's own value
   belongs to the smallest leaf under it, a running total from the end of each leaf's path gives what the leaf owns at
   or below a depth, and a node adds these totals of its leaves. Work is linear in the turns; no node meets its
   ancestors' list.

All steps are DataFrame functions but one: the SHA-256 of a list of conv_ids has no parallel form. Ids are dealt by range of
(node, conv_id), so that a hot list is joined into text by many tasks, and only these texts are hashed in order, as a stream.

Defined results: a null conv_id is no conversation and takes no part; rows of equal turn are ordered by role, then
text; ``c % 100`` has the sign of c; extra columns are ignored; a table without a conversation gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship
from .ranks import MOST, ranked, running

SHARED, MOST_SHARED = 100, 6
#: Characters of one text of ids.
CHUNK = 1 << 20
NODE = ["depth", "p", "q"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """conv_id, at (from 1), said (digest of role and text), chars."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    at = ranked(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "at", most)
    return at.select("conv_id", "at", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("said"), F.length("text").cast("long").alias("chars"))


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The rebuilt conversations in the same columns: each begins with up to five turns of another."""
    heads = turns.where((F.col("conv_id") % SHARED == 0) & (F.col("at") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    sizes = heads.groupBy("base").agg(F.max("at").alias("there"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    plan = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"), h.alias("h")).join(sizes, "base", "left")
    plan = plan.select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).cast("long").alias("from_base"))
    first = plan.join(heads, "base").where("at <= h").select("conv_id", "at", "said", "chars")
    own = turns.join(plan.select("conv_id", "h", "from_base"), "conv_id").where("at > h")
    return first.unionByName(own.select("conv_id", (F.col("at") - F.col("h") + F.col("from_base")).alias("at"), "said", "chars"))


def _hashed_lists(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """depth, p, q, ends_sha256: of the conv_ids of each sequence in numerical order, comma-joined."""

    def rows_of(batches):
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    def packed(rows):
        """Record batches of about ``chunk`` characters of ids or 10,000 rows."""
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r.get("ids", ""))
            if size > chunk or len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held)

    def texts(batches):
        def parts():
            for (d, p, q), run in groupby(rows_of(batches), key=lambda r: r[:3]):
                held, size = [], 0
                for _, _, _, conv in run:
                    held.append(conv)
                    size += len(str(conv)) + 1
                    if size > chunk:
                        yield {"depth": d, "p": p, "q": q, "first": held[0], "ids": ",".join(map(str, held))}
                        held, size = [], 0
                if held:
                    yield {"depth": d, "p": p, "q": q, "first": held[0], "ids": ",".join(map(str, held))}

        return packed(parts())

    def hashes(batches):
        def lists():
            for (d, p, q), run in groupby(rows_of(batches), key=lambda r: r[:3]):
                sha = hashlib.sha256()
                for k, r in enumerate(run):
                    sha.update((("," if k else "") + r[4]).encode())
                yield {"depth": d, "p": p, "q": q, "ends_sha256": sha.hexdigest()}

        return packed(lists())

    by = [*NODE, "conv_id"]
    parts = ends.repartitionByRange(*by).sortWithinPartitions(*by).select(*by).mapInArrow(texts, "depth long, p long, q long, first long, ids string")
    again = [*NODE, "first"]
    return parts.repartition(*NODE).sortWithinPartitions(*again).mapInArrow(hashes, "depth long, p long, q long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(conversations.sparkSession)
    turns = materialise(turns_in_order(conversations, most), "turns")
    convs = turns.select("conv_id").distinct()
    mix = lambda k: F.xxhash64(F.lit(k), F.col("at"), F.col("said"))
    rows = rebuilt(turns, convs).select("conv_id", "at", mix(1).alias("p1"), mix(2).alias("q1"), "chars")
    # the root is a turn of no text that every conversation begins with
    zero = F.lit(0).cast("long")
    rows = rows.unionByName(convs.select("conv_id", zero.alias("at"), zero.alias("p1"), zero.alias("q1"), zero.alias("chars")))
    rows = materialise(rows, "rebuilt")

    whole = rows.groupBy("conv_id").agg(F.max("at").alias("depth"), F.bit_xor("p1").alias("p"), F.bit_xor("q1").alias("q"))
    whole = materialise(whole, "whole-sequences")
    sequences = whole.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"))
    sequences = materialise(sequences, "sequences")

    mine = rows.join(sequences.select("conv_id", "weight", F.col("depth").alias("length")), "conv_id")
    path = running(mine, "conv_id", "at", {"p": (F.bit_xor, "p1"), "q": (F.bit_xor, "q1")}, most)
    path = path.select("conv_id", "weight", "length", F.col("at").alias("depth"), "p", "q", F.col("p").bitwiseXOR(F.col("p1")).alias("up_p"), F.col("q").bitwiseXOR(F.col("q1")).alias("up_q"), "chars")
    path = materialise(path, "prefixes")

    nodes = path.groupBy(*NODE).agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("up_p").alias("up_p"), F.max("up_q").alias("up_q"))
    inner = path.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("conv_id")
    down = materialise(path.join(leaves, "conv_id", "left_semi").select("conv_id", *NODE), "leaf-prefixes")
    under = down.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_leaves"), F.min("conv_id").alias("owner"))
    nodes = materialise(nodes.join(under, NODE), "nodes")

    value = nodes.select(*NODE, "owner", ((F.col("n_convs") - 1) * F.col("chars")).alias("value")).where("value > 0")
    owned = down.join(value, NODE, "left").select("conv_id", *NODE, F.when(F.col("owner") == F.col("conv_id"), F.col("value")).otherwise(0).cast("long").alias("value"))
    below = running(materialise(owned, "owned"), "conv_id", "depth", {"below": (F.sum, "value")}, most, last_first=True)
    saved = below.groupBy(*NODE).agg(F.sum("below").alias("saved_tokens"))

    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(F.count(F.lit(1)).alias("n_children"))
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("parent_conv_id"))
    lists = _hashed_lists(whole, chunk)
    out = nodes.join(saved, NODE).join(up, NODE, "left").join(lists, NODE, "left").join(parent, ["depth", "up_p", "up_q"], "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
